"""Text tools the document operators share; all work on whole texts."""

from __future__ import annotations

import html
import unicodedata

import regex
from pyspark.sql import DataFrame

#: Characters that show nothing: format characters, variation selectors, joiners, soft hyphens.
INVISIBLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}]+")
#: An ampersand that was escaped again and again.
NESTED = regex.compile(r"&(?:(?:amp|AMP|#0*38|#[xX]0*26);)+")
TAG = regex.compile(r"</?([A-Za-z][A-Za-z0-9:_-]*)[^<>]*>|<[!?][^<>]*>")
#: Accents that stand alone, which compatibility forms would turn into a blank and a mark; they are written as apostrophes and quotes.
ALONE = regex.compile("[" + "".join(c for c in map(chr, range(0x80, 0x10000)) if len(z := unicodedata.normalize("NFKC", c)) > 1 and z[0] == " ") + "]")
WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*")

# Elements that lie within a line of text, and those that part lines.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q s samp small span strike strong sub sup time tt u var wbr".split())
BLOCK = set("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())


def without_comments(text: str) -> str:
    """Text without closed HTML comments, in one pass however many are left open."""
    out, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        out += [text[at:start], " "]
        at = end + 3
    return "".join([*out, text[at:]])


def without_tags(text: str, breaks: bool, known: bool) -> str:
    """Inline tags join, block tags break the line (or are a blank, without ``breaks``), others are a blank.

    With ``known`` only elements of HTML are tags.
    """
    line = "\n" if breaks else " "

    def instead(m: regex.Match) -> str:
        name = (m.group(1) or "").lower()
        return "" if name in INLINE else line if name in BLOCK else m.group() if known else " "

    return TAG.sub(instead, text)


def plain(text: str, breaks: bool = False) -> str:
    """Text without invisible characters, markup and entities, accents composed.

    Invisible characters go first, as they may lie inside a tag or an entity.
    Tags are cut, entities undone until none is left, and what that turned
    into tags is cut where it names an element of HTML ("x &lt; y" stays).
    """
    clear = text if text.isascii() else INVISIBLE.sub("", text)
    if "<" in clear:
        clear = without_tags(without_comments(clear), breaks, False)
    if "&" in clear:
        before = None
        while clear != before and "&" in clear:
            before = clear
            clear = INVISIBLE.sub("", html.unescape(NESTED.sub("&", clear)))
        if "<" in clear:
            clear = without_tags(without_comments(clear), breaks, True)
    return clear if clear.isascii() else unicodedata.normalize("NFKC", ALONE.sub(" ", clear))


def words(text: str) -> list[str]:
    """Runs of letters and digits in one spelling."""
    clear = plain(text).casefold()
    return WORD.findall(clear if clear.isascii() else unicodedata.normalize("NFKC", clear))


def spread(documents: DataFrame) -> DataFrame:
    """The rows in as many tasks as run at once.

    Texts cost far more to work through than to move, and a small table is a
    single file.  Tables read in that many tasks anyway are never shuffled.
    """
    n = documents.sparkSession.sparkContext.defaultParallelism
    return documents if documents.rdd.getNumPartitions() >= n else documents.repartition(n)
