"""Problem 8: reading level of each document.

Method: five classic formulas over sentence length, word length and syllables,
the syllables counted by hyphenation-style rules, combined by the median of
the grades they give.  The language, which the grades rest on, comes from a
model of letter triples trained on the rows that name theirs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.text import plain, spread
from furrow.session import Scratch

# Three-letter codes of languages and the two letters that say the same.
CODES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl"}
# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = set(
    "mr mrs ms dr prof st sr jr nos figs tabs vol vols ed eds pp etc vs cf ca approx dept inc ltd corp temp avg hrs secs lbs oz ft cm mm kg ml jan feb apr aug sept oct nov tues thu thur thurs e.g i.e a.m p.m u.s esp viz resp spp sp var cv subsp incl excl ref refs ch eq".split()
)
# Abbreviations that are words as well; a number must follow.
BEFORE_NUMBERS = set("no fig tab sec min max dec mar jun jul sep sat sun mon tue wed fri est p art app".split())
NAME = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
JOINTS = re.compile(r"['’-]")
END = re.compile(r"[.!?…]+(?=[\"'”’)\]]*(?:\s|$))")

VOWELS = "aeiouy"
GROUPS = re.compile(r"[aeiouy]+")
#: Two vowels that hyphenation separates, and endings that sound as one syllable less.
HIATUS = re.compile(
    r"i[ao](?!u)(?<![cstgx]io(?=n))(?<![ctg]ia(?=[ln]))|iu|(?<![gp])eo(?!u)|(?<=cr)ea(?=t)|(?<=id)ea$|(?<=ar)ea$|(?<![qg])ua|uou|ying|oa[^lbdtkstr]|[^aeiouq]ue[lnst]t?$"
)
SILENT = re.compile(r"(?<=[^aeiouy])e$|(?<=[^aeiouytd])ed$|(?<=[^aeiouysxzcg])es$|(?<=[^aeiouy])e(?=ly$|ment|ful|less|ness)")
LE_END = re.compile(r"[^aeiouyl]les?$")


def syllables(word: str) -> int:
    """Syllables of a lower-case English word; at least one."""
    if len(word) <= 3:
        return 1
    n = len(GROUPS.findall(word)) + len(HIATUS.findall(word)) - len(SILENT.findall(word))
    if LE_END.search(word):
        n += 1
    return max(1, n)


@dataclass
class Languages:
    """Log-likelihood of each letter triple in each language; ``unseen`` is that of a triple a language never had."""

    names: list[str]
    triples: dict[str, tuple[float, ...]]
    unseen: tuple[float, ...]
    known: float = 0.5  # least share of a text's triples that its language must have had

    def scores(self, word: str) -> tuple[float, ...]:
        """Per language the word's log-likelihood, then the triples it had there, then the word's triples."""
        word = f" {word} "
        found = [self.triples.get(word[i : i + 3], self.unseen) for i in range(len(word) - 2)]
        each = range(len(self.names))
        return (*(sum(f[i] for f in found) for i in each), *(sum(f[i] > self.unseen[i] for f in found) for i in each), len(found))

    def of(self, words: Iterable[str], scores: Callable[[str], tuple]) -> str | None:
        """The likeliest language of the different words (ties: the first by name); None without words or where most triples are foreign to it."""
        n = len(self.names)
        total = [sum(column) for column in zip(*map(scores, words))] if n else []
        if not total:
            return None
        best = max(range(n), key=total.__getitem__)
        return self.names[best] if total[n + best] >= self.known * total[-1] else None


def _having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each code that have a word."""
    for batch in batches:
        seen: Counter = Counter()
        for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.update((code, word) for word in set(NAME.findall(plain(text).lower())))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["code", "word", "n"])


def mislabelled(words: Iterable[str], code: str, having: dict[str, dict[str, int]]) -> bool:
    """Whether the other rows say that most of a row's different words belong to one other code; a word votes by the rows that have it."""
    votes: Counter = Counter()
    n = 0
    for word in words:
        n += 1
        others = {c: k - (c == code) for c, k in having.get(word, {}).items()}
        total = sum(others.values())
        for c, k in others.items() if total else ():
            votes[c] += k / total
    return any(v > n / 2 for c, v in votes.items() if c != code)


def _triples(having: dict[str, dict[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(NAME.findall(plain(text).lower()))
                if mislabelled(words, code, having):
                    continue
                seen[code, ""] += 1  # the rows of the language
                for word, k in words.items():
                    seen[code, f"={word}"] += k  # no triple has this sign
                    word = f" {word} "
                    for i in range(len(word) - 2):
                        seen[code, word[i : i + 3]] += k
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["code", "triple", "n"])

    return run


def _alike(a: dict[str, int], b: dict[str, int]) -> float:
    """Cosine of two languages' word counts."""
    return sum(n * b.get(w, 0) for w, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()) or 1)


def fit_languages(documents: DataFrame, lang: str = "lang", sample: int = 1500, least: int = 8, triples: int = 5000, known: float = 0.5, same: float = 0.6, seed: int = 3) -> Languages:
    """Model of the languages that ``lang`` names, in two- or three-letter codes with or without a region.

    Fitted on the labelled ones, as whole texts, of about ``sample`` rows drawn
    by hash.  Rows most of whose words are those of another language's rows are
    wrong labels and left out: a few of them, in a language of few rows, would
    draw all texts of their kind there.  Languages with fewer than ``least``
    rows are left out, and each keeps its ``triples`` most frequent letter
    triples (and words, while rows are judged).  A code whose words are as frequent as those of a code with
    more text (cosine from ``same``) is a wrong label of that language and left
    out, else texts of a kind that is often labelled wrong would be a language
    of their own.  Without the column, or without such rows, the model knows
    no language.
    """
    if lang not in documents.columns:
        return Languages([], {}, ())
    code = F.regexp_extract(F.lower("lang"), "^[^a-z]*([a-z]{2,3})(?:[^a-z].*)?$", 1)
    short = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    rows = documents.select(F.col(lang).cast("string").alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL").select(code.alias("code"), "text")
    rows = rows.select(F.coalesce(F.try_element_at(short, "code"), "code").alias("code"), "text").where("length(code) = 2")
    share = min(1.0, sample / max(1, documents.count()))
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 12) < F.lit(int(share * (1 << 52))))
    scratch = Scratch(documents.sparkSession)
    drawn = scratch.save(drawn)
    common = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "word"))
    known_to = spread(drawn).mapInArrow(_having, "code string, word string, n bigint").groupBy("code", "word").agg(F.sum("n").alias("n"))
    having: dict[str, dict[str, int]] = {}
    for r in known_to.withColumn("place", common).where(F.col("place") <= triples).collect():
        having.setdefault(r.word, {})[r.code] = r.n
    per = spread(drawn).mapInArrow(_triples(having), "code string, triple string, n bigint").groupBy("code", "triple").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("code", F.startswith("triple", F.lit("="))).orderBy(F.col("triple") != "", F.desc("n"), "triple"))
    found = per.withColumn("place", place).where(F.col("place") <= triples + 1).collect()
    scratch.drop(drawn)
    names = sorted(r.code for r in found if r.triple == "" and r.n >= least)
    counts: dict[str, dict[str, int]] = {c: {} for c in names}
    words: dict[str, dict[str, int]] = {c: {} for c in names}
    for r in found:
        if r.code in counts and r.triple:
            (words if r.triple[0] == "=" else counts)[r.code][r.triple] = r.n
    total = {c: sum(counts[c].values()) for c in names}
    kept: list[str] = []
    for c in sorted(names, key=lambda c: (-total[c], c)):
        if total[c] and all(_alike(words[c], words[k]) < same for k in kept):
            kept.append(c)
    names = sorted(kept)
    every = {t for c in names for t in counts[c]}
    total = {c: total[c] + 0.5 * len(every) for c in names}
    model = {t: tuple(math.log((counts[c].get(t, 0) + 0.5) / total[c]) for c in names) for t in every}
    return Languages(names, model, tuple(math.log(0.5 / total[c]) for c in names), known)


@lru_cache(maxsize=1 << 17)
def measures(word: str) -> tuple[int, int]:
    """(syllables, letters) of a word; the parts of a compound count each."""
    return sum(syllables(x) for x in JOINTS.split(word) if x), sum(map(str.isalpha, word))


def sentences(text: str) -> list[str]:
    """Pieces between line breaks and sentence ends; dots of abbreviations, initials and numbers end none."""
    out = []
    for line in re.split(r"[\n\r  \x0b\x0c]+", text):
        start = 0
        for m in END.finditer(line):
            if m.group() == ".":
                before = line[start : m.start()].rsplit(None, 1)
                token = before[-1].lower().strip("(\"'[“‘") if before and not line[m.start() - 1].isspace() else ""
                after = line[m.end() : m.end() + 3].lstrip()
                if token in ABBREVIATIONS and after or token in BEFORE_NUMBERS and after[:1].isdigit() or len(token) == 1 and token.isalpha() and token != "i" and after:
                    continue
            out.append(line[start : m.end()])
            start = m.end()
        out.append(line[start:])
    return [s for s in out if NAME.search(s) or re.search(r"\d", s)]


def grades(text: str, languages: Languages, scores=None) -> tuple[str | None, int, int, float | None, list[float]]:
    """(language, sentences, words, median grade, each grade) of a raw text."""
    clear = plain(text, breaks=True)
    parts = sentences(clear)
    counts = Counter(NAME.findall(clear.lower()))
    n_sent, n_words = len(parts), counts.total()
    lang = languages.of(counts, scores or languages.scores)
    if not n_words or not n_sent:
        return lang, n_sent, n_words, None, []
    syl = hard = letters = 0
    for w, n in counts.items():
        s, size = measures(w)
        syl += s * n
        letters += n * size
        hard += n * (s >= 3)
    per_sentence = n_words / n_sent
    flesch = 0.39 * per_sentence + 11.8 * syl / n_words - 15.59
    fog = 0.4 * (per_sentence + 100 * hard / n_words)
    smog = 1.043 * (30 * hard / n_sent) ** 0.5 + 3.1291
    coleman = 5.88 * letters / n_words - 29.6 * n_sent / n_words - 15.8
    automated = 4.71 * letters / n_words + 0.5 * per_sentence - 21.43
    each = [flesch, fog, smog, coleman, automated]
    return lang, n_sent, n_words, median(each), each


FORMULAS = ["flesch_kincaid", "gunning_fog", "smog", "coleman_liau", "automated"]
SCHEMA = "doc_id bigint, language string, n_sentences int, n_words int, grade double, " + ", ".join(f"{f} double" for f in FORMULAS)


def _measurer(languages: Languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = lru_cache(maxsize=1 << 17)(languages.scores)
        for batch in batches:
            rows = [grades(t or "", languages, scores) for t in batch.column(1).to_pylist()]
            each = [r[4] or [None] * len(FORMULAS) for r in rows]
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.float64())]
            columns += [pa.array([e[i] for e in each], pa.float64()) for i in range(len(FORMULAS))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "language", "n_sentences", "n_words", "grade", *FORMULAS])

    return run


def reading_levels(documents: DataFrame, languages: Languages | None = None) -> DataFrame:
    """One row a document: language, counts, the median grade and each formula's grade.

    ``languages`` is fitted on the documents' own ``lang`` column where none
    is given.  Grades are years of schooling and rest on English spelling;
    filter on ``language`` before use.  NULL, blank and word-less texts get a
    NULL grade and language; so does the language of texts that resemble none
    of the known ones.  Narrow: no shuffle, one pass over whole texts in Arrow
    batches; repeated ids repeat.
    """
    languages = languages or fit_languages(documents)
    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(_measurer(languages), SCHEMA)


def demanding(levels: DataFrame, least: float = 16.0) -> DataFrame:
    """(doc_id) of English documents that need ``least`` years of schooling or more."""
    return levels.where((F.col("language") == "en") & (F.col("grade") >= least)).select("doc_id").distinct()


def level_profile(levels: DataFrame, width: float = 2.0) -> DataFrame:
    """Documents and words by language and band of grades (floor of a multiple of ``width``)."""
    band = (F.floor(F.col("grade") / width) * width).alias("band")
    return levels.groupBy("language", band).agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


def rated(levels: DataFrame, labels: DataFrame) -> DataFrame:
    """(read_level, n_docs, mean_grade, mean_rank): the grades of English documents that raters put on each level.

    A document's level is the median of its different ratings, rounded up.
    ``mean_rank`` is the share of all rated documents with a lower grade
    (equal ones half), from a histogram of grades to a tenth.
    """
    given = labels.where("doc_id IS NOT NULL AND read_level IS NOT NULL").select("doc_id", "rater", "read_level").distinct()
    middle = given.groupBy("doc_id").agg(F.ceil(F.percentile("read_level", 0.5)).cast("int").alias("read_level"))
    english = levels.where("language = 'en' AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    cells = english.join(middle, "doc_id").groupBy("read_level", F.round("grade", 1).alias("g")).agg(F.count("*").alias("n"), F.sum("grade").alias("s"))
    at = cells.groupBy("g").agg(F.sum("n").alias("m"))
    whole = Window.partitionBy(F.lit(1))
    at = at.select("g", ((F.sum("m").over(whole.orderBy("g")) - F.col("m") / 2) / F.sum("m").over(whole)).alias("r"))
    return cells.join(at, "g").groupBy("read_level").agg(
        F.sum("n").alias("n_docs"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean_grade"), F.round(F.sum(F.col("r") * F.col("n")) / F.sum("n"), 4).alias("mean_rank")
    )
