"""Column expressions that undo the spellings found in curated tables.

All are built-in expressions: they stay inside whole-stage code generation and
give NULL for NULL input unless stated otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every kind, no-break and zero-width ones included.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\v\f\r\u200b" or unicodedata.category(c)[0] == "Z") + "\ufeff"
# The words that name each split.
SPLIT_WORDS = {
    "train": ["train", "training"],
    "val": ["val", "valid", "validation"],
    "test": ["test", "testing"],
}
# The words that say true.
TRUE_WORDS = ["true", "t", "1", "yes", "y"]


def squeeze(col: Column | str) -> Column:
    """Lower case without white space at either end."""
    return F.lower(F.btrim(col, F.lit(BLANKS)))


def split_name(col: Column | str) -> Column:
    """train, val or test; NULL for a missing or unknown word."""
    word = squeeze(col)
    out = F.lit(None).cast("string")
    for name, words in SPLIT_WORDS.items():
        out = F.when(word.isin(words), name).otherwise(out)
    return out


def class_name(col: Column | str) -> Column:
    """Lower-case words joined by one underscore; NULL when nothing is left."""
    word = F.translate(squeeze(col), BLANKS + "-", "_" * (len(BLANKS) + 1))
    word = F.when(F.contains(word, F.lit("__")), F.regexp_replace(word, "__+", "_")).otherwise(word)
    return F.when(word != "", word)


def says_true(col: Column | str) -> Column:
    """TRUE for any spelling of true, otherwise FALSE (also for NULL and blank)."""
    return F.coalesce(squeeze(col).isin(TRUE_WORDS), F.lit(False))


def filled(col: Column | str) -> Column:
    """TRUE if the cell holds more than white space."""
    return F.coalesce(squeeze(col) != "", F.lit(False))


def hash64(col: Column | str) -> Column:
    """The signed 64-bit number that hexadecimal digits spell.

    Case, a 0x prefix, separators, blanks and lost leading zeros make no
    difference; a cell that spells no number of at most 16 digits gives NULL.
    """
    digits = F.translate(F.lower(col), BLANKS + ":_.,-", "")
    digits = F.when(F.startswith(digits, F.lit("0x")), F.substring(digits, 3, 1 << 30)).otherwise(digits)
    spells = F.length(digits).between(1, 16) & (F.translate(digits, "0123456789abcdef", "") == "")
    return F.when(spells, F.conv(digits, 16, -10).cast("bigint"))


def plain_path(col: Column | str) -> Column:
    """A relative path with forward slashes, without leading ./ and outer blanks."""
    slashed = F.translate(F.btrim(col, F.lit(BLANKS)), "\\", "/")
    return F.when(F.startswith(slashed, F.lit("./")), F.regexp_replace(slashed, r"^(\./+)+", "")).otherwise(slashed)


def base_name(col: Column | str) -> Column:
    """The part after the last slash (either kind)."""
    return F.substring_index(F.translate(col, "\\", "/"), "/", -1)


def stem(col: Column | str) -> Column:
    """File name without its extension."""
    name = base_name(col)
    return F.when(F.contains(name, F.lit(".")), F.left(name, F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)).otherwise(name)


def photo_key(col: Column | str) -> Column:
    """Lower-case stem without the marks _hardN and __dupN at its end."""
    name = F.lower(stem(col))
    marked = F.contains(name, F.lit("_hard")) | F.contains(name, F.lit("__dup"))
    return F.when(marked, F.regexp_replace(name, r"(_hard[0-9]+|__dup[0-9]+)+$", "")).otherwise(name)


def hamming64(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two 64-bit numbers."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))
