"""Row filters and column projections of dataset curation (FLT, PRJ).

All are narrow: they add no shuffle, and comparisons on stored columns reach
the scan.  Predicates on missing cells are FALSE unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import clean

KEEP_FROM, DROP_TO = 0.85, 0.15
LOW_CONFIDENCE, HIGH_UNCERTAINTY = 0.6, 0.5


def originals(df: DataFrame, split: str) -> DataFrame:
    """FLT01: rows of a split that say they are no copy."""
    return df.where((clean.split_name("split") == split) & clean.squeeze("is_dup_copy").isin("false", "0"))


def not_copies(df: DataFrame) -> DataFrame:
    """FLT02: rows that do not say they are a copy; blank and NULL stay."""
    return df.where(~clean.says_true("is_dup_copy"))


def unaugmented(df: DataFrame, mark: str = "_hard", col: str = "path") -> DataFrame:
    """FLT03: rows whose file stem does not hold the mark."""
    return df.where(~clean.stem(col).contains(mark))


def with_suffix(df: DataFrame, *suffixes: str, col: str = "path") -> DataFrame:
    """FLT04: rows whose lower-case path ends with one of the suffixes."""
    test = F.lit(False)
    for s in suffixes:
        test = test | F.endswith(F.lower(col), F.lit(s))
    return df.where(test)


def bucket(p: Column | str, keep: float = KEEP_FROM, drop: float = DROP_TO) -> Column:
    """FLT05: keep, drop or uncertain; both bounds inclusive; NULL and NaN give NULL."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p.isNull() | F.isnan(p), None).when(p >= keep, "keep").when(p <= drop, "drop").otherwise("uncertain")


def in_leaf_band(h: Column, s: Column, v: Column) -> Column:
    """FLT06: hue, saturation and value inside the plant band."""
    return h.between(0.05, 0.45) & (s >= 0.15) & (v >= 0.10)


def lesion(r: Column, b: Column, s: Column, v: Column) -> Column:
    """FLT07: pale coat, or a dull mid-bright spot with more red than blue."""
    return ((v > 0.60) & (s < 0.20)) | ((v > 0.30) & (v < 0.75) & (s < 0.32) & (r > b))


def low_confidence(conf: Column, spread: Column | None = None) -> Column:
    """FLT08, FLT14: confidence under 0.6 or, where given, uncertainty over 0.5."""
    low = conf < LOW_CONFIDENCE
    return low if spread is None else low | (spread > HIGH_UNCERTAINTY)


def upload_status(ready: Column, size: Column, kind: Column, side: Column, most: int = 10 * 1024 * 1024, least_side: int = 32) -> Column:
    """FLT09: the first rule an upload breaks, as a status number; 200 if none.

    ``kind`` is NULL when the bytes cannot be decoded.
    """
    return (
        F.when(~F.coalesce(ready, F.lit(False)), 503)
        .when(F.coalesce(size, F.lit(0)) == 0, 400)
        .when(size > most, 413)
        .when(kind.isNull(), 400)
        .when(~kind.isin("JPEG", "PNG", "WEBP"), 415)
        .when(side < least_side, 400)
        .otherwise(200)
    )


def misclassified(df: DataFrame, least: float | None = None) -> DataFrame:
    """FLT13: wrong predictions, with ``least`` only the confident ones."""
    wrong = df.where("pred != true_class")
    return wrong if least is None else wrong.where(F.col("confidence") >= least)


def check_split_parameters(fraction: float, k: int) -> None:
    """FLT15: refuse a share outside (0, 1) or fewer than one neighbour."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    if k < 1:
        raise ValueError("k must be at least 1")


def merged_label(col: str, members: list[str], name: str) -> Column:
    """PRJ01: several classes as one."""
    return F.when(F.col(col).isin(members), name).otherwise(F.col(col))


def studio_flag(col: str = "source_folder", prefix: str = "Strawberry___") -> Column:
    """PRJ02: struct of the flag and its evidence, from the folder's prefix."""
    flag = F.coalesce(F.col(col).startswith(prefix), F.lit(False))
    return F.struct(flag.alias("flag"), F.when(flag, "source_folder").otherwise("source_folder_not_pv").alias("evidence"))


def moved_path(split: Column, col: str = "path") -> Column:
    """PRJ03: the path below another split."""
    return F.concat_ws("/", split, F.regexp_replace(col, "^[^/]*/", ""))


def sibling_path(col: str, old: str, new: str) -> Column:
    """PRJ04: the path with its ending replaced."""
    return F.regexp_replace(col, old.replace(".", r"\.") + "$", new)


def wide_features(df: DataFrame, dim: int, col: str = "x") -> list[Column]:
    """PRJ05: Feature001, Feature002 ..."""
    return [F.get(F.col(col), F.lit(i)).alias(f"Feature{i + 1:03d}") for i in range(dim)]


def knowledge_card() -> Column:
    """PRJ06: an entry with a default for each field that is missing."""
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce("display_name", "class_key").alias("display_name"),
        F.coalesce("severity", F.lit("unknown")).alias("severity"),
        F.coalesce("symptoms", empty).alias("symptoms"),
        F.coalesce("treatment", empty).alias("treatment"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
    )


def message(low: Column, abstains: Column, thin: Column) -> Column:
    """PRJ07: the sentences that apply, joined by blanks; NULL if none does."""
    text = F.concat_ws(" ", F.when(low, "Low confidence: take another photo."), F.when(abstains, "The kind of rot cannot be told apart."), F.when(thin, "Few examples of this class."))
    return F.when(text != "", text)


def class_sources(df: DataFrame, key: str = "class_key", col: str = "symptoms") -> DataFrame:
    """PRJ08: one row for each entry of a list column; NULL and empty lists give none."""
    return df.select(key, F.posexplode(col).alias("at", "item"))
