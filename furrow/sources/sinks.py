"""Sinks (SNK01-SNK05, SNK09); all write in parallel and replace what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """SNK01: CSV with header; NULL as \\N, blanks kept as empty quotes."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "\\N").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)


def write_matrix(conf: DataFrame, path: str, classes: list[str]) -> None:
    """SNK02: the confusion counts as one headerless integer matrix in the order of ``classes`` (at most a line a class)."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("true_class"))
    every = conf.sparkSession.createDataFrame([(c,) for c in classes], "true_class string")
    wide = every.join(conf, "true_class", "left").groupBy("true_class").pivot("pred", classes).agg(F.sum("n")).fillna(0)
    wide.orderBy(place).select(*[F.col(c).cast("bigint") for c in classes]).coalesce(1).write.mode("overwrite").option("header", False).csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """SNK03: one nested JSON document a row."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_tree(df: DataFrame, path: str, *keys: str) -> None:
    """SNK05: a folder tree by the keys, one set of files a folder.

    Rows are clustered by the keys with the size of a partition left to
    adaptive execution, which splits a key that holds much of the table.
    """
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
