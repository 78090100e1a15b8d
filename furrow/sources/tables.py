"""Readers of the curated tables, one row per record and cells in one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table (file or folder) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the manifest.

    Later deliveries repeat a record, so rows equal but for ``batch_no`` and
    ``added_at`` count once; should a path ever carry different cells, the
    row smallest in column order is kept.  Rows without a path are no records.
    Columns: path, final_class, source_folder, split, is_copy, hash.
    """
    return records(table(spark, sf_dir, "manifest"))


def records(raw: DataFrame) -> DataFrame:
    cells = raw.where(F.col("path").isNotNull()).select(
        "path",
        F.struct(
            clean.class_name("final_class").alias("final_class"),
            F.col("source_folder"),
            clean.split_name("split").alias("split"),
            (clean.says_true("is_dup_copy") | clean.filled("dup_source")).alias("is_copy"),
            clean.hash64("dhash").alias("hash"),
        ).alias("cells"),
    )
    return cells.groupBy("path").agg(F.min("cells").alias("cells")).select("path", "cells.*")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows, repeated ones once, classes in one spelling.

    Columns: run_tag, path, true_class, pred, studio (BOOLEAN, NULL when not
    said), confidence.  Rows without a true or predicted class are kept with
    NULL; metrics leave them out.
    """
    raw = table(spark, sf_dir, "predictions")
    said = F.when(clean.filled("is_plantvillage"), clean.says_true("is_plantvillage"))
    return raw.select(
        "run_tag", "path", clean.class_name("true_class").alias("true_class"), clean.class_name("pred").alias("pred"), said.alias("studio"),
        F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"),
    ).distinct()


def filter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name, p, bucket): repeated rows once, the stored bucket in one spelling."""
    raw = table(spark, sf_dir, "filter_scores")
    return raw.select("path", "name", F.col("p_strawberry").alias("p"), clean.class_name("bucket").alias("bucket")).distinct()


def disease_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge-base entries; keys that start with an underscore are notes and no entries."""
    return table(spark, sf_dir, "disease_info").where(~F.col("class_key").startswith("_"))


def vectors(spark: SparkSession, sf_dir: str, dim: int = 50) -> DataFrame:
    """(vec_id, label, x) of usable feature rows: ``dim`` finite entries, a label, one row an id (the smallest)."""
    x = F.col("x")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    raw = table(spark, sf_dir, "features").where(F.col("vec_id").isNotNull() & (F.size(x) == dim) & finite)
    labelled = raw.select("vec_id", F.struct(clean.class_name("y").alias("label"), "x").alias("r")).where("r.label IS NOT NULL")
    return labelled.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.x")
