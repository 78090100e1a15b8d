"""Dataset audits: validation, split verification, served against stored results (QA02-QA04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import clean
from furrow.operators import joins


def validation(records: DataFrame) -> DataFrame:
    """QA02: one row a check: count_mismatch, name_leak, hash_leak, augmented_outside_train; with findings and verdict."""
    folder = records.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("split"), F.split_part("path", F.lit("/"), F.lit(2)).alias("final_class"))
    counts = joins.count_difference(records.select("split", "final_class"), folder, ["split", "final_class"])

    def torn(key) -> DataFrame:
        return records.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a != b")

    marked = records.where(F.lower(clean.stem("path")).rlike("_hard[0-9]+|__dup[0-9]+") & (F.col("split") != "train"))
    checks = {"count_mismatch": counts, "name_leak": torn(clean.base_name("path")), "hash_leak": torn(F.col("hash")), "augmented_outside_train": marked}
    out = None
    for name, found in checks.items():
        row = found.agg(F.count("*").alias("n_found")).select(F.lit(name).alias("check"), "n_found", (F.col("n_found") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def verification(before: DataFrame, after: DataFrame, members: DataFrame) -> DataFrame:
    """QA03: what a new split must keep: every path once, the classes' counts, no torn cluster.

    ``before`` and ``after`` hold path, final_class; ``members`` cluster, split.
    """
    lost = before.join(after.select("path"), "path", "left_anti").agg(F.count("*").alias("n_found")).select(F.lit("missing").alias("check"), "n_found")
    extra = after.join(before.select("path"), "path", "left_anti").agg(F.count("*").alias("n_found")).select(F.lit("unknown").alias("check"), "n_found")
    counts = joins.count_difference(before.select("final_class"), after.select("final_class"), ["final_class"]).agg(F.count("*").alias("n_found")).select(F.lit("class_counts").alias("check"), "n_found")
    torn = members.groupBy("cluster").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a != b").agg(F.count("*").alias("n_found")).select(F.lit("torn_clusters").alias("check"), "n_found")
    out = lost.unionByName(extra).unionByName(counts).unionByName(torn)
    return out.withColumn("passed", F.col("n_found") == 0)
