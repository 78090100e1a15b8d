"""Join-shaped operators of dataset curation (JOI).

Equi-joins are left to Catalyst and adaptive execution, which broadcast a
side only where its size is known to be small; semi- and anti-joins are used
where no column of the other side is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import clean


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """JOI02, QA04: photographs on whose class two prediction tables differ; joined on the file name."""
    left = a.select(clean.base_name("path").alias("file"), F.col("pred").alias("pred_a")).where("pred_a IS NOT NULL").distinct()
    right = b.select(clean.base_name("path").alias("file"), F.col("pred").alias("pred_b")).where("pred_b IS NOT NULL").distinct()
    return left.join(right, "file").where("pred_a != pred_b")


def with_default(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, defaults: dict[str, str]) -> DataFrame:
    """JOI06: a dimension's columns, with a default where the key is unknown."""
    cols = dim.select(F.col(dim_key).alias("_k"), *defaults)
    out = facts.join(cols, facts[key] == F.col("_k"), "left").drop("_k")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def parent_check(copies: DataFrame, parents: DataFrame) -> DataFrame:
    """JOI07, GRF05: each copy with the split of its parent photograph.

    ``copies`` holds path, split, parent; ``parents`` name, split.  status is
    ok, elsewhere (the parent lies in another split) or orphan.
    """
    p = parents.groupBy(F.col("name").alias("parent")).agg(F.min("split").alias("lowest"), F.max("split").alias("highest"), F.count("*").alias("n_parents"))
    out = copies.join(p, "parent", "left")
    inside = (F.col("lowest") == F.col("split")) | (F.col("highest") == F.col("split"))
    status = F.when(F.col("n_parents").isNull(), "orphan").when(F.coalesce(inside, F.lit(False)), "ok").otherwise("elsewhere")
    return out.select("path", "parent", "split", status.alias("status"))


def count_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """JOI12: groups whose number of rows differs between two tables; a missing group counts 0.  NULL keys are a group."""
    tagged = a.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return tagged.groupBy(*keys).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")).where("n_a != n_b")


def contaminated(members: DataFrame, cluster: str, victim: Column, source: Column) -> DataFrame:
    """JOI14: rows that satisfy ``victim`` in a cluster where some row satisfies ``source``.

    The clusters are found by a partial aggregate, so a cluster that a third
    of all rows belong to is never brought together.
    """
    hit = members.groupBy(cluster).agg(F.max(source.cast("int")).alias("_s"), F.max(victim.cast("int")).alias("_v")).where("_s = 1 AND _v = 1").select(cluster)
    return members.where(victim).join(hit, cluster, "left_semi")


def inside_rival_range(rows: DataFrame, ranges: DataFrame, dims: int) -> DataFrame:
    """JOI15, FLT12: rows all of whose ``dims`` chosen features lie in the rival's closed quartile range.

    ``rows``: vec_id, label, x; ``ranges``: class, rival, dim, r25, r75 (a few
    rows a class, joined by class and compared as one array a row).
    """
    boxes = ranges.groupBy("class", "rival").agg(F.collect_list(F.struct("dim", "r25", "r75")).alias("box")).where(F.size("box") == dims)
    inside = F.forall("box", lambda b: F.get("x", b["dim"]).between(b["r25"], b["r75"]))
    return rows.join(boxes, rows.label == F.col("class")).where(inside).select("vec_id", "label", "rival")


def latest(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The row of the highest sequence number of each key (ties: any column order settles them by value)."""
    rest = [c for c in df.columns if c not in (key, sequence)]
    top = F.max(F.struct(sequence, *rest)).alias("_t")
    return df.groupBy(key).agg(top).select(key, "_t.*")


def ordinal(df: DataFrame, col: str, name: str = "ordinal") -> DataFrame:
    """JOI16: 0-based place of each class among the sorted classes; the class dimension is small."""
    dim = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn(name, F.row_number().over(Window.orderBy(col)) - 1)
    return df.join(dim, col, "left")
