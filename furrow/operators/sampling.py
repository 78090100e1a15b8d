"""Deterministic sampling, splitting and ranking (WIN03-WIN09, SPL01-SPL04).

A row's place in its group comes from the md5 of its id and a seed, so the
result depends on neither partitioning nor retries.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import Scratch

#: Clusters of one size whose splits are dealt in one row.
DEALT = 1024


def shuffled(col: str | Column, seed: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def ranked(df: DataFrame, keys: list[str], id_col: str, seed: int) -> DataFrame:
    """df with ``rank`` (from 1) and ``size`` of its group, without a task that holds a whole group.

    The md5's first two digits split a group into 256 lanes; rows are ranked
    within a lane and offset by the lanes before, whose counts are aggregated
    map-side.  A group of a third of all rows is thus ranked in 256 tasks.
    """
    order = shuffled(id_col, seed)
    laned = df.withColumn("_o", order).withColumn("_lane", F.conv(F.substring("_o", 1, 2), 16, 10).cast("int"))
    safe = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    laned = laned.select("*", *safe)
    counts = laned.groupBy(*names, "_lane").agg(F.count("*").alias("_n"))
    by_group = Window.partitionBy(*names)
    offsets = counts.select(*names, "_lane", (F.sum("_n").over(by_group.orderBy("_lane")) - F.col("_n")).alias("_before"), F.sum("_n").over(by_group).alias("size"))
    inside = Window.partitionBy(*names, "_lane").orderBy("_o", id_col)
    out = laned.withColumn("_r", F.row_number().over(inside)).join(offsets, [*names, "_lane"])
    return out.withColumn("rank", F.col("_r") + F.col("_before")).drop("_o", "_lane", "_r", "_before", *names)


def placed(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """df with ``place`` (from 1) in its group by ``order``, ascending, NULL first; no task holds a whole group.

    Rows are cut into ranges of (keys, order), of even size; they are ranked
    within a range and offset by the counts of the group's ranges before.
    ``order`` should tell all rows apart, else equal ones are ordered anyhow.
    """
    scratch = scratch or Scratch(df.sparkSession)
    cut = scratch.save(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    safe = [F.struct(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    cut = cut.select("*", *safe)
    counts = cut.groupBy(*names, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_part")) - F.col("_n")
    offsets = counts.select(*names, "_part", before.alias("_before"))
    inside = Window.partitionBy(*names, "_part").orderBy(*order)
    out = cut.withColumn("_r", F.row_number().over(inside)).join(offsets, [*names, "_part"])
    return out.withColumn("place", F.col("_r") + F.col("_before")).drop("_part", "_r", "_before", *names)


def two_way(df: DataFrame, label: str, id_col: str, fraction: float, seed: int) -> DataFrame:
    """SPL01: stratified train and test; a class gives max(1, min(n - 1, floor(f n))) rows to train."""
    n = F.greatest(F.lit(1), F.least(F.col("size") - 1, F.floor(F.col("size") * fraction)))
    return ranked(df, [label], id_col, seed).withColumn("split", F.when(F.col("rank") <= n, "train").otherwise("test")).drop("rank", "size")


def three_way(df: DataFrame, label: str, id_col: str, seed: int, val: float = 0.2, test: float = 0.1) -> DataFrame:
    """SPL02: train, then val, then test by rank; val and test get max(2, round half even), shrunk so train keeps one."""
    n = F.col("size")
    want_test = F.greatest(F.lit(2), F.bround(n * F.lit(test)).cast("bigint"))
    want_val = F.greatest(F.lit(2), F.bround(n * F.lit(val)).cast("bigint"))
    n_val = F.greatest(F.lit(0), F.least(want_val, n - 1 - want_test))
    n_test = F.greatest(F.lit(0), F.least(want_test, n - 1 - n_val))
    split = F.when(F.col("rank") <= n - n_val - n_test, "train").when(F.col("rank") <= n - n_test, "val").otherwise("test")
    return ranked(df, [label], id_col, seed).withColumn("split", split).drop("rank", "size")


def holdout(df: DataFrame, id_col: str, share: float, seed: int) -> DataFrame:
    """SPL03: each row by itself, by the first eight hexadecimal digits of its md5."""
    u = F.conv(F.substring(shuffled(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < share, "val").otherwise("train"))


def capped(df: DataFrame, label: str, id_col: str, most: int, seed: int) -> DataFrame:
    """WIN05: at most ``most`` rows of each class (the cap is the feature)."""
    w = Window.partitionBy(label).orderBy(shuffled(id_col, seed), id_col)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def class_quota(df: DataFrame, label: str, id_col: str, target: int, seed: int) -> DataFrame:
    """AGG34: target // classes rows of each class."""
    n = df.agg(F.count_distinct(label)).first()[0]
    return capped(df, label, id_col, target // n if n else 0, seed)


def oversampled(df: DataFrame, label: str, id_col: str, least: int, seed: int) -> DataFrame:
    """WIN07: classes under ``least`` rows get copies of their rows in turn; copy 0 is the row itself."""
    r = ranked(df, [label], id_col, seed)
    need = F.greatest(F.lit(0), F.lit(least) - F.col("size"))
    mine = F.when(need >= F.col("rank"), F.floor((need - F.col("rank")) / F.col("size")) + 1).otherwise(0)
    copies = F.sequence(F.lit(0).cast("bigint"), mine.cast("bigint"))
    out = r.select("*", F.explode(copies).alias("turn"))
    number = F.when(F.col("turn") == 0, 0).otherwise((F.col("turn") - 1) * F.col("size") + F.col("rank"))
    return out.withColumn("copy_no", number).drop("rank", "size", "turn")


def paged(df: DataFrame, keys: list[str], id_col: str, per_page: int = 64, columns: int = 8) -> DataFrame:
    """WIN08: page, row and column of each item on numbered sheets."""
    out = placed(df, keys, [id_col]).withColumn("_i", F.col("place") - 1)
    return out.withColumn("page", F.floor(F.col("_i") / per_page)).withColumn("line", F.floor(F.col("_i") % per_page / columns)).withColumn("place", F.col("_i") % columns).drop("_i")


def greedy_cluster_split(clusters: DataFrame, targets: dict[str, float], seed: int) -> DataFrame:
    """WIN09, SPL04: whole clusters to the split furthest behind its target, largest cluster first.

    ``clusters``: label, cluster, n.  The fold is sequential in a class, so
    equal steps are taken together: clusters are folded as a histogram of
    sizes, whose entries are few (their sum bounds their number by a square
    root), each entry dealt in turn; a cluster then finds its split by its
    rank among the clusters of its size, in the block of ``DEALT`` ranks that
    holds it: a join on equal keys, a row a cluster.
    """
    sizes = clusters.groupBy("label", "n").agg(F.count("*").alias("m"))
    names = list(targets)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        placed, got, rows = 0, [0] * len(names), []
        shares = [targets[s] for s in names]
        each = range(len(names))
        for n, m in sorted(zip(pdf.n.tolist(), pdf.m.tolist()), reverse=True):
            for block in range(0, m, DEALT):
                dealt = bytearray()
                for _ in range(min(DEALT, m - block)):
                    placed += n
                    best = max(each, key=[shares[s] * placed - got[s] for s in each].__getitem__)
                    got[best] += n
                    dealt.append(best)
                rows.append((pdf.label.iloc[0], n, block // DEALT, bytes(dealt)))
        return pd.DataFrame(rows, columns=["label", "n", "block", "dealt"])

    deal = sizes.groupBy("label").applyInPandas(fold, "label string, n bigint, block bigint, dealt binary")
    at = F.col("rank") - 1
    r = ranked(clusters, ["label", "n"], "cluster", seed).drop("size").withColumn("block", F.floor(at / DEALT))
    place = F.conv(F.hex(F.substring("dealt", (at % DEALT + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    split = F.get(F.array(*map(F.lit, names)), place)
    return r.join(deal, ["label", "n", "block"]).select("label", "cluster", "n", split.alias("split"))
