"""Exact k nearest neighbours of a stated query set, and votes (ML01-ML05, ML09).

Queries and items are packed into blocks, the query blocks, in passes of
bounded size, are broadcast to the item blocks, and a pair of blocks is one
matrix product that leaves k rows a query; those are merged by a grouped
top-k.  Items are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import stats

BLOCK = 4096
#: Bytes of query vectors that one pass over the items broadcasts.
PASS_BYTES = 64 << 20


def _packer(dim: int, size: int):
    """(ids, labels, matrix) blocks of at most ``size`` rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(rows: pa.Table) -> pa.RecordBatch:
            x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_pydict({"ids": [rows["id"].to_numpy().tobytes()], "labels": [rows["label"].to_pylist()], "m": [x.tobytes()]})

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, size))
                held, n = rows.slice(size).to_batches(), n - size
        if n:
            yield out(pa.Table.from_batches(held))

    return run


def _matcher(dim: int, k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.to_pylist():
                qi, ti = np.frombuffer(q["q_ids"], np.int64), np.frombuffer(q["ids"], np.int64)
                a, b = np.frombuffer(q["q_m"]).reshape(-1, dim), np.frombuffer(q["m"]).reshape(-1, dim)
                if metric == "cosine":
                    a, b = (z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12) for z in (a, b))
                    d = -(a @ b.T)
                else:
                    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
                kk = min(k, len(ti))
                # Everything as near as the k-th, with room for rounding, then the exact order of those.
                edge = np.partition(d, kk - 1, axis=1)[:, kk - 1 : kk]
                i, j = np.nonzero(d <= edge + 1e-9 * (1 + np.abs(edge)))
                e = d[i, j] if metric == "cosine" else ((a[i] - b[j]) ** 2).sum(1)
                o = np.lexsort((ti[j], e, i))
                i, j, e = i[o], j[o], e[o]
                _, first, counts = np.unique(i, return_index=True, return_counts=True)
                keep = np.arange(len(i)) - np.repeat(first, counts) < kk
                i, j, e = i[keep], j[keep], e[keep]
                labels, names = q["labels"], q["q_labels"]
                yield pa.RecordBatch.from_pydict({"id": qi[i], "label": [names[x] for x in i], "near_id": ti[j], "near_label": [labels[x] for x in j], "dist": e})

    return run


def nearest(queries: DataFrame, items: DataFrame, dim: int, k: int, metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """id, label, near_id, near_label, dist, rank: the k nearest items of each query, ties to the smaller id.

    Both sides have id, label and x of ``dim`` finite doubles.  ``dist`` is the
    squared straight-line distance or, for ``cosine``, minus the similarity.
    """
    packed = "ids binary, labels array<string>, m binary"
    cols = lambda df: df.select(F.col("id").cast("bigint").alias("id"), "label", F.col("x").cast("array<double>").alias("x"))
    t = cols(items).mapInArrow(_packer(dim, block), packed).withColumn("on", F.lit(0))
    passes = max(1, -(-queries.count() * dim * 8 // PASS_BYTES))
    found = None
    for i in range(passes):
        q = cols(queries)
        if passes > 1:
            q = q.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i)
        q = q.coalesce(4).mapInArrow(_packer(dim, block), packed).select(F.col("ids").alias("q_ids"), F.col("labels").alias("q_labels"), F.col("m").alias("q_m"), F.lit(0).alias("on"))
        # The query blocks of this pass, of bounded size, meet every item block where that lies.
        got = t.join(F.broadcast(q), "on").drop("on").mapInArrow(_matcher(dim, k, metric), "id bigint, label string, near_id bigint, near_label string, dist double")
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("id").orderBy("dist", "near_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scaled(df: DataFrame, fit: DataFrame, vec: str = "x") -> DataFrame:
    """Vectors with each entry's mean taken off, in units of its std; ``fit`` is a row a dimension."""
    line = fit.agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "std"))).alias("_f"))
    z = F.zip_with(vec, "_f", lambda v, f: (v - f["mean"]) / f["std"])
    return df.join(F.broadcast(line)).withColumn(vec, z).drop("_f")


def majority(near: DataFrame, k: int, tie: str = "nearest") -> DataFrame:
    """ML01 (``tie`` = name), ML02 (``tie`` = nearest): id, label, pred, votes."""
    votes = near.where(F.col("rank") <= k).groupBy("id", "label", "near_label").agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    order = [F.desc("votes"), "near_label"] if tie == "name" else [F.desc("votes"), "first"]
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("r = 1")
    return best.select("id", "label", F.col("near_label").alias("pred"), "votes")


def cosine_weighted(near: DataFrame, k: int) -> DataFrame:
    """ML03: each neighbour votes with its similarity, none below 0; ties to the first class."""
    w = F.round(F.sum(F.greatest(-F.col("dist"), F.lit(0.0))), 9).alias("weight")
    votes = near.where(F.col("rank") <= k).groupBy("id", "label", "near_label").agg(w)
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "near_label"))).where("r = 1")
    return best.select("id", "label", F.col("near_label").alias("pred"), "weight")


def knn_evaluation(rows: DataFrame, dim: int, k: int, every: int = 50) -> DataFrame:
    """ML09: queries are the ids divisible by ``every``; vectors are scaled by the others; predictions by majority."""
    held = F.pmod("id", F.lit(every)) == 0
    train, test = rows.where(~held), rows.where(held)
    fit = stats.zscore_fit(train)
    return majority(nearest(scaled(test, fit), scaled(train, fit), dim, k), k)


def k_sweep(near: DataFrame, ks: list[int]) -> DataFrame:
    """ML05: predictions for each k from neighbours that were ranked once."""
    spread = near.join(F.broadcast(near.sparkSession.createDataFrame([(k,) for k in ks], "k int")), F.col("rank") <= F.col("k"))
    votes = spread.groupBy("k", "id", "label", "near_label").agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("k", "id").orderBy(F.desc("votes"), "first"))).where("r = 1")
    return best.select("k", "id", "label", F.col("near_label").alias("pred"))


