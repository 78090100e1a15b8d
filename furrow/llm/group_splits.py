"""Problem 4: splits that keep related records together.

Method: largest-differencing balance.  After components, the two partial
partitions of extreme weight spread are combined again and again, heaviest
bins against lightest, until one partition into many equal bins is left; whole
bins are then allocated to splits by target proportion.

Differencing is sequential, so it runs on shards: within a class the
components are dealt to shards of bounded size, each shard differences its own
components, and the bins of all shards are allocated against the totals of
the whole class, as a histogram of bin weights.  A component belongs to the
class most of its records have.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.components import connected_components
from furrow.llm.near_hash import near_hashes
from furrow.session import Scratch


def scene_groups(records: DataFrame, k: int, scratch: Scratch | None = None) -> DataFrame:
    """path, final_class, split, hash and ``scene``: records within k bits of each other, or joined by a chain of such steps, share it.

    Works on distinct hashes: copies cost nothing.  Records without hash get
    a scene of their own, named by the path.
    """
    scratch = scratch or Scratch(records.sparkSession)
    rows = scratch.save(records.select("path", "final_class", "split", "hash"))
    edges = near_hashes(rows, None, k, scratch).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = connected_components(edges, scratch=scratch)
    near = F.coalesce("component", "hash")
    scene = F.when(near.isNotNull(), F.concat(F.lit("#"), F.hex(near))).otherwise(F.concat(F.lit("/"), F.col("path")))
    return rows.join(found, rows.hash == found.vertex, "left").select(*rows.columns, scene.alias("scene"))


def straddling(grouped: DataFrame) -> DataFrame:
    """(path) of each record whose scene lies in more than one split; records without split count as members only."""
    torn = grouped.groupBy("scene").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a != b").select("scene")
    return grouped.join(torn, "scene", "left_semi").select("path")


def difference(weights: list[int], bins: int) -> list[list[int]]:
    """Partition item numbers into ``bins`` lists of nearly equal weight by largest differencing.

    Every item starts as a partition with one filled bin.  The two partitions
    of the largest spread merge, the heaviest bin of one with the lightest of
    the other, until one is left.
    """
    if not weights:
        return [[] for _ in range(bins)]
    heap: list[tuple[int, int, list[int], list[list[int]]]] = []
    for i, w in enumerate(weights):
        heap.append((-w, i, [0] * (bins - 1) + [w], [[] for _ in range(bins - 1)] + [[i]]))
    heapq.heapify(heap)
    order = len(weights)
    while len(heap) > 1:
        _, _, s1, p1 = heapq.heappop(heap)
        _, _, s2, p2 = heapq.heappop(heap)
        merged = sorted(((a + b, x, y) for (a, x), (b, y) in zip(zip(s1, p1), zip(reversed(s2), reversed(p2)))), key=lambda z: z[0])
        sums = [z[0] for z in merged]
        parts = [z[1] + z[2] for z in merged]
        heapq.heappush(heap, (sums[0] - sums[-1], order, sums, parts))
        order += 1
    return heap[0][3]


def _bins_of_shard(bins: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["weight", "scene"], ascending=[False, True]).reset_index(drop=True)
        place = [0] * len(rows)
        for b, items in enumerate(difference(rows.weight.tolist(), max(1, min(bins, len(rows))))):
            for i in items:
                place[i] = b
        rows["bin"] = place
        return rows[["cls", "shard", "scene", "weight", "bin"]]

    return run


def allocate_runs(histogram: dict[int, int], targets: dict[str, float]) -> list[tuple[int, int, int, str]]:
    """(weight, low, high, split): of the bins of a weight, in any order, those from place low to below high go to the split.

    Heaviest weight first, each bin to the split furthest behind its target
    of the total.  The steps of one weight are counted together, so the work
    grows with the distinct weights (their sum bounds them by a square root).
    """
    total, out = sum(w * n for w, n in histogram.items()), []
    scale = sum(targets.values()) or 1.0
    behind = {s: targets[s] / scale * total for s in targets}
    for w in sorted(histogram, reverse=True):
        n, given = histogram[w], dict.fromkeys(targets, 0)
        if w > 0 and n > len(targets):
            # Splits fall to a common level; the highest level that needs no more than n steps leaves at most one a split.
            high = max(behind.values())
            low = high - w * (n + 1.0)
            for _ in range(60):
                level = (low + high) / 2
                steps = {s: max(0, math.ceil((b - level) / w)) for s, b in behind.items()}
                if sum(steps.values()) <= n:
                    high, given = level, steps
                else:
                    low = level
        for s, k in given.items():
            behind[s] -= k * w
        for _ in range(n - sum(given.values())):
            best = min(targets, key=lambda s: (-behind[s], -targets[s], s))
            behind[best] -= w
            given[best] += 1
        at = 0
        for s, k in given.items():
            if k:
                out.append((w, at, at + k, s))
                at += k
    return out


def assign_splits(grouped: DataFrame, targets: DataFrame, bins: int = 40, shard_rows: int = 2000, lanes: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """(path, final_class, scene, new_split) for every record.

    ``targets`` (split, target_share) is a handful of rows; shares are scaled
    to add up to one, and of a split named twice the larger counts.  Shards hold about ``shard_rows`` components whatever
    the table's size; the bins of all shards of a class are allocated together,
    so a heavy scene in one is made up for by the others.  A scene heavier than
    a split's whole target stays whole.  Records without class form a class of
    their own (NULL).
    """
    spark = grouped.sparkSession
    scratch = scratch or Scratch(spark)
    rows = scratch.save(grouped.select("path", "final_class", "scene"))
    named = rows.select("scene", F.coalesce("final_class", F.lit("")).alias("cls"))
    by_class = named.groupBy("scene", "cls").agg(F.count("*").alias("n"))
    lead = scratch.save(by_class.groupBy("scene").agg(F.sum("n").alias("weight"), F.max(F.struct("n", "cls")).alias("top")).select("scene", "weight", F.col("top.cls").alias("cls")))
    shards = F.greatest(F.lit(1), F.floor(F.count("*") / shard_rows)).cast("int").alias("n_shards")
    sharded = lead.join(lead.groupBy("cls").agg(shards), "cls").withColumn("shard", F.pmod(F.xxhash64("scene"), F.col("n_shards")).cast("int"))
    binned = scratch.save(sharded.groupBy("cls", "shard").applyInPandas(_bins_of_shard(bins), "cls string, shard int, scene string, weight long, bin int"))
    goals = {r.split: float(r.target_share) for r in targets.where("split IS NOT NULL AND target_share > 0").groupBy("split").agg(F.max("target_share").alias("target_share")).collect()}
    if not goals:
        return rows.withColumn("new_split", F.lit(None).cast("string"))

    def allot(pdf: pd.DataFrame) -> pd.DataFrame:
        cls = pdf.cls.iloc[0]
        runs = allocate_runs(dict(zip(pdf.weight.tolist(), pdf.n.tolist())), goals)
        return pd.DataFrame([(cls, *r) for r in runs], columns=["cls", "weight", "low", "high", "new_split"])

    sums = scratch.save(binned.groupBy("cls", "shard", "bin").agg(F.sum("weight").alias("weight")))
    by_lane = sums.withColumn("lane", F.pmod(F.xxhash64("shard", "bin"), F.lit(lanes)))
    counts = by_lane.groupBy("cls", "weight", "lane").agg(F.count("*").alias("n"))
    runs = counts.groupBy("cls", "weight").agg(F.sum("n").alias("n")).groupBy("cls").applyInPandas(allot, "cls string, weight long, low long, high long, new_split string")
    # The place of a bin within its weight: ranked per lane, offset by the lanes before.
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("cls", "weight").orderBy("lane")) - F.col("n")).drop("n")
    inside = Window.partitionBy("cls", "weight", "lane").orderBy("shard", "bin")
    ranked = by_lane.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["cls", "weight", "lane"]).withColumn("place", F.col("r") + F.col("before"))
    placed = ranked.join(runs, ["cls", "weight"]).where("place >= low AND place < high").select("cls", "shard", "bin", "new_split")
    scenes = binned.join(placed, ["cls", "shard", "bin"]).select("scene", "new_split")
    return rows.join(scenes, "scene").select("path", "final_class", "scene", "new_split")


def balance_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per class and split: records given, their share of the class, the target and the gap."""
    n = assigned.groupBy("final_class", "new_split").agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("final_class")))
    targets = targets.select("split", "target_share")
    return share.join(F.broadcast(targets), share.new_split == targets.split).select(
        "final_class", "new_split", "n", F.round("share", 6).alias("share"), "target_share", F.round(F.col("share") - F.col("target_share"), 6).alias("gap")
    )


def broken_rules(assigned: DataFrame, targets: DataFrame, bins: int = 40) -> DataFrame:
    """One row: records, records without split or given twice, scenes in several splits, classes off their targets.

    A class (that most of a scene's records have) is off where a split's
    records are further from its target than the heaviest scene and an even
    bin together: no allocation of whole bins needs more.
    """
    each = assigned.groupBy("path").agg(F.count("*").alias("n"), F.count("new_split").alias("n_split"))
    records = each.agg(F.count("*").alias("n_records"), F.count_if(F.col("n_split") == 0).alias("n_unassigned"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    by_class = assigned.groupBy("scene", F.coalesce("final_class", F.lit("")).alias("cls")).agg(F.count("*").alias("n"), F.min("new_split").alias("a"), F.max("new_split").alias("b"))
    scenes = by_class.groupBy("scene").agg(F.sum("n").alias("w"), F.max(F.struct("n", "cls"))["cls"].alias("cls"), F.min("a").alias("a"), F.max("b").alias("b"))
    torn = scenes.agg(F.count_if(F.col("a") != F.col("b")).alias("n_torn"))
    classes = scenes.groupBy("cls").agg(F.sum("w").alias("total"), F.max("w").alias("heaviest"))
    given = scenes.groupBy("cls", F.col("a").alias("split")).agg(F.sum("w").alias("n"))
    due = classes.crossJoin(F.broadcast(targets.where("split IS NOT NULL AND target_share > 0").select("split", F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(1)))).toDF("split", "share")))
    gap = F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("total"))
    off = due.join(given, ["cls", "split"], "left").agg(F.count_if(gap > F.col("heaviest") + F.col("total") / bins).alias("n_off"))
    return records.join(torn).join(off)
