"""Problem 5: consolidating pairwise matches into groups.

Method: low-diameter decomposition.  Every vertex draws an exponential shift;
clusters grow from the shifted start times, one hop a step, and each vertex
joins the cluster that reaches it first.  Clusters then contract to
super-vertices, the edges between clusters form the next, smaller graph, and
the assignments of all rounds compose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import clean
from furrow.session import Scratch


def exponential_shift(vertex: Column, beta: float, seed: int) -> Column:
    """Exp(beta) variate that depends on vertex and seed alone, so retries agree."""
    bits = F.shiftrightunsigned(F.xxhash64(vertex, F.lit(seed)), 12)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(beta)


def connected_components(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    beta: float = 0.1,
    growth_steps: int = 4,
    max_rounds: int = 60,
    seed: int = 17,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row (vertex, component) for every vertex that an edge names.

    ``component`` is one of the member vertices.  Edges are undirected; NULL
    ends and loops link nothing (a vertex seen only in a loop is its own
    component), repeated edges count once, further columns are ignored and an
    empty table gives an empty result.

    However far the clusters have grown, a cluster only holds vertices that
    are joined by edges, so contraction is exact; ``growth_steps`` and
    ``beta`` set only how fast the graph shrinks.  The rounds' assignments
    shrink with it and compose from the last to the first, so all vertices are
    joined once, not once a round.  Shifts widen from round to round, so that
    stubborn neighbours, whose shifts differ by less than a hop, soon merge.  Each step is one join on
    the edge's source and one partially aggregated minimum, so a hub with any
    number of edges is split by the adaptive skew join and pre-aggregated
    before the shuffle.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark)
    named = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    both = named.union(named.select("dst", "src")).distinct()
    graph = scratch.save(both)
    rounds: list[DataFrame] = []
    for round_no in range(max_rounds):
        links = graph.where("src != dst")
        # A loop without cost lets a vertex keep what it has, so a step reads the state once and the plan stays a chain.
        loops = graph.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("hop"))
        hops = links.select("src", "dst", F.lit(1.0).alias("hop")).unionByName(loops)
        start = -exponential_shift(F.col("src"), beta / (round_no + 1), seed + round_no)
        # In the first step every vertex is its own centre, which needs no join.
        first = hops.select(F.col("dst").alias("vertex"), F.struct((start + F.col("hop")).alias("at"), F.col("src").alias("center")).alias("best"))
        state = first.groupBy("vertex").agg(F.min("best").alias("best"))
        for _ in range(growth_steps - 1):
            arrived = hops.join(state, hops.src == state.vertex).select(
                F.col("dst").alias("vertex"), F.struct((F.col("best.at") + F.col("hop")).alias("at"), F.col("best.center").alias("center")).alias("best")
            )
            state = arrived.groupBy("vertex").agg(F.min("best").alias("best"))
        cluster = scratch.save(state.select("vertex", F.col("best.center").alias("center")))
        ends = cluster.withColumnsRenamed({"vertex": "v", "center": "c"})
        contracted = (
            links.join(cluster, links.src == cluster.vertex)
            .select(F.col("center").alias("a"), "dst")
            .join(ends, F.col("dst") == F.col("v"))
            .where("a != c")
            .select(F.col("a").alias("src"), F.col("c").alias("dst"))
            .distinct()
        )
        smaller = scratch.save(contracted)
        rounds.append(cluster)
        scratch.drop(graph)
        graph = smaller
        if graph.isEmpty():
            scratch.drop(graph)
            return _composed(rounds, scratch)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _composed(rounds: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(vertex, component) of the first round's vertices, from each round's (vertex, center)."""
    out = rounds[-1].withColumnRenamed("center", "component")
    for earlier in reversed(rounds[:-1]):
        # A centre without inter-cluster edges is no vertex of the next round and stays.
        later = out.withColumnRenamed("vertex", "v")
        out = earlier.join(later, earlier.center == later.v, "left").select("vertex", F.coalesce("component", "center").alias("component"))
    out = scratch.save(out)
    scratch.drop(*rounds)
    return out


# The verdicts that accept a match.
ACCEPTING = ["match", "same"]


def photo_groups(records: DataFrame, pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(path, group_path) for every record: group_path is the smallest path of its group.

    Two records are linked by equal hashes or by an accepting verdict between
    them.  A record's vertex is its hash, or its path where it has none, so
    that equal hashes, however many, need no edge and no join.  Verdicts that
    name an unknown path, a NULL path or the same record twice link nothing.
    """
    scratch = scratch or Scratch(records.sparkSession)
    vertex = F.when(F.col("hash").isNotNull(), F.concat(F.lit("#"), F.hex("hash"))).otherwise(F.concat(F.lit("/"), F.col("path")))
    placed = scratch.save(records.select("path", vertex.alias("vertex")))
    accepted = (
        pairs.where(clean.squeeze("verdict").isin(ACCEPTING))
        .select(clean.plain_path("path_a").alias("a"), clean.plain_path("path_b").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .distinct()
    )
    left = placed.select(F.col("path").alias("a"), F.col("vertex").alias("src"))
    right = placed.select(F.col("path").alias("b"), F.col("vertex").alias("dst"))
    edges = accepted.join(left, "a").join(right, "b").where("src != dst").select("src", "dst")
    found = connected_components(edges, scratch=scratch)
    grouped = placed.join(found, "vertex", "left").select("path", F.coalesce("component", "vertex").alias("component"))
    grouped = scratch.save(grouped)
    first = grouped.groupBy("component").agg(F.min("path").alias("group_path"))
    return grouped.join(first, "component").select("path", "group_path")


def members(groups: DataFrame) -> DataFrame:
    """(group_path, path) of each member but the smallest of groups of two or more."""
    return groups.where("path != group_path").select("group_path", "path")


def group_sizes(groups: DataFrame) -> DataFrame:
    """Number of groups of each size."""
    return groups.groupBy("group_path").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))
