"""Queries pN_... of the training-data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import components, group_splits, leak_index, near_hash, packing, quota_sample, readability, vector_graph
from furrow.sources.tables import manifest, table

#: Bits by which the hashes of one photograph (or scene) may differ.
HASH_EDITS = 5
#: Entries of a usable vector, and neighbours asked for.
VECTOR_SIZE = 50
NEIGHBOURS = 5
CAPACITY = 2048
LEAK_WORDS = 12
SCHOOL_YEARS = 16.0


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    graph = vector_graph.build_graph(table(spark, d, "features"), VECTOR_SIZE)
    return vector_graph.unordered_pairs(vector_graph.nearest(graph, NEIGHBOURS))


def _queried(features: DataFrame) -> DataFrame:
    return features.where("vec_id % 50 = 0").select("vec_id", "x")


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    features = table(spark, d, "features")
    graph = vector_graph.build_graph(features, VECTOR_SIZE)
    near = vector_graph.greedy_search(graph, _queried(features), NEIGHBOURS)
    return near.select("vec_id", "near_id", F.round("distance", 4).alias("distance"))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the graph and of the walk, against every vector in blocks."""
    features = table(spark, d, "features")
    graph = vector_graph.build_graph(features, VECTOR_SIZE)
    lists = vector_graph.nearest(graph, NEIGHBOURS)
    walk = vector_graph.greedy_search(graph, _queried(features), NEIGHBOURS)
    named = lambda found, name: vector_graph.recall(graph, found).select(F.lit(name).alias("way"), "n_queries", "n_pairs", "recall")
    return named(lists, "graph").unionByName(named(walk, "walk"))


def p1_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the start graph and after each round of the descent, from two orders of small blocks, so that the rounds have most to find."""
    trace: list[vector_graph.VectorGraph] = []
    vector_graph.build_graph(table(spark, d, "features"), VECTOR_SIZE, orders=2, block=256, trace=trace)
    return vector_graph.recall_of_rounds(trace, NEIGHBOURS)


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_hash.split_overlaps(manifest(spark, d), HASH_EDITS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p2_pairs(spark, d)
    return pairs.select(F.least("train_path", "eval_path").alias("path_a"), F.greatest("train_path", "eval_path").alias("path_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return near_hash.overlap_report(p2_pairs(spark, d))


def _sampled(spark: SparkSession, d: str, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return quota_sample.quota_sample(sources or quota_sample.eligible(manifest(spark, d)), table(spark, d, "sample_plans"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].where("falls_short").select("plan_id", "final_class")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def p3_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the samples: each row once, eligible, classes and sources within a row of their share."""
    sources = quota_sample.eligible(manifest(spark, d))
    return quota_sample.broken_rules(sources, *_sampled(spark, d, sources))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return group_splits.straddling(group_splits.scene_groups(manifest(spark, d), HASH_EDITS))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    scenes = group_splits.scene_groups(manifest(spark, d), HASH_EDITS)
    return group_splits.assign_splits(scenes, table(spark, d, "split_targets")).select("path", "new_split")


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    scenes = group_splits.scene_groups(manifest(spark, d), HASH_EDITS)
    targets = table(spark, d, "split_targets")
    return group_splits.balance_report(group_splits.assign_splits(scenes, targets), targets)


def p4_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits: every record once, no scene torn, classes near their targets."""
    targets = table(spark, d, "split_targets")
    scenes = group_splits.scene_groups(manifest(spark, d), HASH_EDITS)
    return group_splits.broken_rules(group_splits.assign_splits(scenes, targets), targets)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return components.photo_groups(manifest(spark, d), table(spark, d, "match_pairs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.members(p5_groups(spark, d))


def p5_sizes(spark: SparkSession, d: str) -> DataFrame:
    return components.group_sizes(p5_groups(spark, d))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents")), CAPACITY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(p6_containers(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d), CAPACITY)


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: whole texts, each piece once, none over the capacity, none cut without need."""
    return packing.broken_rules(p6_containers(spark, d), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak_index.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), LEAK_WORDS).select("item_id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leak_index.leak_report(leak_index.leaks(table(spark, d, "documents"), items, LEAK_WORDS), items)


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    levels = readability.reading_levels(table(spark, d, "documents"))
    return levels.withColumns({c: F.round(c, 4) for c in ["grade", *readability.FORMULAS]})


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return readability.demanding(readability.reading_levels(table(spark, d, "documents")), SCHOOL_YEARS)


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return readability.level_profile(readability.reading_levels(table(spark, d, "documents")))


def p8_rated(spark: SparkSession, d: str) -> DataFrame:
    """Grades beside the levels that raters gave."""
    return readability.rated(readability.reading_levels(table(spark, d, "documents")), table(spark, d, "level_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_search, p1_recall, p1_rounds, p2_found, p2_report, p3_found, p3_report, p3_sample, p3_rules, p4_found, p4_splits, p4_balance, p4_rules, p5_found, p5_groups, p5_sizes, p6_found, p6_containers, p6_fill, p6_rules, p7_found, p7_report, p8_found, p8_levels, p8_profile, p8_rated)
}
