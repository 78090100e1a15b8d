"""Near-duplicate graphs of 64-bit hashes (JOI09, GRF01-GRF04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import bits
from furrow.session import Scratch

#: Bound above which keys are sorted where blocks of hashes are held, and that above which segments hardly tell hashes apart and all pairs are compared.
MIDDLING = 7
WIDE = 12
#: Links that one task merges.
TOGETHER = 1 << 23


def hamming_pairs(hashes: DataFrame, most: int, col: str = "hash", scratch: Scratch | None = None) -> DataFrame:
    """JOI09: pairs (a, b, dist), a < b, of distinct hashes at most ``most`` bits apart.

    Exact for every bound (``functions.bits``): an equi-join on the segments
    that stay as they are, verified by the number of differing bits.  For
    middling bounds such keys, hundreds a hash, are never shuffled.
    """
    scratch = scratch or Scratch(hashes.sparkSession)
    if MIDDLING < most <= WIDE:
        return bits.sorted_pairs(hashes.select(F.col(col).alias("hash")), most, scratch).withColumnRenamed("bits", "dist")
    return bits.close_pairs(hashes.select(F.col(col).alias("hash")), None, most, scratch).withColumnRenamed("bits", "dist")


def pair_counts(hashes: DataFrame, most: int, col: str = "hash", scratch: Scratch | None = None) -> DataFrame:
    """JOI09: (dist, n_pairs) of the pairs that ``hamming_pairs`` gives; for wide bounds they are counted where they are compared."""
    scratch = scratch or Scratch(hashes.sparkSession)
    if most > WIDE:
        return bits.compared(hashes.select(F.col(col).alias("hash")), most, scratch, links=False)[0]
    return hamming_pairs(hashes, most, col, scratch).groupBy("dist").agg(F.count("*").alias("n_pairs"))


def components(edges: DataFrame, src: str = "a", dst: str = "b", scratch: Scratch | None = None, max_rounds: int = 100) -> DataFrame:
    """GRF01: (vertex, component), component the smallest vertex of each connected component.

    Alternates the large-star and small-star operations, each one aggregated
    group-by and one join, until no edge changes: a logarithmic number of
    rounds in practice.  Loops and NULL ends link nothing.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct()
    e = scratch.save(e)
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.save(small)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if mark == before:
            break
        before = mark
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def clustered(rows: DataFrame, most: int, scratch: Scratch | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """rows with ``cluster``: the smallest hash of the near-duplicate component; NULL without hash."""
    scratch = scratch or Scratch(rows.sparkSession)
    found = components(hamming_pairs(rows, most, scratch=scratch) if pairs is None else pairs, scratch=scratch)
    return rows.join(found, rows.hash == found.vertex, "left").select(*[rows[c] for c in rows.columns], F.coalesce("component", "hash").alias("cluster"))


def cluster_stats(members: DataFrame) -> DataFrame:
    """AGG24: clusters, those of several records, the largest, their records, straddling ones and records in them."""
    c = members.where("cluster IS NOT NULL").groupBy("cluster").agg(
        F.count("*").alias("n"), F.min("split").alias("s1"), F.max("split").alias("s2"), F.count_if(F.coalesce(F.col("split") == "test", F.lit(False))).alias("n_test")
    )
    torn = F.coalesce(F.col("s1") != F.col("s2"), F.lit(False))
    return c.agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_multi"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_multi"),
        F.count_if(torn).alias("n_straddling"), F.coalesce(F.sum(F.when(torn, F.col("n"))), F.lit(0)).alias("in_straddling"), F.coalesce(F.sum(F.when(torn, F.col("n_test"))), F.lit(0)).alias("test_in_straddling"),
    )


def components_by_bound(links: DataFrame, bounds: list[int], scratch: Scratch) -> DataFrame:
    """(vertex, t6, t10, ...): ``components`` of the links (a, b, dist) at most each bound long, a column a bound.

    Links as few as ``TOGETHER`` are merged by one task, which then takes
    seconds; more of them by ``components``, bound by bound.
    """
    names = {t: f"t{t}" for t in sorted(set(bounds))}
    if links.count() <= TOGETHER:
        return scratch.save(links.select("a", "b", "dist").coalesce(1).mapInArrow(bits.merger(list(names)), ", ".join(["vertex bigint", *[f"{c} bigint" for c in names.values()]])))
    out = links.select(F.col("a").alias("vertex")).union(links.select("b")).distinct()
    for t, c in names.items():
        out = out.join(components(links.where(F.col("dist") <= t), scratch=scratch).withColumnRenamed("component", c), "vertex", "left")
    return scratch.save(out)


def threshold_sweep(rows: DataFrame, bounds: list[int], scratch: Scratch | None = None) -> DataFrame:
    """GRF02: ``cluster_stats`` and number of pairs of distinct hashes at each bound; pairs are compared once.

    For wide bounds pairs are counted, and links that join the same hashes
    take their place (``bits.compared``): there pairs grow with the square.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    if max(bounds) > WIDE:
        rows = scratch.save(rows.select("hash", "split"))
        counts, links = bits.compared(rows, max(bounds), scratch, bounds=bounds)
        found = components_by_bound(links, bounds, scratch)
        members = scratch.save(rows.join(found, rows.hash == found.vertex, "left").drop("vertex"))
        at = lambda t: members.select("split", F.coalesce(f"t{t}", "hash").alias("cluster"))
    else:
        pairs = scratch.save(hamming_pairs(rows, max(bounds), scratch=scratch))
        counts = pairs.groupBy("dist").agg(F.count("*").alias("n_pairs"))
        at = lambda t: clustered(rows, t, scratch, pairs.where(F.col("dist") <= t))
    out = None
    for t in bounds:
        part = scratch.save(cluster_stats(at(t)).withColumn("t", F.lit(t)))
        part = part.join(F.broadcast(counts.where(F.col("dist") <= t).agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))))
        out = part if out is None else out.unionByName(part)
    return out


def greedy_dedupe(rows: DataFrame, most: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """GRF03: path, fate, rival, cross when rows are taken in (final_class, path) order.

    A row is dropped when its hash lies within ``most`` bits of a row kept
    before.  fate: keep, exact (an equal hash was kept), near; rival: the path
    of the nearest row kept before it (ties: the earlier); cross: whether the
    rival's class differs (FALSE for kept rows; a missing class is one of its
    own).  Rows without hash are kept; paths are unique.

    Equal hashes share a fate but for their first, so only the first row of
    each hash is decided.  The order gives every link a direction, and fates
    follow in rounds: a row is kept once all its earlier neighbours are
    dropped, and dropped once one is kept.  A round is one join on the links
    still open and a partial aggregate; no component is ever brought together.
    Rounds are as many as the longest chain of earlier neighbours, which the
    order of paths, unrelated to hashes, keeps short.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    named = scratch.save(rows.select("path", F.coalesce("final_class", F.lit("")).alias("cls"), "hash"))
    firsts = scratch.save(named.where("hash IS NOT NULL").groupBy("hash").agg(F.min(F.struct("cls", "path")).alias("lead")))
    pairs = hamming_pairs(firsts, most, scratch=scratch)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist")).select(F.col("a").alias("h"), F.col("b").alias("o"), "dist")
    mine, theirs = firsts.select(F.col("hash").alias("h"), F.col("lead").alias("me")), firsts.select(F.col("hash").alias("o"), F.col("lead").alias("rival"))
    links = scratch.save(both.join(mine, "h").join(theirs, "o").select("h", "o", "dist", "rival", (F.col("rival") < F.col("me")).alias("earlier")))
    left = links.where("earlier").select("h", "o")
    kept = scratch.save(left.select(F.col("o").alias("h")).join(left.select("h"), "h", "left_anti").distinct())
    all_kept = kept
    while not kept.isEmpty():
        dropped = scratch.save(left.join(kept.select(F.col("h").alias("o")), "o", "left_semi").select("h").distinct())
        # Links to what is dropped bind no more; a row whose last link goes is kept.
        still = left.join(dropped, "h", "left_anti")
        rest = scratch.save(still.join(dropped.select(F.col("h").alias("o")), "o", "left_anti").select("h", "o"))
        kept = scratch.save(still.select("h").distinct().join(rest.select("h"), "h", "left_anti"))
        all_kept = all_kept.unionByName(kept)
        left = rest
    all_kept = scratch.save(all_kept)
    lost = links.join(all_kept.select(F.col("h").alias("o")), "o", "left_semi").join(all_kept, "h", "left_anti").select(F.col("h").alias("hash"), "dist", F.col("rival").alias("k"))
    near = named.join(lost, "hash").where(F.col("k") < F.struct("cls", "path")).groupBy("path").agg(F.min(F.struct("dist", "k")).alias("best")).select("path", F.col("best.k").alias("by"))
    out = named.join(firsts, "hash", "left").join(near, "path", "left")
    first = F.col("hash").isNull() | (F.col("path") == F.col("lead.path"))
    fate = F.when(F.col("by").isNotNull(), "near").when(first, "keep").otherwise("exact")
    rival = F.when(F.col("by").isNotNull(), F.col("by")).when(~first, F.col("lead"))
    return out.select("path", fate.alias("fate"), rival["path"].alias("rival"), F.coalesce(rival["cls"] != F.col("cls"), F.lit(False)).alias("cross"))


def leakage(members: DataFrame) -> DataFrame:
    """GRF04, AGG32: by split, records, those in a cluster with a training record, and their share in percent."""
    hit = members.where("cluster IS NOT NULL AND split = 'train'").select("cluster").distinct().withColumn("bad", F.lit(1))
    evals = members.where("split IN ('val', 'test')").join(hit, "cluster", "left")
    return evals.groupBy("split").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad")).withColumn("pct", F.round(100 * F.col("n_bad") / F.col("n"), 4))
