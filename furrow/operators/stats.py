"""Column statistics of feature tables and scores (AGG13-AGG19, AGG29-AGG31, AGG33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(df: DataFrame, keys: list[str], vec: str = "x") -> DataFrame:
    """keys, dim (0-based), value."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "value"))


def zscore_fit(df: DataFrame, vec: str = "x", ddof: int = 0) -> DataFrame:
    """AGG13: dim, mean, std (sample std with ``ddof`` 1); a std of 0 becomes 1.

    One row a dimension: the explode is aggregated in the map stage, so what
    is shuffled is tasks x dimensions.
    """
    std = F.stddev_samp("value") if ddof else F.stddev_pop("value")
    out = exploded(df, [], vec).groupBy("dim").agg(F.avg("value").alias("mean"), std.alias("std"))
    return out.withColumn("std", F.when((F.col("std") == 0) | F.col("std").isNull(), 1.0).otherwise(F.col("std")))


def moments(df: DataFrame, keys: list[str], value: str = "value", ddof: int = 0) -> DataFrame:
    """AGG18: mean, std and population skewness; 0 where nothing varies."""
    std = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    flat = F.stddev_pop(value) <= 1e-12
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(std, F.lit(0.0)).alias("std"), F.when(flat, 0.0).otherwise(F.coalesce(F.skewness(value), F.lit(0.0))).alias("skew"))


def histogram(df: DataFrame, keys: list[str], value: Column, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """AGG19: share of each bin that holds something; the last bin is closed, values out of range are left out."""
    inside = df.withColumn("_v", value).where((F.col("_v") >= low) & (F.col("_v") <= high))
    bin_no = F.least(F.floor((F.col("_v") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    n = inside.groupBy(*keys, bin_no.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.withColumn("share", F.col("n") / total)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 512) -> DataFrame:
    """keys and a column a share: exact quantiles with linear interpolation; NULL and NaN are left out, so may be groups.

    Values are counted by range first (``bins`` a group between its least and
    its largest), which says in which range each quantile lies; only the
    different values of those ranges are then counted and looked through.
    Both counts are aggregated before they are shuffled, so no task holds a
    group, however large.  The rows are read three times; save them first
    where that is dear.
    """
    v = F.col(value).cast("double")
    safe = [F.struct(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*safe, v.alias("_v"))
    ends = rows.groupBy(*names).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = rows.join(ends, names).select(*names, at.alias("_bin"), "_v")
    counts = binned.groupBy(*names, "_bin").agg(F.count("*").alias("_c"))
    by_group = Window.partitionBy(*names)
    counts = counts.withColumn("_before", F.sum("_c").over(by_group.orderBy("_bin")) - F.col("_c"))
    # Places (from 0) that the quantiles lie on or between.
    spots = F.array(*[F.struct(F.lit(name).alias("q"), (F.col("_n") - 1) * F.lit(share)).cast("struct<q:string,x:double>") for name, share in shares.items()])
    wanted = ends.select(*names, F.explode(spots).alias("_s")).select(*names, F.col("_s.q").alias("_q"), F.col("_s.x").alias("_x"), F.explode(F.array(F.floor("_s.x"), F.ceil("_s.x"))).alias("_at")).distinct()
    hit = counts.join(wanted, names).where("_at >= _before AND _at < _before + _c").select(*names, "_bin", "_before", "_q", "_x", "_at")
    inside = binned.join(hit.select(*names, "_bin", "_before").distinct(), [*names, "_bin"]).groupBy(*names, "_bin", "_before", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*names, "_bin").orderBy("_v"))
    inside = inside.select(*names, "_bin", "_v", (F.col("_before") + upto - F.col("_c")).alias("_low"), (F.col("_before") + upto).alias("_high"))
    found = inside.join(hit.drop("_before"), [*names, "_bin"]).where("_at >= _low AND _at < _high")
    part = F.when(F.col("_at") == F.col("_x"), 1.0).otherwise(1 - F.abs(F.col("_at") - F.col("_x")))
    value_of = lambda q: F.sum(F.when(F.col("_q") == q, F.col("_v") * part)).alias(q)
    out = found.groupBy(*names).agg(*map(value_of, shares))
    return out.select(*[F.col(n)[k].alias(k) for n, k in zip(names, keys)], *shares)


def quartiles(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """AGG16: exact quartiles with linear interpolation."""
    return quantiles(df, keys, value, {"q25": 0.25, "q75": 0.75})


def _with_median(summary: DataFrame, df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The summary with its groups' medians; groups without values keep NULL."""
    half = quantiles(df, keys, value, {name: 0.5}).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [summary[k].eqNullSafe(half[f"_{k}"]) for k in keys]
    return summary.join(half, same, "left").drop(*[f"_{k}" for k in keys])


def separation(quarts: DataFrame, pairs: DataFrame, top: int = 3, least: float = 0.30) -> DataFrame:
    """AGG17: of each pair of classes (class, rival) the dims whose lower quartiles lie furthest apart.

    score = |q25 - q25'| / max(IQR, IQR', 1e-6).  Dims scoring over ``least``
    are preferred; if a pair has none, all its dims compete.
    """
    mine = quarts.select(F.col("label").alias("class"), "dim", "q25", "q75")
    theirs = quarts.select(F.col("label").alias("rival"), "dim", F.col("q25").alias("r25"), F.col("q75").alias("r75"))
    joined = pairs.join(mine, "class").join(theirs, ["rival", "dim"])
    score = F.abs(F.col("q25") - F.col("r25")) / F.greatest(F.col("q75") - F.col("q25"), F.col("r75") - F.col("r25"), F.lit(1e-6))
    scored = joined.withColumn("score", score)
    pair = Window.partitionBy("class", "rival")
    kept = scored.withColumn("best", F.max("score").over(pair)).where((F.col("score") > least) | (F.col("best") <= least))
    place = F.row_number().over(pair.orderBy(F.desc("score"), "dim"))
    return kept.withColumn("place", place).where(F.col("place") <= top).select("class", "rival", "dim", "place", "score", "r25", "r75")


def score_summary(df: DataFrame, keys: list[str], p: str = "p", viable: int = 15) -> DataFrame:
    """AGG29, AGG30: rows, unreadable ones, decisions, uncertain range, median and mean, and whether enough are kept."""
    from furrow.operators.filters import bucket

    b = df.withColumn("_b", bucket(p))
    out = b.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("_b").isNull()).alias("unreadable"),
        *[F.count_if(F.col("_b") == x).alias(x) for x in ("keep", "drop", "uncertain")],
        F.min(F.when(F.col("_b") == "uncertain", F.col(p))).alias("uncertain_low"), F.max(F.when(F.col("_b") == "uncertain", F.col(p))).alias("uncertain_high"),
        F.avg(p).alias("mean_p"),
    )
    return _with_median(out, df, keys, p, "median_p").withColumn("viable", F.col("keep") >= viable)


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG31: least, median and largest."""
    return _with_median(df.groupBy(*keys).agg(F.min(value).alias("min_v"), F.max(value).alias("max_v")), df, keys, value, "median_v")


def view_spread(views: DataFrame, item: str, cls: str = "cls", p: str = "p") -> DataFrame:
    """AGG33, ML07: per item the largest standard deviation over classes of repeated predictions."""
    per = views.groupBy(item, cls).agg(F.avg(p).alias("mean_p"), F.stddev_pop(p).alias("std_p"))
    return per.groupBy(item).agg(F.max("std_p").alias("uncertainty"), F.max("mean_p").alias("confidence"))
