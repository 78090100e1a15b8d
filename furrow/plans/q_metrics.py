"""Queries on aggregates and classifier metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import filters, metrics, stats
from furrow.plans.registry import query
from furrow.plans.sql import FS, M, P, V
from furrow.session import Scratch
from furrow.sources.tables import disease_info, filter_scores, manifest, predictions, table, vectors

R = ["run_tag"]
CONF = f"{P}, c AS (SELECT run_tag, true_class, pred, count(*) AS n FROM p WHERE true_class IS NOT NULL AND pred IS NOT NULL GROUP BY 1, 2, 3)"
REPORT = f"""{CONF}, k AS (SELECT run_tag, true_class AS class, n AS s, 0 AS p, CASE WHEN true_class = pred THEN n ELSE 0 END AS h FROM c UNION ALL SELECT run_tag, pred, 0, n, 0 FROM c),
a AS (SELECT run_tag, class, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits FROM k GROUP BY 1, 2)"""


def _ratios(undefined: str) -> str:
    return f"""{REPORT}, b AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE {undefined} END AS precision, CASE WHEN support > 0 THEN hits / support ELSE {undefined} END AS recall FROM a),
r AS (SELECT *, CASE WHEN isnan(precision + recall) OR precision + recall = 0 THEN {undefined} ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM b)"""


NANV, ZEROV = "'NaN'::DOUBLE", "0.0::DOUBLE"


def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _nudged(df, *cols):
    """Rounded a hair off the ties that means and quartiles of six-digit numbers fall on."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in cols})


def _saved_vectors(spark, d):
    """The vectors as a written table, for operators that read them more than once."""
    return Scratch(spark).save(vectors(spark, d))


def _conf(spark, d):
    return metrics.confusion(predictions(spark, d), R)


@query(f"WITH {M} SELECT final_class, count(*) AS n FROM m GROUP BY 1")
def agg01_class_counts(spark, d):
    return manifest(spark, d).groupBy("final_class").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT split, final_class, count(*) AS n FROM m GROUP BY 1, 2")
def agg02_split_class_counts(spark, d):
    return manifest(spark, d).groupBy("split", "final_class").agg(F.count("*").alias("n"))


@query(f"WITH {FS} SELECT split_part(path, '/', 2) AS label, bucket, count(*) AS n FROM f GROUP BY 1, 2")
def agg02_bucket_label_counts(spark, d):
    return filter_scores(spark, d).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("label"), "bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {M}, s AS (SELECT final_class, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM m GROUP BY final_class)
SELECT *, round(test / total, 6) AS test_share, CAST(sum(total) OVER () AS BIGINT) AS grand_total FROM s""")
def agg03_split_pivot(spark, d):
    by = manifest(spark, d).groupBy("final_class").agg(*[F.count_if(F.coalesce(F.col("split") == s, F.lit(False))).alias(s) for s in ("train", "val", "test")], F.count("*").alias("total"))
    whole = by.agg(F.sum("total").alias("grand_total"))
    return by.join(F.broadcast(whole)).withColumn("test_share", F.round(F.col("test") / F.col("total"), 6))


@query(f"WITH {CONF} SELECT * FROM c")
def agg04_confusion(spark, d):
    return _conf(spark, d)


@query(f"WITH {CONF} SELECT run_tag, sum(n)::BIGINT AS n, round(sum(n) FILTER (true_class = pred) / sum(n), 6) AS accuracy FROM c GROUP BY 1")
def agg05_accuracy(spark, d):
    return _r6(metrics.accuracy(_conf(spark, d), R), "accuracy")


@query(f"WITH {_ratios(ZEROV)} SELECT run_tag, class, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def agg06_report_zero(spark, d):
    return _r6(metrics.class_report(_conf(spark, d), R, "zero").drop("hits"), "precision", "recall", "f1")


@query(f"WITH {_ratios(NANV)} SELECT run_tag, class, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def agg06_report_nan(spark, d):
    return _r6(metrics.class_report(_conf(spark, d), R, "nan").drop("hits"), "precision", "recall", "f1")


@query(f"WITH {_ratios(NANV)} SELECT run_tag, round(avg(precision) FILTER (NOT isnan(precision)), 6) AS macro_precision, round(avg(recall) FILTER (NOT isnan(recall)), 6) AS macro_recall, round(avg(f1) FILTER (NOT isnan(f1)), 6) AS macro_f1 FROM r GROUP BY 1")
def agg07_macro_nan(spark, d):
    return _r6(metrics.macro(metrics.class_report(_conf(spark, d), R, "nan"), R), "macro_precision", "macro_recall", "macro_f1")


@query(f"WITH {_ratios(ZEROV)} SELECT run_tag, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM r GROUP BY 1")
def agg07_macro_zero(spark, d):
    return _r6(metrics.macro(metrics.class_report(_conf(spark, d), R, "zero"), R, False), "macro_precision", "macro_recall", "macro_f1")


@query(f"WITH {_ratios(ZEROV)} SELECT run_tag, round(avg(recall) FILTER (support > 0), 6) AS macro_recall FROM r GROUP BY 1")
def agg07_macro_observed(spark, d):
    report = metrics.class_report(_conf(spark, d), R, "zero")
    return report.groupBy("run_tag").agg(F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 6).alias("macro_recall"))


@query(f"WITH {_ratios(NANV)} SELECT run_tag, round(sum(support * CASE WHEN isnan(f1) THEN 0 ELSE f1 END) / sum(support), 6) AS weighted_f1 FROM r GROUP BY 1")
def agg08_weighted_f1(spark, d):
    return _r6(metrics.weighted(metrics.class_report(_conf(spark, d), R), R), "weighted_f1")


@query(f"WITH {CONF}, t AS (SELECT run_tag, true_class, sum(n) AS n FROM c GROUP BY 1, 2) SELECT run_tag, true_class AS class, round(n / sum(n) OVER (PARTITION BY run_tag), 6) AS accuracy FROM t QUALIFY row_number() OVER (PARTITION BY run_tag ORDER BY n DESC, true_class) = 1")
def agg09_majority(spark, d):
    return _r6(metrics.majority_baseline(_conf(spark, d), R), "accuracy")


@query(f"""WITH {CONF}, s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY run_tag, true_class), 6) AS share_of_true FROM c)
SELECT *, row_number() OVER (PARTITION BY run_tag ORDER BY n DESC, true_class, pred) AS place FROM s WHERE true_class <> pred QUALIFY place <= 10""")
def agg10_confused_pairs(spark, d):
    return _r6(metrics.confused_pairs(_conf(spark, d), R), "share_of_true")


_SEG = "count(*) FILTER (studio) AS n_studio, avg((true_class = pred)::INT) FILTER (studio) AS acc_studio, count(*) FILTER (NOT studio) AS n_other, avg((true_class = pred)::INT) FILTER (NOT studio) AS acc_other"
_SEGR = "n_studio, round(acc_studio, 6) AS acc_studio, n_other, round(acc_other, 6) AS acc_other, round(acc_studio - acc_other, 6) AS gap"


@query(f"WITH {P}, s AS (SELECT run_tag, {_SEG} FROM p WHERE true_class IS NOT NULL AND pred IS NOT NULL AND studio IS NOT NULL GROUP BY 1) SELECT run_tag, {_SEGR} FROM s")
def agg11_segment_gap(spark, d):
    return _r6(metrics.segment_gap(predictions(spark, d), R), "acc_studio", "acc_other", "gap")


@query(f"WITH {P}, s AS (SELECT run_tag, true_class, {_SEG} FROM p WHERE true_class IS NOT NULL AND pred IS NOT NULL AND studio IS NOT NULL GROUP BY 1, 2) SELECT run_tag, true_class, {_SEGR} FROM s WHERE n_studio > 0 AND n_other > 0")
def agg12_mixed_segments(spark, d):
    return _r6(metrics.mixed_segments(predictions(spark, d), R), "acc_studio", "acc_other", "gap")


_DIMS = "SELECT label, k - 1 AS dim, x[k] AS value FROM (SELECT label, x, unnest(range(1, 51)) AS k FROM v)"


@query(f"WITH {V}, e AS ({_DIMS}) SELECT CAST(dim AS INT) AS dim, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END, 6) AS std FROM e GROUP BY dim")
def agg13_zscore_fit(spark, d):
    return _r6(stats.zscore_fit(vectors(spark, d)), "mean", "std")


@query("SELECT DISTINCT lang, source FROM documents")
def agg14_distinct(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query(f"WITH {M} SELECT lpad(lower(to_hex(hash)), 16, '0') AS hash16, count(DISTINCT split) AS n_splits, count(*) AS n FROM m WHERE hash IS NOT NULL GROUP BY hash HAVING count(DISTINCT split) > 1")
def agg15_hash_leaks(spark, d):
    m = manifest(spark, d).where("hash IS NOT NULL")
    by = m.groupBy("hash").agg(F.size(F.collect_set("split")).cast("bigint").alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")
    return by.select(F.lpad(F.lower(F.hex("hash")), 16, "0").alias("hash16"), "n_splits", "n")


@query(rf"WITH {M} SELECT regexp_replace(path, '^.*[/\\]', '') AS name, count(DISTINCT split) AS n_splits, count(*) AS n FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1")
def agg15_name_leaks(spark, d):
    from furrow.functions import clean

    by = manifest(spark, d).groupBy(clean.base_name("path").alias("name")).agg(F.size(F.collect_set("split")).cast("bigint").alias("n_splits"), F.count("*").alias("n"))
    return by.where("n_splits > 1")


@query(f"WITH {V}, e AS ({_DIMS}) SELECT label, CAST(dim AS INT) AS dim, round(quantile_cont(value, 0.25) + 1e-9, 6) AS q25, round(quantile_cont(value, 0.75) + 1e-9, 6) AS q75 FROM e GROUP BY label, dim")
def agg16_quartiles(spark, d):
    return _nudged(stats.quartiles(stats.exploded(_saved_vectors(spark, d), ["label"]), ["label", "dim"]), "q25", "q75")


_RIVALS = f"""{CONF}, pooled AS (SELECT true_class, pred, sum(n) AS n FROM c WHERE true_class <> pred GROUP BY 1, 2),
w AS (SELECT true_class AS class, pred AS rival, n FROM pooled UNION ALL SELECT pred, true_class, n FROM pooled),
w2 AS (SELECT class, rival, sum(n)::BIGINT AS n FROM w GROUP BY 1, 2),
best AS (SELECT * FROM w2 QUALIFY row_number() OVER (PARTITION BY class ORDER BY n DESC, rival) = 1)"""


def _rivals(spark, d):
    pooled = _conf(spark, d).groupBy("true_class", "pred").agg(F.sum("n").alias("n"))
    return metrics.rivals(pooled, [])


@query(f"""WITH {_RIVALS}, {V}, e AS ({_DIMS}), q AS (SELECT label, dim, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM e GROUP BY 1, 2),
s AS (SELECT b.class, b.rival, CAST(a.dim AS INT) AS dim, abs(a.q25 - r.q25) / greatest(a.q75 - a.q25, r.q75 - r.q25, 1e-6) AS score FROM best b JOIN q a ON a.label = b.class JOIN q r ON r.label = b.rival AND r.dim = a.dim),
t AS (SELECT *, max(score) OVER (PARTITION BY class, rival) AS top FROM s)
SELECT class, rival, dim, row_number() OVER (PARTITION BY class, rival ORDER BY score DESC, dim) AS place, round(score, 6) AS score FROM t WHERE score > 0.30 OR top <= 0.30 QUALIFY place <= 3""")
def agg17_separation(spark, d):
    quarts = stats.quartiles(stats.exploded(_saved_vectors(spark, d), ["label"]), ["label", "dim"])
    out = stats.separation(quarts, _rivals(spark, d).select("class", "rival"))
    return _r6(out.select("class", "rival", "dim", "place", "score"), "score")


@query(f"""WITH {V}, e AS ({_DIMS}), mu AS (SELECT label, dim, avg(value) AS mean, stddev_pop(value) AS sd FROM e GROUP BY 1, 2)
SELECT e.label, CAST(e.dim AS INT) AS dim, round(any_value(mean) + 1e-9, 6) AS mean, round(any_value(sd) + 1e-9, 6) AS std, round(CASE WHEN any_value(sd) <= 1e-12 THEN 0 ELSE avg(pow(value - mean, 3)) / pow(any_value(sd), 3) END + 1e-8, 5) AS skew
FROM e JOIN mu ON e.label = mu.label AND e.dim = mu.dim GROUP BY e.label, e.dim""")
def agg18_moments(spark, d):
    out = stats.moments(stats.exploded(vectors(spark, d), ["label"]), ["label", "dim"])
    return _nudged(out, "mean", "std").withColumn("skew", F.round(F.col("skew") + 1e-8, 5))


@query(f"""WITH {FS}, h AS (SELECT split_part(path, '/', 2) AS label, CAST(least(floor(p * 16), 15) AS INT) AS bin FROM f WHERE p >= 0 AND p <= 1), g AS (SELECT label, bin, count(*) AS n FROM h GROUP BY 1, 2)
SELECT label, bin, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM g""")
def agg19_histogram(spark, d):
    rows = filter_scores(spark, d).withColumn("label", F.split_part("path", F.lit("/"), F.lit(2)))
    return _r6(stats.histogram(rows, ["label"], F.col("p"), 16), "share")


@query(f"WITH {_RIVALS} SELECT class, rival, best.n, round(100 * best.n / s.n, 6) AS pct FROM best LEFT JOIN (SELECT true_class, sum(n) AS n FROM c GROUP BY 1) s ON s.true_class = class")
def agg20_rivals(spark, d):
    return _r6(_rivals(spark, d).drop("support"), "pct")


@query(f"WITH {_RIVALS} SELECT DISTINCT least(class, rival) AS a, greatest(class, rival) AS b FROM best")
def agg21_rival_pairs(spark, d):
    return metrics.rival_pairs(_rivals(spark, d), [])


@query(f"WITH {P} SELECT run_tag, true_class, count(*) AS n, round(avg((confidence < 0.6)::INT), 6) AS low_rate FROM p WHERE true_class IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2")
def agg22_low_rate(spark, d):
    return _r6(metrics.low_confidence_rate(predictions(spark, d), R), "low_rate")


@query(f"WITH {M}, s AS (SELECT coalesce(split, 'none') AS old_split, CASE WHEN starts_with(path, 'train/') THEN 'train' WHEN starts_with(path, 'val/') THEN 'val' ELSE 'test' END AS new_split FROM m) SELECT old_split, new_split, count(*) AS n, CAST(grouping_id(old_split, new_split) AS BIGINT) AS level FROM s GROUP BY CUBE (old_split, new_split)")
def agg23_migration(spark, d):
    new = F.when(F.col("path").startswith("train/"), "train").when(F.col("path").startswith("val/"), "val").otherwise("test")
    return metrics.migration(manifest(spark, d).select(F.coalesce("split", F.lit("none")).alias("old_split"), new.alias("new_split")))


@query(f"WITH {M}, k AS (SELECT DISTINCT class_key FROM disease_info WHERE NOT starts_with(class_key, '_')), s AS (SELECT split FROM split_targets) SELECT k.class_key AS final_class, s.split FROM k CROSS JOIN s WHERE (k.class_key, s.split) NOT IN (SELECT (final_class, split) FROM m WHERE final_class IS NOT NULL AND split IS NOT NULL AND is_copy)")
def agg28_empty_cells(spark, d):
    cells = disease_info(spark, d).select(F.col("class_key").alias("final_class")).distinct().join(F.broadcast(table(spark, d, "split_targets").select("split")))
    return cells.join(manifest(spark, d).where("is_copy").select("final_class", "split").distinct(), ["final_class", "split"], "left_anti")


@query(f"""WITH {FS}, g AS (SELECT *, split_part(path, '/', 2) AS label, CASE WHEN p IS NULL OR isnan(p) THEN NULL WHEN p >= 0.85 THEN 'keep' WHEN p <= 0.15 THEN 'drop' ELSE 'uncertain' END AS b FROM f)
SELECT label, count(*) AS n, count(*) FILTER (b IS NULL) AS unreadable, count(*) FILTER (b = 'keep') AS keep, count(*) FILTER (b = 'drop') AS "drop", count(*) FILTER (b = 'uncertain') AS uncertain,
 min(p) FILTER (b = 'uncertain') AS uncertain_low, max(p) FILTER (b = 'uncertain') AS uncertain_high, round(median(p) + 1e-9, 6) AS median_p, round(avg(p) + 1e-9, 6) AS mean_p, count(*) FILTER (b = 'keep') >= 15 AS viable FROM g GROUP BY label""")
def agg30_score_summary(spark, d):
    rows = filter_scores(spark, d).withColumn("label", F.split_part("path", F.lit("/"), F.lit(2)))
    return _nudged(stats.score_summary(rows, ["label"]), "median_p", "mean_p")


@query("SELECT event_type, min(value) AS min_v, round(median(value) + 1e-9, 6) AS median_v, max(value) AS max_v FROM events GROUP BY 1")
def agg31_latency(spark, d):
    return _nudged(stats.latency(table(spark, d, "events"), ["event_type"], "value"), "median_v")


@query(f"WITH {P}, g AS (SELECT path, pred AS cls, avg(confidence) AS m, stddev_pop(confidence) AS s FROM p WHERE confidence IS NOT NULL AND pred IS NOT NULL GROUP BY 1, 2) SELECT path, round(max(s) + 1e-9, 6) AS uncertainty, round(max(m) + 1e-9, 6) AS confidence FROM g GROUP BY path")
def agg33_view_spread(spark, d):
    views = predictions(spark, d).where("confidence IS NOT NULL AND pred IS NOT NULL").select("path", F.col("pred").alias("cls"), F.col("confidence").alias("p"))
    return _nudged(stats.view_spread(views, "path"), "uncertainty", "confidence")


@query(f"WITH {_ratios(NANV)} SELECT run_tag, class, round(f1, 6) AS f1, row_number() OVER (PARTITION BY run_tag ORDER BY CASE WHEN isnan(f1) THEN 1 ELSE 0 END, f1, class) AS place FROM r")
def srt02_worst_classes(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("run_tag").orderBy(F.isnan("f1"), "f1", "class")
    report = metrics.class_report(_conf(spark, d), R, "nan").select("run_tag", "class", "f1")
    return _r6(report.withColumn("place", F.row_number().over(w)), "f1")


# The classes of the knowledge base.
CLASSES = ["angular_leafspot", "anthracnose_fruit_rot", "blossom_blight", "gray_mold", "healthy", "leaf_scorch", "leaf_spot", "powdery_mildew_fruit", "powdery_mildew_leaf"]
_WIDE = ", ".join(f"coalesce(sum(n) FILTER (pred = '{c}'), 0)::BIGINT AS {c}" for c in CLASSES)


@query(f"WITH {CONF} SELECT run_tag, true_class, {_WIDE}, coalesce(sum(n) FILTER (pred NOT IN ({', '.join(repr(c) for c in CLASSES)})), 0)::BIGINT AS other FROM c GROUP BY 1, 2")
def snk02_wide_confusion(spark, d):
    """A column a class of the knowledge base, and one for predictions of any other name."""
    known = sorted(r.class_key for r in disease_info(spark, d).select("class_key").distinct().collect())
    conf = _conf(spark, d).withColumn("pred", F.when(F.col("pred").isin(known), F.col("pred")).otherwise("other"))
    return metrics.wide_confusion(conf, R, [*known, "other"])


@query(f"WITH {P} SELECT run_tag, path, pred, confidence < 0.6 AS low FROM p WHERE confidence IS NOT NULL")
def flt08_low_rule(spark, d):
    return predictions(spark, d).where("confidence IS NOT NULL").select("run_tag", "path", "pred", filters.low_confidence(F.col("confidence"), F.lit(0.0)).alias("low"))
