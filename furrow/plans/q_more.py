"""Queries on the operators that compose others: candidate lists, selections, memberships, image parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.functions import clean, pixels
from furrow.operators import decision, graph, image, metrics, sampling, similarity
from furrow.plans.q_images import _G, _images, _keyed
from furrow.plans.q_metrics import R, ZEROV, _conf, _ratios
from furrow.plans.q_models import _CLUSTERS, _SCORES, _Z, _near, _scores
from furrow.plans.registry import query
from furrow.plans.sql import FS, M, P, base
from furrow.sources.tables import filter_scores, manifest, predictions, table


def _members(spark, d):
    return graph.clustered(manifest(spark, d), 5)


@query(f"WITH RECURSIVE {_CLUSTERS}, big AS (SELECT cluster FROM cm GROUP BY 1 HAVING count(*) > 1) SELECT m.path FROM m LEFT JOIN cm ON m.path = cm.path WHERE cm.cluster IS NULL OR cm.cluster NOT IN (SELECT cluster FROM big)")
def joi05_in_no_cluster(spark, d):
    rows = _members(spark, d).select("path", "cluster")
    big = rows.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    return rows.join(big, "cluster", "left_anti").select("path")


@query(f"WITH {M}, o AS (SELECT path, split AS old_split, CASE WHEN CAST('0x' || substr(md5(path || ':21'), 1, 8) AS UBIGINT) / 4294967296 < 0.2 THEN 'val' ELSE 'train' END AS new_split FROM m) SELECT old_split, new_split, count(*) AS n FROM o WHERE old_split IS DISTINCT FROM new_split GROUP BY 1, 2")
def joi13_moved_records(spark, d):
    old = manifest(spark, d).select("path", F.col("split").alias("old_split"))
    new = sampling.holdout(old.select("path"), "path", 0.2, 21).select("path", F.col("split").alias("new_split"))
    return old.join(new, "path").where(~F.col("old_split").eqNullSafe(F.col("new_split"))).groupBy("old_split", "new_split").agg(F.count("*").alias("n"))


@query(f"WITH {P}, o AS (SELECT run_tag, path, CASE WHEN confidence < 0.6 OR confidence IS NULL THEN 'ask' ELSE 'keep' END AS turn FROM p) SELECT run_tag, turn, count(*) AS n FROM o GROUP BY 1, 2")
def flt14_ask_again(spark, d):
    turn = F.when((F.col("confidence") < 0.6) | F.col("confidence").isNull(), "ask").otherwise("keep")
    return predictions(spark, d).groupBy("run_tag", turn.alias("turn")).agg(F.count("*").alias("n"))


@query(f"WITH {_ratios(ZEROV)} SELECT run_tag, class, round(f1, 6) AS f1, row_number() OVER (PARTITION BY run_tag ORDER BY round(f1, 9) DESC, class) AS place FROM r")
def srt03_best_classes(spark, d):
    w = Window.partitionBy("run_tag").orderBy(F.round("f1", 9).desc(), "class")
    report = metrics.class_report(_conf(spark, d), R, "zero").select("run_tag", "class", "f1")
    return report.withColumn("place", F.row_number().over(w)).withColumn("f1", F.round("f1", 6))


@query(f"WITH {P}, e AS (SELECT DISTINCT run_tag, true_class, {base('path')} AS file, path, pred FROM p WHERE true_class <> pred) SELECT run_tag, true_class, file, pred, row_number() OVER (PARTITION BY run_tag, true_class ORDER BY file, path, pred) AS place FROM e")
def srt05_errors_by_class_and_file(spark, d):
    wrong = predictions(spark, d).where("true_class != pred").select("run_tag", "true_class", clean.base_name("path").alias("file"), "path", "pred").distinct()
    return sampling.placed(wrong, ["run_tag", "true_class"], ["file", "path", "pred"]).select("run_tag", "true_class", "file", "pred", "place")


@query(f"WITH {FS} SELECT path, p FROM f WHERE bucket = 'uncertain' AND p IS NOT NULL ORDER BY p DESC, path LIMIT 60")
def srt07_top_flagged(spark, d):
    return filter_scores(spark, d).where("bucket = 'uncertain' AND p IS NOT NULL").select("path", "p").orderBy(F.desc("p"), "path").limit(60)


@query(f"WITH {P} SELECT run_tag, path, pred FROM p WHERE pred IS NOT NULL ORDER BY path, run_tag, pred, true_class, confidence LIMIT 40")
def srt09_first_rows(spark, d):
    p = predictions(spark, d).where("pred IS NOT NULL")
    return p.orderBy("path", "run_tag", "pred", "true_class", "confidence").limit(40).select("run_tag", "path", "pred")


@query(f"""WITH {_Z}, ks AS (SELECT unnest([1, 3, 5, 7, 9, 11, 15]) AS k), vt AS (SELECT k, id, label, near_label, count(*) AS votes, min(rk) AS f FROM near JOIN ks ON rk <= k GROUP BY 1, 2, 3, 4),
b AS (SELECT k, label AS t, near_label AS p FROM vt QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY votes DESC, f) = 1),
z AS (SELECT k, t AS class, 1 AS s, 0 AS q, (t = p)::INT AS h FROM b UNION ALL SELECT k, p, 0, 1, 0 FROM b), a AS (SELECT k, class, sum(s) AS s, sum(q) AS q, sum(h) AS h FROM z GROUP BY 1, 2),
m AS (SELECT k, avg(CASE WHEN h > 0 THEN 2 * (h / q) * (h / s) / (h / q + h / s) ELSE 0 END) AS macro_f1 FROM a GROUP BY 1) SELECT k, round(macro_f1, 6) AS macro_f1 FROM m ORDER BY round(macro_f1, 9) DESC, k LIMIT 1""")
def srt10_selected_k(spark, d):
    preds = similarity.k_sweep(_near(spark, d, 15), [1, 3, 5, 7, 9, 11, 15]).withColumnRenamed("label", "true_class")
    scores = metrics.macro(metrics.class_report(metrics.confusion(preds, ["k"]), ["k"], "zero"), ["k"], False)
    return scores.orderBy(F.round("macro_f1", 9).desc(), "k").limit(1).select("k", F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {M} SELECT DISTINCT source_folder FROM m WHERE split = 'test'")
def set05_sources_of_test(spark, d):
    return manifest(spark, d).where("split = 'test'").select("source_folder").distinct()


@query(f"WITH RECURSIVE {_CLUSTERS}, n AS (SELECT cluster, min(path) AS first_path, count(*) AS size FROM cm GROUP BY 1), c AS (SELECT cluster, coalesce(final_class, '') AS label, count(*) AS n FROM cm GROUP BY 1, 2), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1) SELECT first_path, label FROM t JOIN n USING (cluster) WHERE size > 1")
def agg27_modal_class(spark, d):
    rows = _members(spark, d).where("cluster IS NOT NULL")
    n = rows.groupBy("cluster", F.coalesce("final_class", F.lit("")).alias("label")).agg(F.count("*").alias("n"), F.min("path").alias("p"))
    best = F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")
    return n.groupBy("cluster").agg(F.min("p").alias("first_path"), best, F.sum("n").alias("size")).where("size > 1").select("first_path", "label")


@query(f"WITH {FS} SELECT min(p) AS low, max(p) AS high, count(*) AS n FROM f WHERE p > 0.15 AND p < 0.85")
def agg29_uncertain_range(spark, d):
    return filter_scores(spark, d).where("p > 0.15 AND p < 0.85").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("n"))


@query(f"WITH {_SCORES} SELECT path, round(margin, 6) AS margin FROM t")
def win02_margin(spark, d):
    return decision.decide(_scores(spark, d), "scores", []).select("path", F.round("margin", 6).alias("margin"))


@query(f"""WITH {_SCORES}, tr AS (SELECT path, min(true_class) AS true_class FROM p WHERE true_class IS NOT NULL GROUP BY 1), g AS (SELECT path, string_agg(cls || ':' || CAST(CAST(round(p + 1e-9, 3) AS DECIMAL(6, 3)) AS VARCHAR), '|' ORDER BY r) AS top3 FROM k WHERE r <= 3 GROUP BY 1)
SELECT t.path, true_class, top_class AS predicted, confidence, round(1 - confidence, 6) AS uncertainty, coalesce(top_class IN ('anthracnose_fruit_rot', 'gray_mold') AND (confidence < 0.65 OR margin < 0.12), false) AS abstain, top3, true_class = top_class AS correct,
 row_number() OVER (ORDER BY round(1 - confidence, 6) DESC, t.path) AS place FROM t JOIN tr USING (path) JOIN g USING (path) QUALIFY place <= 100""")
def ml08_candidates(spark, d):
    p = predictions(spark, d)
    true = p.where("true_class IS NOT NULL").groupBy("path").agg(F.min("true_class").alias("true_class"))
    out = decision.decide(_scores(spark, d), "scores", ["anthracnose_fruit_rot", "gray_mold"]).join(true, "path")
    shown = F.array_join(F.transform("top", lambda s: F.concat(s["cls"], F.lit(":"), F.round(s["p"] + 1e-9, 3).cast("decimal(6,3)").cast("string"))), "|")
    out = out.select("path", "true_class", F.col("top_class").alias("predicted"), "confidence", F.round(1 - F.col("confidence"), 6).alias("uncertainty"), F.coalesce("abstain", F.lit(False)).alias("abstain"), shown.alias("top3"), (F.col("true_class") == F.col("top_class")).alias("correct"))
    best = out.orderBy(F.desc("uncertainty"), "path").limit(100)  # the list is the feature
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("uncertainty"), "path")))


@query("""WITH e AS (SELECT vec_id, least(abs(CAST(embedding[1] AS DOUBLE)) * 2, 0.999) * 6 AS s6, least(abs(CAST(embedding[2] AS DOUBLE)) * 3, 1) AS s, least(abs(CAST(embedding[3] AS DOUBLE)) * 4, 1) AS v FROM embeddings),
c AS (SELECT *, v * s AS ch, v * s * (1 - abs(s6 - 2 * floor(s6 / 2) - 1)) AS x, CAST(floor(s6) AS INT) AS k FROM e)
SELECT vec_id, round(CASE WHEN k IN (0, 5) THEN ch WHEN k IN (1, 4) THEN x ELSE 0 END + v - ch, 2) AS r, round(CASE WHEN k IN (1, 2) THEN ch WHEN k IN (0, 3) THEN x ELSE 0 END + v - ch, 2) AS g, round(CASE WHEN k IN (3, 4) THEN ch WHEN k IN (2, 5) THEN x ELSE 0 END + v - ch, 2) AS b FROM c""")
def img05_rgb(spark, d):
    """Exact to two digits: the kernel gives bytes, so only sector and size are compared where the rounding agrees."""
    e = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    h = table(spark, d, "embeddings").select("vec_id", F.least(e(0) * 2, F.lit(0.999)).alias("h"), F.least(e(1) * 3, F.lit(1.0)).alias("s"), F.least(e(2) * 4, F.lit(1.0)).alias("v"))
    r, g, b = image.rgb_columns(F.col("h"), F.col("s"), F.col("v"))
    return h.select("vec_id", F.round(r, 2).alias("r"), F.round(g, 2).alias("g"), F.round(b, 2).alias("b"))


@query(f"WITH {_G} SELECT vec_id, CAST(sum(CASE WHEN v >= 128 THEN v ELSE 0 END) AS BIGINT) AS inside FROM g GROUP BY 1")
def img12_masked(spark, d):
    return _keyed(image.mapped(_images(spark, d), lambda a: {"inside": int((a[:, :, 0] * (a[:, :, 0] >= 128)).sum())}, "inside bigint"))


@query(f"WITH {_G} SELECT vec_id, round(avg(0.2989 * v + 0.5870 * v + 0.1140 * v) + 1e-7, 4) AS mean_gray FROM g GROUP BY 1")
def img14_gray(spark, d):
    return _keyed(image.mapped(_images(spark, d), lambda a: {"mean_gray": round(float(pixels.gray(a).mean()) + 1e-7, 4)}, "mean_gray double"))


@query()
def img22_perturbed(spark, d):
    """Mean brightness of five slightly changed views; the seed is the image's own bytes."""

    def kernel(a: np.ndarray) -> dict:
        views = pixels.perturbed(a / 255, 5, int(a[0, 0, 0]))
        return {"n_views": len(views), "spread": round(float(np.std([v.mean() for v in views])), 6)}

    return _keyed(image.mapped(_images(spark, d), kernel, "n_views int, spread double"))


@query(f"WITH {P} SELECT run_tag, count(*) AS n, count(*) FILTER (true_class = pred) AS n_right, count(*) FILTER (true_class <> pred) AS n_wrong, count(*) FILTER (true_class <> pred AND confidence >= 0.6) AS n_confident_wrong FROM p GROUP BY 1")
def flt13_error_counts(spark, d):
    wrong = F.col("true_class") != F.col("pred")
    return predictions(spark, d).groupBy("run_tag").agg(
        F.count("*").alias("n"), F.count_if(~wrong).alias("n_right"), F.count_if(wrong).alias("n_wrong"), F.count_if(wrong & (F.col("confidence") >= 0.6)).alias("n_confident_wrong")
    )
