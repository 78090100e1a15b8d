"""Queries on joins, windows, sampling, neighbours, graphs, decisions and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.functions import clean
from furrow.operators import audit, decision, graph, joins, metrics, sampling, similarity, stats
from furrow.plans.q_metrics import _DIMS, _RIVALS, _rivals, _saved_vectors
from furrow.plans.registry import query
from furrow.plans.sql import M, P, V, base, md5_order, stem
from furrow.session import Scratch
from furrow.sources.tables import disease_info, manifest, predictions, table, vectors

# ---- joins


@query(f"WITH {M}, {P} SELECT m.path, m.split, m.final_class, p.run_tag, p.pred FROM m JOIN p ON m.path = p.path WHERE NOT m.is_copy AND p.pred <> m.final_class")
def joi01_manifest_predictions(spark, d):
    m = manifest(spark, d).where("NOT is_copy").select("path", "split", "final_class")
    return m.join(predictions(spark, d).select("path", "run_tag", "pred"), "path").where("pred != final_class").select("path", "split", "final_class", "run_tag", "pred")


@query(f"""WITH {P}, a AS (SELECT DISTINCT {base('path')} AS file, pred AS pred_a FROM p WHERE run_tag = 'r01_base' AND pred IS NOT NULL), b AS (SELECT DISTINCT {base('path')} AS file, pred AS pred_b FROM p WHERE run_tag = 'r02_base' AND pred IS NOT NULL)
SELECT file, pred_a, pred_b FROM a JOIN b USING (file) WHERE pred_a <> pred_b""")
def joi02_disagreements(spark, d):
    p = predictions(spark, d)
    return joins.disagreements(p.where("run_tag = 'r01_base'"), p.where("run_tag = 'r02_base'"))


@query(f"WITH {M} SELECT path FROM m WHERE path IN (SELECT path FROM filter_scores WHERE p_strawberry >= 0.85)")
def joi03_keep_list(spark, d):
    keep = table(spark, d, "filter_scores").where("p_strawberry >= 0.85").select("path")
    return manifest(spark, d).select("path").join(keep, "path", "left_semi")


@query(f"WITH {M} SELECT path FROM m WHERE split = 'test' AND {base('path')} NOT IN (SELECT {base('path')} FROM m WHERE split = 'train')")
def joi04_clean_names(spark, d):
    m = manifest(spark, d).select("path", "split", clean.base_name("path").alias("name"))
    return m.where("split = 'test'").join(m.where("split = 'train'").select("name"), "name", "left_anti").select("path")


@query(f"WITH {P}, i AS (SELECT * FROM disease_info WHERE NOT starts_with(class_key, '_')) SELECT run_tag, p.path, pred, coalesce(display_name, 'unknown') AS display_name, coalesce(severity, 'unknown') AS severity FROM p LEFT JOIN i ON pred = class_key")
def joi06_knowledge(spark, d):
    p = predictions(spark, d).select("run_tag", "path", "pred")
    return joins.with_default(p, disease_info(spark, d), "pred", "class_key", {"display_name": "unknown", "severity": "unknown"})


_PARENT = rf"regexp_replace(lower({stem('path')}), '(_hard[0-9]+|__dup[0-9]+)+$', '')"


@query(f"""WITH {M}, k AS (SELECT *, {_PARENT} AS photo FROM m), par AS (SELECT photo, min(split) AS lo, max(split) AS hi, count(*) AS n FROM k WHERE NOT is_copy AND photo = lower({stem('path')}) GROUP BY 1)
SELECT k.path, k.photo AS parent, k.split, CASE WHEN n IS NULL THEN 'orphan' WHEN coalesce(lo = k.split OR hi = k.split, false) THEN 'ok' ELSE 'elsewhere' END AS status FROM k LEFT JOIN par USING (photo) WHERE k.photo <> lower({stem('path')})""")
def joi07_parent_split(spark, d):
    k = manifest(spark, d).select("path", "split", "is_copy", clean.photo_key("path").alias("photo"), F.lower(clean.stem("path")).alias("own"))
    copies = k.where("photo != own").select("path", "split", F.col("photo").alias("parent"))
    return joins.parent_check(copies, k.where("NOT is_copy AND photo = own").select(F.col("photo").alias("name"), "split"))


@query(f"WITH {V} SELECT v.vec_id, coalesce(f.p, 0.5) AS p FROM v JOIN features x ON x.vec_id = v.vec_id LEFT JOIN (SELECT path, max(p_strawberry) AS p FROM filter_scores GROUP BY 1) f ON f.path = x.path GROUP BY ALL")
def joi08_fallback(spark, d):
    ids = vectors(spark, d).select("vec_id")
    at = table(spark, d, "features").select("vec_id", "path").distinct().join(ids, "vec_id", "left_semi")
    score = table(spark, d, "filter_scores").groupBy("path").agg(F.max("p_strawberry").alias("p"))
    return at.join(score, "path", "left").select("vec_id", F.coalesce("p", F.lit(0.5)).alias("p")).distinct()


@query(f"""WITH {M}, a AS (SELECT split, final_class, count(*) AS n FROM m GROUP BY 1, 2), b AS (SELECT split_part(path, '/', 1) AS split, split_part(path, '/', 2) AS final_class, count(*) AS n FROM m GROUP BY 1, 2)
SELECT coalesce(a.split, b.split) AS split, coalesce(a.final_class, b.final_class) AS final_class, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM a FULL JOIN b ON a.split IS NOT DISTINCT FROM b.split AND a.final_class IS NOT DISTINCT FROM b.final_class WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def joi12_count_difference(spark, d):
    m = manifest(spark, d)
    disk = m.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("split"), F.split_part("path", F.lit("/"), F.lit(2)).alias("final_class"))
    return joins.count_difference(m.select("split", "final_class"), disk, ["split", "final_class"])


@query(f"WITH {M} SELECT path FROM m WHERE split = 'test' AND hash IN (SELECT hash FROM m WHERE split = 'train' AND hash IS NOT NULL)")
def joi14_contaminated(spark, d):
    m = manifest(spark, d).where("hash IS NOT NULL AND split IS NOT NULL")
    return joins.contaminated(m, "hash", F.col("split") == "test", F.col("split") == "train").select("path")


_SEP = f"""{_RIVALS}, {V}, e AS ({_DIMS}), q AS (SELECT label, dim, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM e GROUP BY 1, 2),
s AS (SELECT b.class, b.rival, a.dim, r.q25 AS r25, r.q75 AS r75, abs(a.q25 - r.q25) / greatest(a.q75 - a.q25, r.q75 - r.q25, 1e-6) AS score FROM best b JOIN q a ON a.label = b.class JOIN q r ON r.label = b.rival AND r.dim = a.dim),
t AS (SELECT *, max(score) OVER (PARTITION BY class, rival) AS top FROM s),
z AS (SELECT * FROM t WHERE score > 0.30 OR top <= 0.30 QUALIFY row_number() OVER (PARTITION BY class, rival ORDER BY score DESC, dim) <= 3)"""


@query(f"WITH {_SEP} SELECT v.vec_id, v.label, z.rival FROM v JOIN z ON v.label = z.class WHERE v.x[z.dim + 1] BETWEEN z.r25 AND z.r75 GROUP BY 1, 2, 3 HAVING count(*) = 3")
def qa01_label_audit(spark, d):
    rows = _saved_vectors(spark, d)
    quarts = stats.quartiles(stats.exploded(rows, ["label"]), ["label", "dim"])
    ranges = stats.separation(quarts, _rivals(spark, d).select("class", "rival"))
    return joins.inside_rival_range(rows, ranges, 3)


@query(f"WITH {P} SELECT path, run_tag, true_class, pred FROM p WHERE true_class = pred AND confidence IS NOT NULL AND true_class IS NOT NULL QUALIFY row_number() OVER (PARTITION BY true_class ORDER BY confidence DESC, path, run_tag) = 1")
def win04_best_per_class(spark, d):
    w = Window.partitionBy("true_class").orderBy(F.desc("confidence"), "path", "run_tag")
    ok = predictions(spark, d).where("true_class = pred AND confidence IS NOT NULL")
    return ok.withColumn("r", F.row_number().over(w)).where("r = 1").select("path", "run_tag", "true_class", "pred")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def win_latest_request(spark, d):
    return joins.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"WITH {P}, n AS (SELECT pred, row_number() OVER (ORDER BY pred) - 1 AS ordinal FROM (SELECT DISTINCT pred FROM p WHERE pred IS NOT NULL)) SELECT pred, ordinal, count(*) AS n FROM p JOIN n USING (pred) GROUP BY 1, 2")
def joi16_ordinal(spark, d):
    p = predictions(spark, d).select("pred").where("pred IS NOT NULL")
    return joins.ordinal(p, "pred").groupBy("pred", "ordinal").agg(F.count("*").alias("n"))


# ---- sampling and splitting

_RANK = f"{V}, r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {md5_order('vec_id', 1)}, vec_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM v)"


@query(f"WITH {_RANK} SELECT vec_id, label, CASE WHEN rk <= greatest(1, least(n - 1, floor(n * 0.75))) THEN 'train' ELSE 'test' END AS split FROM r")
def spl01_two_way(spark, d):
    return sampling.two_way(vectors(spark, d).select("vec_id", "label"), "label", "vec_id", 0.75, 1)


@query(f"""WITH {_RANK}, w AS (SELECT *, greatest(2, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS wt, greatest(2, CAST(round_even(n * 0.2, 0) AS BIGINT)) AS wv FROM r),
w2 AS (SELECT *, greatest(0, least(wv, n - 1 - wt)) AS nv FROM w), w3 AS (SELECT *, greatest(0, least(wt, n - 1 - nv)) AS nt FROM w2)
SELECT vec_id, label, CASE WHEN rk <= n - nv - nt THEN 'train' WHEN rk <= n - nt THEN 'val' ELSE 'test' END AS split FROM w3""")
def spl02_three_way(spark, d):
    return sampling.three_way(vectors(spark, d).select("vec_id", "label"), "label", "vec_id", 1)


@query(f"WITH {M} SELECT path, CASE WHEN CAST('0x' || substr({md5_order('path', 3)}, 1, 8) AS UBIGINT) / 4294967296 < 0.15 THEN 'val' ELSE 'train' END AS split FROM m")
def spl03_holdout(spark, d):
    return sampling.holdout(manifest(spark, d).select("path"), "path", 0.15, 3)


@query(f"WITH {M} SELECT path, final_class, row_number() OVER (PARTITION BY final_class ORDER BY {md5_order('path', 5)}, path) AS rank FROM m WHERE split = 'train' AND final_class IS NOT NULL QUALIFY rank <= 60")
def win05_capped(spark, d):
    rows = manifest(spark, d).where("split = 'train' AND final_class IS NOT NULL").select("path", "final_class")
    return sampling.capped(rows, "final_class", "path", 60, 5)


@query(f"""WITH {M}, c AS (SELECT path, final_class FROM m WHERE final_class IS NOT NULL), k AS (SELECT 900 // count(DISTINCT final_class) AS q FROM c)
SELECT path, final_class, row_number() OVER (PARTITION BY final_class ORDER BY {md5_order('path', 7)}, path) AS rank FROM c QUALIFY rank <= (SELECT q FROM k)""")
def agg34_class_quota(spark, d):
    return sampling.class_quota(manifest(spark, d).where("final_class IS NOT NULL").select("path", "final_class"), "final_class", "path", 900, 7)


@query(f"""WITH {M}, r AS (SELECT path, final_class, row_number() OVER (PARTITION BY final_class ORDER BY {md5_order('path', 9)}, path) AS rk, count(*) OVER (PARTITION BY final_class) AS n FROM m WHERE final_class IS NOT NULL AND split = 'train'),
k AS (SELECT final_class, n, unnest(range(1, greatest(0, 400 - n) + 1)) AS copy_no FROM (SELECT DISTINCT final_class, n FROM r))
SELECT path, final_class, 0 AS copy_no FROM r UNION ALL SELECT path, r.final_class, copy_no FROM k JOIN r ON r.final_class = k.final_class AND r.rk = (k.copy_no - 1) % k.n + 1""")
def win07_oversampled(spark, d):
    rows = manifest(spark, d).where("final_class IS NOT NULL AND split = 'train'").select("path", "final_class")
    return sampling.oversampled(rows, "final_class", "path", 400, 9)


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY path) - 1 AS i FROM (SELECT DISTINCT path, bucket FROM filter_scores WHERE bucket IS NOT NULL AND path IS NOT NULL)) SELECT path, bucket, i // 64 AS page, i % 64 // 8 AS line, i % 8 AS place FROM s")
def win08_sheets(spark, d):
    rows = table(spark, d, "filter_scores").where("bucket IS NOT NULL AND path IS NOT NULL").select("path", "bucket").distinct()
    return sampling.paged(rows, ["bucket"], "path")


# ---- neighbours

_Z = f"""{V}, t AS (SELECT * FROM v WHERE vec_id % 50 <> 0), q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
fit AS (SELECT k, avg(x[k]) AS mean, CASE WHEN stddev_pop(x[k]) = 0 THEN 1 ELSE stddev_pop(x[k]) END AS sd FROM t, range(1, 51) r(k) GROUP BY k),
fl AS (SELECT list(mean ORDER BY k) AS mu, list(sd ORDER BY k) AS sd FROM fit),
tz AS (SELECT vec_id, label, [(x[k] - mu[k]) / sd[k] FOR k IN range(1, 51)] AS z FROM t, fl), qz AS (SELECT vec_id, label, [(x[k] - mu[k]) / sd[k] FOR k IN range(1, 51)] AS z FROM q, fl),
near AS (SELECT qz.vec_id AS id, qz.label, tz.label AS near_label, row_number() OVER (PARTITION BY qz.vec_id ORDER BY round(list_distance(qz.z, tz.z), 9), tz.vec_id) AS rk FROM qz, tz QUALIFY rk <= 15)"""


def _rows(spark, d):
    return vectors(spark, d).select(F.col("vec_id").alias("id"), "label", "x")


def _near(spark, d, k):
    rows = _rows(spark, d)
    held = F.col("id") % 50 == 0
    fit = stats.zscore_fit(rows.where(~held))
    return similarity.nearest(similarity.scaled(rows.where(held), fit), similarity.scaled(rows.where(~held), fit), 50, k)


@query(f"WITH {_Z}, vt AS (SELECT id, label, near_label, count(*) AS votes FROM near WHERE rk <= 3 GROUP BY 1, 2, 3) SELECT id, label, near_label AS pred, votes FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, near_label) = 1")
def ml01_majority_name(spark, d):
    return similarity.majority(_near(spark, d, 3), 3, "name")


@query(f"WITH {_Z}, vt AS (SELECT id, label, near_label, count(*) AS votes, min(rk) AS f FROM near WHERE rk <= 3 GROUP BY 1, 2, 3) SELECT id, label, near_label AS pred, votes FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) = 1")
def ml02_majority_nearest(spark, d):
    return similarity.majority(_near(spark, d, 3), 3)


@query(f"""WITH {V}, c AS (SELECT a.vec_id AS id, a.label, b.label AS near_label, CASE WHEN len(list_filter(a.x, lambda z: z <> 0)) = 0 OR len(list_filter(b.x, lambda z: z <> 0)) = 0 THEN 0 ELSE list_cosine_similarity(a.x, b.x) END AS s, b.vec_id AS nid FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0),
n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, nid) <= 5), w AS (SELECT id, label, near_label, round(sum(greatest(s, 0)), 9) AS weight FROM n GROUP BY 1, 2, 3)
SELECT id, label, near_label AS pred, round(weight, 6) AS weight FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, near_label) = 1""")
def ml03_cosine_weighted(spark, d):
    rows = _rows(spark, d)
    near = similarity.nearest(rows.where("id % 50 = 0"), rows.where("id % 50 != 0"), 50, 5, "cosine")
    return similarity.cosine_weighted(near, 5).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_Z}, vt AS (SELECT id, label, near_label, count(*) AS votes, min(rk) AS f FROM near WHERE rk <= 5 GROUP BY 1, 2, 3) SELECT id, near_label AS pred, round(votes / 5, 6) AS confidence FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) = 1")
def ml04_confidence(spark, d):
    return similarity.majority(_near(spark, d, 5), 5).select("id", "pred", F.round(F.col("votes") / 5, 6).alias("confidence"))


@query(f"""WITH {_Z}, ks AS (SELECT unnest([1, 3, 5, 7, 9, 11, 15]) AS k), vt AS (SELECT k, id, label, near_label, count(*) AS votes, min(rk) AS f FROM near JOIN ks ON rk <= k GROUP BY 1, 2, 3, 4),
b AS (SELECT * FROM vt QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY votes DESC, f) = 1) SELECT k, count(*) AS n, round(avg((label = near_label)::INT), 6) AS accuracy FROM b GROUP BY k""")
def ml05_k_sweep(spark, d):
    preds = similarity.k_sweep(_near(spark, d, 15), [1, 3, 5, 7, 9, 11, 15])
    return preds.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("int")), 6).alias("accuracy"))


@query(f"""WITH {_Z}, vt AS (SELECT id, label, near_label, count(*) AS votes, min(rk) AS f FROM near WHERE rk <= 3 GROUP BY 1, 2, 3), c AS (SELECT label AS t, near_label AS p FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) = 1),
k AS (SELECT t AS class, 1 AS s, 0 AS p, (t = p)::INT AS h FROM c UNION ALL SELECT p, 0, 1, 0 FROM c), a AS (SELECT class, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h) AS h FROM k GROUP BY 1),
b AS (SELECT *, CASE WHEN predicted > 0 THEN h / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN h / support ELSE 0 END AS rc FROM a)
SELECT class, support, predicted, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM b""")
def knn_report(spark, d):
    preds = similarity.knn_evaluation(_rows(spark, d), 50, 3)
    report = metrics.class_report(metrics.confusion(preds.withColumnRenamed("label", "true_class"), []), [], "zero")
    return report.select("class", "support", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# ---- graphs

_EDGES = f"{M}, h AS (SELECT DISTINCT hash FROM m WHERE hash IS NOT NULL), pr AS (SELECT a.hash AS a, b.hash AS b, bit_count(xor(a.hash, b.hash)::BIT) AS dist FROM h a JOIN h b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)::BIT) <= 5)"
# The published bounds of the audit: the widest of the sweep, and the one its leakage report uses.
SWEEP, AUDIT = [6, 10, 14, 18], 10
_CLUSTERS = f"""{_EDGES}, e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT a AS hash, least(a, min(b)) AS root FROM reach GROUP BY a), cm AS (SELECT m.*, coalesce(comp.root, m.hash) AS cluster FROM m LEFT JOIN comp USING (hash) WHERE hash IS NOT NULL)"""


@query(f"WITH {_EDGES} SELECT least(lpad(lower(to_hex(a)), 16, '0'), lpad(lower(to_hex(b)), 16, '0')) AS a16, greatest(lpad(lower(to_hex(a)), 16, '0'), lpad(lower(to_hex(b)), 16, '0')) AS b16, dist FROM pr")
def joi09_hamming_pairs(spark, d):
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    pairs = graph.hamming_pairs(manifest(spark, d), 5)
    return pairs.select(F.least(hexed("a"), hexed("b")).alias("a16"), F.greatest(hexed("a"), hexed("b")).alias("b16"), "dist")


@query(f"WITH RECURSIVE {_CLUSTERS}, n AS (SELECT cluster, min(path) AS first_path, count(*) AS n FROM cm GROUP BY 1) SELECT first_path, n FROM n WHERE n > 1")
def grf01_components(spark, d):
    c = graph.clustered(manifest(spark, d).where("hash IS NOT NULL"), 5)
    return c.groupBy("cluster").agg(F.min("path").alias("first_path"), F.count("*").alias("n")).where("n > 1").select("first_path", "n")


def _sweep_sql(t: int) -> str:
    return f"""SELECT {t} AS t, (SELECT count(*) FROM pr WHERE dist <= {t}) AS n_pairs, count(*) AS n_clusters, count(*) FILTER (n > 1) AS n_multi, max(n) AS largest, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS in_multi,
 count(*) FILTER (torn) AS n_straddling, coalesce(sum(n) FILTER (torn), 0)::BIGINT AS in_straddling, coalesce(sum(nt) FILTER (torn), 0)::BIGINT AS test_in_straddling
 FROM (SELECT cluster, count(*) AS n, count(DISTINCT split) > 1 AS torn, count(*) FILTER (split = 'test') AS nt FROM cm GROUP BY 1)"""


@query(f"WITH RECURSIVE {_CLUSTERS} {_sweep_sql(5)}")
def agg24_cluster_stats(spark, d):
    return graph.threshold_sweep(manifest(spark, d).where("hash IS NOT NULL"), [5])


def _roots(t: int) -> str:
    """Clusters at one bound, the labels of the smallest hash spread along the pairs."""
    return f"""e{t} AS (SELECT a, b FROM pr WHERE dist <= {t} UNION ALL SELECT b, a FROM pr WHERE dist <= {t}),
c{t}(v, root) USING KEY (v) AS (SELECT hash, hash FROM h UNION SELECT e.b, min(c.root) FROM c{t} c JOIN e{t} e ON e.a = c.v JOIN recurring.c{t} r ON r.v = e.b WHERE c.root < r.root GROUP BY e.b),
m{t} AS (SELECT m.*, root AS cluster FROM m JOIN c{t} ON m.hash = v)"""


def _wide_pairs(t: int) -> str:
    return _EDGES.replace("<= 5", f"<= {t}")


@query(f"WITH RECURSIVE {_wide_pairs(max(SWEEP))}, {', '.join(map(_roots, SWEEP))} " + " UNION ALL ".join(_sweep_sql(t).replace("FROM cm", f"FROM m{t}") for t in SWEEP))
def grf02_threshold_sweep(spark, d):
    return graph.threshold_sweep(manifest(spark, d).where("hash IS NOT NULL"), SWEEP)


@query(f"""WITH {_EDGES}, near AS (SELECT a AS x FROM pr UNION SELECT b FROM pr), r0 AS (SELECT coalesce(final_class, '') AS c, path AS p, hash AS h FROM m WHERE hash IS NOT NULL),
f AS (SELECT h, min({{'c': c, 'p': p}}) AS l FROM r0 GROUP BY h),
kept AS (SELECT unnest(list_reduce(list([{{'c': l.c, 'p': l.p, 'h': h}}] ORDER BY l.c, l.p), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: bit_count(xor(k.h, x[1].h)::BIT) <= 5)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM f WHERE h IN (SELECT x FROM near)),
alone AS (SELECT {{'c': l.c, 'p': l.p, 'h': h}} AS k FROM f WHERE h NOT IN (SELECT x FROM near)), ks AS (SELECT * FROM kept UNION ALL SELECT * FROM alone),
cand AS (SELECT r0.p, r0.c, k, 0 AS dist FROM r0 JOIN ks ON k.h = r0.h AND k.p <> r0.p UNION ALL SELECT r0.p, r0.c, k, dist FROM r0 JOIN (SELECT a AS x, b AS y, dist FROM pr UNION ALL SELECT b, a, dist FROM pr) z ON z.x = r0.h JOIN ks ON k.h = z.y),
best AS (SELECT p, arg_min(k, {{'d': dist, 'c': k.c, 'p': k.p}}) AS k, min(dist) AS dist, any_value(c) AS c FROM cand WHERE {{'c': k.c, 'p': k.p}} < {{'c': c, 'p': p}} GROUP BY p)
SELECT m.path, CASE WHEN dist IS NULL THEN 'keep' WHEN dist = 0 THEN 'exact' ELSE 'near' END AS fate, k.p AS rival, coalesce(k.c <> c, false) AS "cross" FROM m LEFT JOIN best ON best.p = m.path""")
def grf03_greedy_dedupe(spark, d):
    return graph.greedy_dedupe(manifest(spark, d))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT cluster_path, n_splits FROM (SELECT min(path) AS cluster_path, count(DISTINCT split) AS n_splits FROM cm GROUP BY cluster) WHERE n_splits > 1")
def agg25_straddling(spark, d):
    c = graph.clustered(manifest(spark, d).where("hash IS NOT NULL"), 5)
    return c.groupBy("cluster").agg(F.min("path").alias("cluster_path"), F.size(F.collect_set("split")).cast("bigint").alias("n_splits")).where("n_splits > 1").drop("cluster")


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT cluster_path, n_classes, n FROM (SELECT min(path) AS cluster_path, count(DISTINCT final_class) AS n_classes, count(*) AS n FROM cm GROUP BY cluster) WHERE n_classes > 1")
def agg26_cross_class(spark, d):
    c = graph.clustered(manifest(spark, d).where("hash IS NOT NULL"), 5)
    out = c.groupBy("cluster").agg(F.min("path").alias("cluster_path"), F.size(F.collect_set("final_class")).cast("bigint").alias("n_classes"), F.count("*").alias("n"))
    return out.where("n_classes > 1").drop("cluster")


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT split, count(*) AS n, count(*) FILTER (cluster IN (SELECT cluster FROM cm WHERE split = 'train')) AS n_bad, round(100.0 * count(*) FILTER (cluster IN (SELECT cluster FROM cm WHERE split = 'train')) / count(*), 4) AS pct FROM cm WHERE split IN ('val', 'test') GROUP BY 1")
def grf04_leakage(spark, d):
    return graph.leakage(graph.clustered(manifest(spark, d).where("hash IS NOT NULL"), 5))


@query(f"""WITH RECURSIVE {_wide_pairs(AUDIT)}, {_roots(AUDIT)}, x AS (SELECT cluster, split, count(*) AS n FROM m{AUDIT} GROUP BY 1, 2), bad AS (SELECT cluster FROM x WHERE split = 'train')
SELECT split, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (cluster IN (SELECT cluster FROM bad)), 0)::BIGINT AS n_bad, round(100.0 * coalesce(sum(n) FILTER (cluster IN (SELECT cluster FROM bad)), 0) / sum(n), 4) AS pct FROM x WHERE split IN ('val', 'test') GROUP BY 1""")
def grf04_leakage_audit(spark, d):
    """GRF01, GRF04 at the bound of the published audit."""
    return graph.leakage(graph.clustered(manifest(spark, d).where("hash IS NOT NULL"), AUDIT))


@query(f"WITH {_wide_pairs(max(SWEEP))}, t AS (SELECT unnest({SWEEP}) AS t) SELECT t::INT AS t, dist, count(*) AS n_pairs FROM pr JOIN t ON dist <= t GROUP BY 1, 2")
def joi09_pairs_by_bound(spark, d):
    pairs = graph.pair_counts(manifest(spark, d), max(SWEEP))
    return pairs.join(F.broadcast(spark.createDataFrame([(t,) for t in SWEEP], "t int")), F.col("dist") <= F.col("t")).select("t", "dist", "n_pairs")


_SPLIT = f"""{_CLUSTERS}, w AS (SELECT cluster, min(path) AS first_path, count(*) AS n FROM cm GROUP BY 1), cc AS (SELECT cluster, coalesce(final_class, '') AS label, count(*) AS k FROM cm GROUP BY 1, 2),
lab AS (SELECT cluster, label FROM cc QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY k DESC, label) = 1),
o AS (SELECT label, first_path, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, {md5_order('first_path', 13)}, first_path) AS i FROM w JOIN lab USING (cluster)),
s(label, i, first_path, n, placed, tr, va, te, split) AS (SELECT label, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT label FROM o)
 UNION ALL SELECT label, i, first_path, n, placed, tr + CASE WHEN split = 'train' THEN n ELSE 0 END, va + CASE WHEN split = 'val' THEN n ELSE 0 END, te + CASE WHEN split = 'test' THEN n ELSE 0 END, split
 FROM (SELECT *, CASE WHEN 0.7::DOUBLE * placed - tr >= 0.2::DOUBLE * placed - va AND 0.7::DOUBLE * placed - tr >= 0.1::DOUBLE * placed - te THEN 'train' WHEN 0.2::DOUBLE * placed - va >= 0.1::DOUBLE * placed - te THEN 'val' ELSE 'test' END AS split
  FROM (SELECT s.label, o.i, o.first_path, o.n, s.placed + o.n AS placed, tr, va, te FROM s JOIN o ON o.label = s.label AND o.i = s.i + 1)))"""


@query(f"WITH RECURSIVE {_SPLIT} SELECT label, first_path AS cluster, n, split FROM s WHERE i > 0")
def spl04_cluster_split(spark, d):
    return _cluster_split(graph.clustered(manifest(spark, d).where("hash IS NOT NULL"), 5))


def _cluster_split(c):
    modal = c.groupBy("cluster", F.coalesce("final_class", F.lit("")).alias("label")).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    # AGG27: a cluster's class is its most frequent one, ties to the first by name; its smallest path names it.
    label = F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")
    clusters = modal.groupBy("cluster").agg(label, F.sum("n").alias("n"), F.min("first_path").alias("first_path")).select("label", F.col("first_path").alias("cluster"), "n")
    return sampling.greedy_cluster_split(clusters, {"train": 0.7, "val": 0.2, "test": 0.1}, 13)


@query(f"""WITH RECURSIVE {_SPLIT}, h10 AS (SELECT a.hash AS a, b.hash AS b FROM h a JOIN h b ON a.hash <> b.hash AND bit_count(xor(a.hash, b.hash)::BIT) <= {AUDIT}),
c10(v, root) USING KEY (v) AS (SELECT hash, hash FROM h UNION SELECT e.b, min(c.root) FROM c10 c JOIN h10 e ON e.a = c.v JOIN recurring.c10 r ON r.v = e.b WHERE c.root < r.root GROUP BY e.b),
aft AS (SELECT cm.path, cm.final_class, s.split, c10.root FROM cm JOIN w USING (cluster) JOIN s ON s.first_path = w.first_path JOIN c10 ON c10.v = cm.hash),
x AS (SELECT 'missing' AS "check", count(*) AS n_found FROM m WHERE path NOT IN (SELECT path FROM aft) UNION ALL SELECT 'unknown', 0
 UNION ALL SELECT 'class_counts', count(*) FROM (SELECT final_class, count(*) AS n FROM m GROUP BY 1) a FULL JOIN (SELECT final_class, count(*) AS n FROM aft GROUP BY 1) b ON a.final_class IS NOT DISTINCT FROM b.final_class WHERE a.n IS DISTINCT FROM b.n
 UNION ALL SELECT 'torn_clusters', count(*) FROM (SELECT root FROM aft GROUP BY 1 HAVING count(DISTINCT split) > 1))
SELECT *, n_found = 0 AS passed FROM x""")
def qa03_verification(spark, d):
    """The split of whole clusters (bound 5), which loses the records without hash, held against the manifest and the wider clusters of the audit."""
    scratch = Scratch(spark)
    before = scratch.save(manifest(spark, d))
    hashed = before.where("hash IS NOT NULL")
    # Both clusterings come from one set of pairs, and each table that is read again is written.
    pairs = scratch.save(graph.hamming_pairs(hashed, AUDIT, scratch=scratch))
    c = scratch.save(graph.clustered(hashed, 5, scratch, pairs.where("dist <= 5")))
    name = c.groupBy("cluster").agg(F.min("path").alias("first_path"))
    split = _cluster_split(c).select(F.col("cluster").alias("first_path"), F.col("split").alias("new_split"))
    after = c.select("path", "final_class", "hash", "cluster").join(name, "cluster").join(split, "first_path").select("path", "final_class", "hash", F.col("new_split").alias("split"))
    after = scratch.save(after)
    return audit.verification(before, after, graph.clustered(after, AUDIT, scratch, pairs))


# ---- decisions

_SCORES = f"""{P}, s AS (SELECT path, pred AS cls, max(confidence) AS p FROM p WHERE pred IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p DESC, cls) AS r FROM s),
t AS (SELECT path, max(cls) FILTER (r = 1) AS top_class, max(p) FILTER (r = 1) AS confidence, coalesce(max(p) FILTER (r = 1) - max(p) FILTER (r = 2), 1.0) AS margin FROM k GROUP BY path)"""


def _scores(spark, d):
    p = predictions(spark, d).where("pred IS NOT NULL AND confidence IS NOT NULL")
    best = p.groupBy("path", "pred").agg(F.max("confidence").alias("p"))
    return best.groupBy("path").agg(F.collect_list(F.struct(F.col("pred").alias("cls"), "p")).alias("scores"))


@query(f"WITH {_SCORES}, g AS (SELECT *, top_class IN ('anthracnose_fruit_rot', 'gray_mold') AND (confidence < 0.65 OR margin < 0.12) AS abstain FROM t) SELECT path, top_class, confidence, round(margin, 6) AS margin, abstain, confidence < 0.6 OR abstain AS low_confidence FROM g")
def flt10_abstain(spark, d):
    out = decision.decide(_scores(spark, d), "scores", ["anthracnose_fruit_rot", "gray_mold"])
    return out.select("path", "top_class", "confidence", F.round("margin", 6).alias("margin"), "abstain", "low_confidence")


@query(f"WITH {_SCORES} SELECT path, cls, p, CAST(r - 1 AS INT) AS place FROM k WHERE r <= 3")
def win01_top3(spark, d):
    out = decision.decide(_scores(spark, d), "scores", [])
    return out.select("path", F.posexplode("top").alias("place", "s")).select("path", "s.cls", "s.p", "place")
