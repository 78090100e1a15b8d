"""Queries on filters, projections, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.functions import clean
from furrow.operators import filters
from furrow.plans.registry import query
from furrow.plans.sql import FS, M, P, base, stem, word
from furrow.sources.tables import disease_info, filter_scores, manifest, predictions, table

_SPLIT = f"CASE WHEN {word('split')} IN ('train','training') THEN 'train' WHEN {word('split')} IN ('val','valid','validation') THEN 'val' WHEN {word('split')} IN ('test','testing') THEN 'test' END"


@query(f"SELECT path, batch_no FROM manifest WHERE {_SPLIT} = 'test' AND {word('is_dup_copy')} IN ('false','0')")
def flt01_test_originals(spark, d):
    return filters.originals(table(spark, d, "manifest"), "test").select("path", "batch_no")


@query(f"SELECT path, batch_no FROM manifest WHERE NOT coalesce({word('is_dup_copy')} IN ('true','t','1','yes','y'), false)")
def flt02_not_copies(spark, d):
    return filters.not_copies(table(spark, d, "manifest")).select("path", "batch_no")


@query(f"SELECT path FROM manifest WHERE NOT contains({stem('path')}, '_hard')")
def flt03_unaugmented(spark, d):
    return filters.unaugmented(table(spark, d, "manifest")).select("path")


@query("SELECT path FROM manifest WHERE lower(path) LIKE '%.jpg' OR lower(path) LIKE '%.jpeg'")
def flt04_suffix(spark, d):
    return filters.with_suffix(table(spark, d, "manifest"), ".jpg", ".jpeg").select("path")


@query(f"WITH {FS} SELECT path, p, bucket, CASE WHEN p IS NULL OR isnan(p) THEN NULL WHEN p >= 0.85 THEN 'keep' WHEN p <= 0.15 THEN 'drop' ELSE 'uncertain' END AS decided FROM f")
def flt05_buckets(spark, d):
    return filter_scores(spark, d).select("path", "p", "bucket", filters.bucket("p").alias("decided"))


@query(f"""WITH {FS}, g AS (SELECT *, CASE WHEN p IS NULL OR isnan(p) THEN NULL WHEN p >= 0.85 THEN 'keep' WHEN p <= 0.15 THEN 'drop' ELSE 'uncertain' END AS decided FROM f)
SELECT path, name, bucket, decided FROM g WHERE bucket IS DISTINCT FROM decided""")
def flt05_bucket_conflicts(spark, d):
    rows = filter_scores(spark, d).withColumn("decided", filters.bucket("p"))
    return rows.where(~F.col("bucket").eqNullSafe(F.col("decided"))).select("path", "name", "bucket", "decided")


@query("""SELECT event_id, CASE WHEN user_id % 17 = 0 THEN 503 WHEN user_id % 5 = 0 THEN 400 WHEN value * 200000 > 10485760 THEN 413
 WHEN event_type = 'error' THEN 400 WHEN event_type NOT IN ('click','view') THEN 415 WHEN value < 0.32 THEN 400 ELSE 200 END AS status FROM events""")
def flt09_upload_status(spark, d):
    e = table(spark, d, "events")
    size = F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("value") * 200000)
    kind = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "click", "JPEG").when(F.col("event_type") == "view", "PNG").otherwise("GIF")
    return e.select("event_id", filters.upload_status(F.col("user_id") % 17 != 0, size, kind, F.col("value") * 100).alias("status"))


@query(f"WITH {P} SELECT run_tag, path, true_class, pred FROM p WHERE true_class IN ('leaf_spot','leaf_scorch','angular_leafspot')")
def flt11_members(spark, d):
    return predictions(spark, d).where(F.col("true_class").isin("leaf_spot", "leaf_scorch", "angular_leafspot")).select("run_tag", "path", "true_class", "pred")


@query(f"WITH {P} SELECT run_tag, path, true_class, pred, confidence FROM p WHERE true_class <> pred AND confidence >= 0.6")
def flt13_confident_wrong(spark, d):
    return filters.misclassified(predictions(spark, d), 0.6).select("run_tag", "path", "true_class", "pred", "confidence")


@query(f"WITH {P} SELECT run_tag, path, confidence FROM p WHERE confidence < 0.6")
def flt14_low_confidence(spark, d):
    return predictions(spark, d).where(filters.low_confidence(F.col("confidence"))).select("run_tag", "path", "confidence")


@query(f"WITH {M} SELECT path, CASE WHEN final_class IN ('anthracnose_fruit_rot','gray_mold','powdery_mildew_fruit') THEN 'fruit_rot' ELSE final_class END AS merged FROM m")
def prj01_merged_label(spark, d):
    return manifest(spark, d).select("path", filters.merged_label("final_class", ["anthracnose_fruit_rot", "gray_mold", "powdery_mildew_fruit"], "fruit_rot").alias("merged"))


@query(f"WITH {M} SELECT path, coalesce(starts_with(source_folder, 'Strawberry___'), false) AS flag, CASE WHEN starts_with(source_folder, 'Strawberry___') THEN 'source_folder' ELSE 'source_folder_not_pv' END AS evidence FROM m")
def prj02_studio_flag(spark, d):
    return manifest(spark, d).select("path", filters.studio_flag().alias("s")).select("path", "s.flag", "s.evidence")


@query(f"WITH {M} SELECT path, 'test/' || regexp_replace(path, '^[^/]*/', '') AS moved FROM m")
def prj03_moved_path(spark, d):
    return manifest(spark, d).select("path", filters.moved_path(F.lit("test")).alias("moved"))


@query(r"SELECT path, regexp_replace(path, '\.jpg$', '_mask.png') AS sibling FROM features WHERE path IS NOT NULL")
def prj04_sibling_path(spark, d):
    return table(spark, d, "features").where("path IS NOT NULL").select("path", filters.sibling_path("path", ".jpg", "_mask.png").alias("sibling"))


@query("SELECT vec_id, " + ", ".join(f"x[{i + 1}] AS Feature{i + 1:03d}" for i in range(50)) + " FROM features WHERE len(x) = 50")
def prj05_wide_features(spark, d):
    f = table(spark, d, "features").where(F.size("x") == 50)
    return f.select("vec_id", *filters.wide_features(f, 50))


@query("""SELECT class_key, coalesce(display_name, class_key) AS display_name, coalesce(severity, 'unknown') AS severity, coalesce(len(symptoms), 0) AS n_symptoms,
 coalesce(len(treatment), 0) AS n_treatment, coalesce(verified, false) AS verified FROM disease_info WHERE NOT starts_with(class_key, '_')""")
def prj06_knowledge_card(spark, d):
    c = disease_info(spark, d).select("class_key", filters.knowledge_card().alias("c"))
    return c.select("class_key", "c.display_name", "c.severity", F.size("c.symptoms").alias("n_symptoms"), F.size("c.treatment").alias("n_treatment"), "c.verified")


@query(f"""WITH {P} SELECT run_tag, path, nullif(concat_ws(' ', CASE WHEN confidence < 0.6 THEN 'Low confidence: take another photo.' END,
 CASE WHEN pred IN ('anthracnose_fruit_rot','gray_mold') AND confidence < 0.65 THEN 'The kind of rot cannot be told apart.' END,
 CASE WHEN pred = 'powdery_mildew_fruit' THEN 'Few examples of this class.' END), '') AS message FROM p""")
def prj07_message(spark, d):
    p = predictions(spark, d)
    rot = F.col("pred").isin("anthracnose_fruit_rot", "gray_mold") & (F.col("confidence") < 0.65)
    return p.select("run_tag", "path", filters.message(filters.low_confidence(F.col("confidence")), rot, F.col("pred") == "powdery_mildew_fruit").alias("message"))


@query("SELECT class_key, CAST(k - 1 AS INT) AS at, symptoms[k] AS item FROM (SELECT class_key, symptoms, unnest(range(1, len(symptoms) + 1)) AS k FROM disease_info)")
def prj08_symptom_rows(spark, d):
    return filters.class_sources(table(spark, d, "disease_info"))


@query(f"""WITH {P}, u AS (SELECT run_tag, path, CAST(round(confidence * 1000000) AS BIGINT) AS x FROM p WHERE confidence IS NOT NULL)
SELECT run_tag, path, (x // 10000 + CASE WHEN x % 10000 > 5000 OR (x % 10000 = 5000 AND (x // 10000) % 2 = 1) THEN 1 ELSE 0 END) / 100 AS conf2 FROM u""")
def prj09_rounded(spark, d):
    """Half to even on the six decimal digits, ties included."""
    exact = F.round(F.col("confidence"), 6).cast("decimal(10,6)")
    return predictions(spark, d).where("confidence IS NOT NULL").select("run_tag", "path", F.bround(exact, 2).cast("double").alias("conf2"))


# Sorts and top-k.


@query(f"WITH {P} SELECT run_tag, path, true_class, pred, confidence FROM p WHERE true_class <> pred AND confidence IS NOT NULL ORDER BY confidence DESC, run_tag, path, pred, true_class LIMIT 12")
def srt01_top_errors(spark, d):
    wrong = filters.misclassified(predictions(spark, d)).where("confidence IS NOT NULL")
    return wrong.select("run_tag", "path", "true_class", "pred", "confidence").orderBy(F.desc("confidence"), "run_tag", "path", "pred", "true_class").limit(12)


@query(f"""WITH {P}, u AS (SELECT run_tag, path, pred, round(1 - confidence, 9) AS uncertainty FROM p)
SELECT run_tag, path, pred, uncertainty, row_number() OVER (PARTITION BY run_tag ORDER BY coalesce(uncertainty, -1) DESC, path, pred) AS place FROM u QUALIFY place <= 20""")
def srt04_most_uncertain(spark, d):
    u = predictions(spark, d).select("run_tag", "path", "pred", F.round(1 - F.col("confidence"), 9).alias("uncertainty"))
    w = Window.partitionBy("run_tag").orderBy(F.coalesce("uncertainty", F.lit(-1.0)).desc(), "path", "pred")
    return u.withColumn("place", F.row_number().over(w)).where("place <= 20")


@query(f"WITH {M} SELECT final_class, path, row_number() OVER (PARTITION BY final_class ORDER BY {base('path')}, path) AS place FROM m WHERE final_class IS NOT NULL QUALIFY place <= 5")
def src06_first_of_class(spark, d):
    w = Window.partitionBy("final_class").orderBy(clean.base_name("path"), "path")
    m = manifest(spark, d).where("final_class IS NOT NULL").select("final_class", "path")
    return m.withColumn("place", F.row_number().over(w)).where("place <= 5")


@query(f"WITH {M} SELECT source_folder, count(*) AS n FROM m WHERE source_folder IS NOT NULL GROUP BY 1 ORDER BY n DESC, source_folder LIMIT 10")
def srt08_largest_sources(spark, d):
    return manifest(spark, d).where("source_folder IS NOT NULL").groupBy("source_folder").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_folder").limit(10)


# Set operations.


@query(f"WITH {M} SELECT path, 'manifest' AS origin FROM m UNION ALL SELECT path, 'scores' FROM (SELECT DISTINCT path FROM filter_scores)")
def set01_bag_union(spark, d):
    a = manifest(spark, d).select("path", F.lit("manifest").alias("origin"))
    return a.unionByName(table(spark, d, "filter_scores").select("path").distinct().select("path", F.lit("scores").alias("origin")))


@query(f"WITH {M} SELECT {base('path')} AS name FROM m WHERE split = 'test' INTERSECT SELECT {base('path')} FROM m WHERE split = 'train'")
def set02_shared_names(spark, d):
    m = manifest(spark, d).select("split", clean.base_name("path").alias("name"))
    return m.where("split = 'test'").select("name").intersect(m.where("split = 'train'").select("name"))


@query(f"WITH {P} SELECT true_class AS class FROM p WHERE true_class IS NOT NULL UNION SELECT pred FROM p WHERE pred IS NOT NULL")
def set03_class_domain(spark, d):
    p = predictions(spark, d)
    return p.select(F.col("true_class").alias("class")).union(p.select("pred")).where("class IS NOT NULL").distinct()


@query("SELECT path FROM predictions WHERE path IS NOT NULL EXCEPT SELECT path FROM manifest")
def set04_unknown_paths(spark, d):
    return table(spark, d, "predictions").select("path").where("path IS NOT NULL").subtract(table(spark, d, "manifest").select("path"))


@query(f"""WITH {M}, a AS (SELECT split, final_class, count(*) AS n FROM m GROUP BY 1, 2), b AS (SELECT split, final_class, count(*) AS n FROM m WHERE NOT is_copy GROUP BY 1, 2)
SELECT 'a' AS side, split, final_class, n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'b', split, final_class, n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def set06_count_mismatch(spark, d):
    m = manifest(spark, d)
    a = m.groupBy("split", "final_class").agg(F.count("*").alias("n"))
    b = m.where("NOT is_copy").groupBy("split", "final_class").agg(F.count("*").alias("n"))
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "split", "final_class", "n")
    return tag(a.exceptAll(b), "a").unionByName(tag(b.exceptAll(a), "b"))


# Scalar functions.


@query(rf"""WITH {M} SELECT path, {base('path')} AS file, {stem('path')} AS stem, split_part(path, '/', 2) AS folder, upper(substr(final_class, 1, 1)) || substr(replace(final_class, '_', ' '), 2) AS shown,
 regexp_replace(path, '[/.]', '_', 'g') AS cache_key, CASE WHEN hash IS NOT NULL THEN lpad(lower(to_hex(hash)), 16, '0') END AS hash16 FROM m""")
def fun_strings(spark, d):
    m = manifest(spark, d)
    shown = F.replace("final_class", F.lit("_"), F.lit(" "))
    return m.select(
        "path", clean.base_name("path").alias("file"), clean.stem("path").alias("stem"), F.split_part("path", F.lit("/"), F.lit(2)).alias("folder"),
        F.concat(F.upper(F.substring(shown, 1, 1)), F.substring(shown, 2, 1000)).alias("shown"), F.regexp_replace("path", "[/.]", "_").alias("cache_key"), F.lpad(F.lower(F.hex("hash")), 16, "0").alias("hash16"),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN value * 1000 < 1024 THEN CAST(CAST(floor(value * 1000) AS BIGINT) AS VARCHAR) || ' B' ELSE CAST(CAST(floor(value * 1000 / 1024) AS BIGINT) AS VARCHAR) || ' KB' END AS shown FROM events""")
def fun_json_sizes(spark, d):
    e = table(spark, d, "events")
    size = F.col("value") * 1000
    shown = F.when(size < 1024, F.concat(F.floor(size).cast("string"), F.lit(" B"))).otherwise(F.concat(F.floor(size / 1024).cast("string"), F.lit(" KB")))
    return e.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"), shown.alias("shown"))


@query(f"""WITH e AS (SELECT vec_id, [exp(z - list_max(l)) FOR z IN l] AS x FROM (SELECT vec_id, [CAST(q AS DOUBLE) * 4 FOR q IN embedding] AS l FROM embeddings))
SELECT vec_id, round(list_max(x) / list_sum(x), 6) AS top_p, list_position(x, list_max(x)) AS top_at FROM e""")
def fun_softmax(spark, d):
    z = F.transform("embedding", lambda q: q.cast("double") * 4)
    e = table(spark, d, "embeddings").select("vec_id", z.alias("z")).select("vec_id", F.transform("z", lambda q: F.exp(q - F.array_max("z"))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, q: s + q)
    return e.select("vec_id", F.round(F.array_max("x") / total, 6).alias("top_p"), F.array_position("x", F.array_max("x")).alias("top_at"))
