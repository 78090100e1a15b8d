"""Queries on sources, sinks, audits and streams; files are written to the shared scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from furrow.operators import audit, image, metrics
from furrow.plans.q_images import CHANNELS, colour_images
from furrow.plans.q_metrics import CONF, ZEROV, _ratios
from furrow.plans.registry import query
from furrow.plans.sql import FS, M, base
from furrow.session import shared_dir
from furrow.sources import files, sinks
from furrow.sources.tables import filter_scores, manifest, predictions, table
from furrow.streaming import latest


def _at(spark, name: str) -> str:
    return f"{shared_dir(spark)}/furrow-files-{uuid.uuid4().hex[:12]}/{name}"


@query("SELECT path, final_class, split, is_dup_copy, dup_source, dhash FROM manifest")
def src12_manifest_csv(spark, d):
    at = _at(spark, "manifest.csv")
    sinks.write_csv(table(spark, d, "manifest").select([c.split()[0] for c in files.MANIFEST.split(", ")]), at)
    return files.read_csv(spark, at, files.MANIFEST).select("path", "final_class", "split", "is_dup_copy", "dup_source", "dhash")


@query(f"WITH {CONF}, k AS (SELECT true_class AS c FROM c WHERE true_class IS NOT NULL UNION SELECT pred FROM c WHERE pred IS NOT NULL) SELECT a.c AS true_class, b.c AS pred, coalesce(sum(n), 0)::BIGINT AS n FROM k a CROSS JOIN k b LEFT JOIN c ON c.true_class = a.c AND c.pred = b.c GROUP BY 1, 2")
def src13_snk02_matrix(spark, d):
    conf, at = metrics.confusion(predictions(spark, d), []), _at(spark, "confusion.csv")
    names = metrics.observed_classes(conf)
    sinks.write_matrix(conf, at, names)
    return files.read_matrix(spark, f"{at}/part-*.csv", names)


@query(f"WITH {_ratios(ZEROV).replace('SELECT DISTINCT run_tag, path', "SELECT DISTINCT 'all' AS run_tag, run_tag AS tag, path")} SELECT class, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def agg06_report_stored(spark, d):
    """AGG06d: metrics recomputed from the matrix as it was stored."""
    conf, at = metrics.confusion(predictions(spark, d), []), _at(spark, "confusion.csv")
    names = metrics.observed_classes(conf)
    sinks.write_matrix(conf, at, names)
    report = metrics.class_report(files.read_matrix(spark, f"{at}/part-*.csv", names), [], "zero")
    return report.select("class", "support", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {CONF} SELECT run_tag AS tag, sum(n)::INT AS n_test, round(sum(n) FILTER (true_class = pred) / sum(n), 6) AS overall_top1 FROM c GROUP BY 1")
def src14_snk03_document(spark, d):
    acc = metrics.accuracy(metrics.confusion(predictions(spark, d), ["run_tag"]), ["run_tag"])
    at = _at(spark, "eval.json")
    sinks.write_document(acc.select(F.col("run_tag").alias("tag"), F.col("n").cast("int").alias("n_test"), F.round("accuracy", 6).alias("overall_top1"), F.lit(float("nan")).alias("macro_f1")), at)
    back = files.read_document(spark, at, files.EVALUATION, lines=True)
    return back.where(F.isnan("macro_f1")).select("tag", "n_test", "overall_top1")


@query("SELECT class_key, display_name, len(symptoms) AS n_symptoms FROM disease_info WHERE NOT starts_with(class_key, '_')")
def src14_knowledge_json(spark, d):
    at = _at(spark, "knowledge")
    cols = ["display_name", "summary", "cause", "symptoms", "treatment", "prevention", "severity", "spread", "uncertainty", "verified", "organ"]
    entry = F.concat(F.to_json("class_key_s"), F.lit("")).alias("k")
    rows = table(spark, d, "disease_info").withColumn("class_key_s", F.struct("class_key")).select(entry, "class_key", F.to_json(F.struct(*cols)).alias("v"))
    text = rows.agg(F.concat(F.lit("{"), F.concat_ws(",", F.collect_list(F.concat(F.lit('"'), F.col("class_key"), F.lit('":'), F.col("v")))), F.lit("}")).alias("value"))
    text.coalesce(1).write.text(at)
    back = files.read_keyed(spark, at, files.ENTRY)
    return back.select("class_key", "value.display_name", F.when(F.col("value.symptoms").isNotNull(), F.size("value.symptoms")).alias("n_symptoms"))


@query(f"WITH {M} SELECT path, split, final_class FROM m WHERE split = 'val' AND final_class = 'healthy'")
def snk05_tree(spark, d):
    at = _at(spark, "tree")
    sinks.write_tree(manifest(spark, d).select("path", "split", "final_class"), at, "split", "final_class")
    return spark.read.parquet(at).where("split = 'val' AND final_class = 'healthy'").select("path", "split", "final_class")


@query(f"WITH {FS} SELECT path, p, bucket FROM f")
def src15_snk04_cached(spark, d):
    return files.cached(filter_scores(spark, d).select("path", "p", "bucket"), _at(spark, "cache"), "1")


def _written(spark, rows, at: str) -> None:
    """Files (name, data) below a folder, written by the executors."""
    uri = "file://" + at.removeprefix("file:").removeprefix("//") if at.startswith(("/", "file:")) else at

    def write(part):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for r in part:
            store.create_dir(f"{root}/{r.name}".rpartition("/")[0], recursive=True)
            with store.open_output_stream(f"{root}/{r.name}") as out:
                out.write(bytes(r.data))

    rows.select("name", "data").foreachPartition(write)


def _tree(spark, d):
    """A tiny file a photograph and, for those whose name ends in an even digit, a processed one and a note beside it."""
    at = _at(spark, "images")
    paths = table(spark, d, "features").where("path IS NOT NULL").select("path").distinct()
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    beside = F.when(stem.rlike("[02468]$"), F.array(F.concat(stem, F.lit("_preprocessed.png")), F.concat(stem, F.lit("_notes.txt")))).otherwise(F.array().cast("array<string>"))
    _written(spark, paths.select(F.explode(F.concat(F.array("path"), beside)).alias("name"), F.encode(F.lit("x"), "UTF-8").alias("data")), at)
    return at


_FILES = "f AS (SELECT DISTINCT path, split_part(path, '/', 2) AS label, regexp_matches(regexp_replace(path, '\\.[^.]*$', ''), '[02468]$') AS two, regexp_replace(path, '\\.[^.]*$', '') AS stem FROM features WHERE path IS NOT NULL)"


@query("SELECT split_part(path, '/', 2) AS label, count(*) AS n FROM (SELECT DISTINCT path FROM features WHERE path IS NOT NULL) GROUP BY 1")
def src03_class_listing(spark, d):
    """Every photograph, listed without reading it; processed images are not originals."""
    listing = files.image_listing(spark, _tree(spark, d))
    return files.class_listing(listing.where(~F.endswith("name", F.lit("_preprocessed.png"))))


@query(f"WITH {_FILES} SELECT label, parse_filename(stem) || '_preprocessed.png' AS name, 1::BIGINT AS length FROM f WHERE two GROUP BY ALL")
def src02_processed_files(spark, d):
    return files.image_listing(spark, _tree(spark, d), ends_with="_preprocessed.png").select("label", "name", "length").distinct()


@query(f"WITH {_FILES}, n AS (SELECT label, count(DISTINCT stem) AS n FROM f WHERE two AND split_part(path, '/', 1) = 'test' GROUP BY 1) SELECT class_key AS label, coalesce(n, 0) AS n FROM disease_info LEFT JOIN n ON label = class_key WHERE NOT starts_with(class_key, '_')")
def src04_listing_with_empty_classes(spark, d):
    """SRC04, SRC05, SRC09: processed images of one folder, with the classes that have none."""
    classes = table(spark, d, "disease_info").where("class_key NOT LIKE '\\_%'").select(F.col("class_key").alias("label"))
    return files.class_listing(files.image_listing(spark, f"{_tree(spark, d)}/test", ends_with="_preprocessed.png"), classes)


def _png(r) -> bytes:
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + bytes(r["data"][i : i + 3 * r["w"]]) for i in range(0, len(r["data"]), 3 * r["w"]))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", r["w"], r["h"], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@query(f"WITH {CHANNELS}, s AS (SELECT vec_id, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM px GROUP BY 1) SELECT vec_id, vec_id % 10 <> 3 AS readable, CASE WHEN vec_id % 10 <> 3 THEN r END AS r, CASE WHEN vec_id % 10 <> 3 THEN g END AS g, CASE WHEN vec_id % 10 <> 3 THEN b END AS b FROM s")
def src10_src11_decoded(spark, d):
    """Image files in colour, a tenth of them cut short, decoded again: sums of the channels, and which could not be read."""
    at = _at(spark, "png")
    rows = colour_images(spark, d)
    png = F.udf(lambda w, h, data: _png({"w": w, "h": h, "data": data}), "binary", useArrow=True)
    whole = png("w", "h", "data")
    cut = F.when(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint") % 10 == 3, F.substring(whole, 1, 40)).otherwise(whole)
    _written(spark, rows.select(F.substring("path", 2, 1 << 20).alias("name"), cut.alias("data")), at)
    sums = image.mapped(image.decoded(spark, at, keep_unreadable=True), lambda a: dict(zip("rgb", a.astype(int).sum((0, 1)).tolist())), "r bigint, g bigint, b bigint")
    return sums.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("vec_id"), F.col("r").isNotNull().alias("readable"), "r", "g", "b")


@query("SELECT event_id, value * 2 AS score, CAST(NULL AS VARCHAR) AS error FROM events")
def src18_scored(spark, d):
    import pandas as pd

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": pdf.value * 2})

    return files.scored(table(spark, d, "events").select("event_id", "value"), score, "score double").drop("value")


@query(rf"""WITH {M}, a AS (SELECT split, final_class, count(*) AS n FROM m GROUP BY 1, 2), b AS (SELECT split_part(path, '/', 1) AS split, split_part(path, '/', 2) AS final_class, count(*) AS n FROM m GROUP BY 1, 2),
x AS (SELECT 'count_mismatch' AS "check", count(*) AS n_found FROM (SELECT 1 FROM a FULL JOIN b ON a.split IS NOT DISTINCT FROM b.split AND a.final_class IS NOT DISTINCT FROM b.final_class WHERE coalesce(a.n, 0) <> coalesce(b.n, 0))
 UNION ALL SELECT 'name_leak', count(*) FROM (SELECT {base('path')} FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'hash_leak', count(*) FROM (SELECT hash FROM m WHERE hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 'augmented_outside_train', count(*) FROM m WHERE split <> 'train' AND regexp_matches(lower(regexp_replace({base('path')}, '\.[^.]*$', '')), '_hard[0-9]+|__dup[0-9]+'))
SELECT *, n_found = 0 AS passed FROM x""")
def qa02_validation(spark, d):
    return audit.validation(manifest(spark, d))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark, d):
    return latest.drained(latest.latest_wins(latest.table_stream(spark, d, "events"), "user_id", "event_id", "event_type"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    out = latest.drained(latest.windowed_counts(latest.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"))
    return out.select(F.col("window.start").alias("hour"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


