"""File sources: labelled image folders, CSV and JSON documents, cached tables, scoring services (SRC01-SRC18)."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.session import Scratch

IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")

MANIFEST = ("path string, final_class string, source_folder string, is_plantvillage string, pv_evidence string, split string, is_dup_copy string, dup_source string, dhash string")
PREDICTIONS = ("path string, true string, pred string, correct int, is_plantvillage string, confidence double")
SCORES = ("path string, name string, p_strawberry double, bucket string")
SWEEP = ("k int, val_macro_f1 double, val_macro_recall double, val_macro_precision double, val_accuracy double, test_macro_f1 double, test_macro_recall double, test_macro_precision double, test_accuracy double, test_n int")
EVALUATION = (
    "weights string, tag string, n_test int, overall_top1 double, macro_top1 double, macro_precision double, macro_recall double, macro_f1 double, weighted_f1 double, "
    "majority_class_baseline struct<class:string,accuracy:double,note:string>, "
    "per_class array<struct<class:string,support:int,accuracy:double,precision:double,recall:double,f1:double,predicted:int>>, "
    "confused_pairs_top10 array<struct<true:string,pred:string,count:int,share_of_true:double>>, pv_other_gap double"
)
ENTRY = (
    "display_name string, summary string, cause string, symptoms array<string>, treatment array<string>, prevention array<string>, severity string, spread string, "
    "uncertainty string, verified boolean, disease_group string, organ string, group_display_name string, group_note string"
)


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, whether a folder) of what lies in a folder, hidden names left out as Spark does."""
    hidden = lambda name: name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    if folder.startswith(("/", "file:")):
        # A large folder is passed through, never held.
        with os.scandir("/" + folder.removeprefix("file:").lstrip("/")) as found:
            for e in found:
                if not hidden(e.name):
                    yield f"file:{e.path}", 0 if e.is_dir() else e.stat().st_size, e.is_dir()
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        for e in store.get_file_info(fs.FileSelector(at)):
            if not hidden(e.base_name):
                yield f"{folder.rstrip('/')}/{e.base_name}", e.size or 0, e.type == fs.FileType.Directory


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "length", "folder"]
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            found = _entries(folder)
            while part := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int64(), pa.bool_()))], names=names)


def listing(spark: SparkSession, root: str, recursive: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """path, length of every file below ``root``; the executors list the folders, level by level, so the driver holds no file's name."""
    scratch = scratch or Scratch(spark)
    folders, out = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = scratch.save(folders.mapInArrow(_listed, "path string, length bigint, folder boolean"))
        part = level.where("NOT folder").select("path", "length")
        out = part if out is None else out.unionByName(part)
        folders = level.where("folder").select("path")
        if not recursive or folders.isEmpty():
            return out
        folders = folders.repartition(spark.sparkContext.defaultParallelism)


def image_listing(spark: SparkSession, root: str, endings: tuple[str, ...] = IMAGE_ENDINGS, recursive: bool = True, ends_with: str | None = None) -> DataFrame:
    """SRC01, SRC02, SRC08, SRC09: path, label (parent folder), name, length; contents are not read.

    Endings match in any case.  ``ends_with`` keeps names such as
    ``_preprocessed.png``.  An empty folder gives no rows.
    """
    raw = listing(spark, root, recursive)
    parts = F.split("path", "/")
    out = raw.select("path", F.get(parts, F.size(parts) - 2).alias("label"), F.element_at(parts, -1).alias("name"), "length")
    out = out.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*endings))
    return out if ends_with is None else out.where(F.endswith("name", F.lit(ends_with)))


def class_listing(listing: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """SRC03-SRC05: label, n; with ``classes`` (label) also those without files."""
    n = listing.groupBy("label").agg(F.count("*").alias("n"))
    return n if classes is None else classes.select("label").distinct().join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC12: CSV with a header and a stated schema; columns that the file lacks at its end are NULL."""
    return spark.read.option("header", True).option("enforceSchema", True).option("nullValue", "\\N").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def read_matrix(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """SRC13: a headerless integer matrix, rows true and columns predicted in the order of ``classes``, as counts.

    The file is one small matrix; each line names its row by its place.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("i", "line"))
    names = F.array(*[F.lit(c) for c in classes])
    cells = lines.select(F.get(names, F.col("i")).alias("true_class"), F.posexplode(F.split("line", ",")).alias("j", "cell"))
    return cells.select("true_class", F.get(names, F.col("j")).alias("pred"), F.trim("cell").cast("bigint").alias("n"))


def read_document(spark: SparkSession, path: str, schema: str, default: bool = True, lines: bool = False) -> DataFrame:
    """SRC14: JSON documents (bare NaN allowed), one a file or, with ``lines``, one a line.

    An empty table when nothing is there and ``default`` is set.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if default and not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.option("multiLine", not lines).option("allowNonNumericNumbers", True).schema(schema).json(path)


def read_keyed(spark: SparkSession, path: str, value: str, key: str = "class_key") -> DataFrame:
    """D16: a JSON object as one row a key; keys that start with an underscore are notes and left out."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v")).where(~F.col("k").startswith("_"))
    return entries.select(F.col("k").alias(key), F.from_json("v", value).alias("value"))


def cached(df: DataFrame, path: str, version: str) -> DataFrame:
    """SRC15, SNK04: the table stored for this version, computed and stored if missing.

    The version is part of the path, so a changed input or parameter never
    reads an old table.
    """
    spark = df.sparkSession
    at = f"{path}/v={version}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def scored(df: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str, retries: int = 3, pause: float = 0.5) -> DataFrame:
    """SRC18, ML06: rows scored batch by batch by a service or model.

    A batch is tried ``retries`` times; then its rows come out with NULL
    scores and the message in ``error``, so one bad batch fails no job.
    ``schema`` names the columns that ``score`` adds.
    """
    full = f"{df._jdf.schema().toDDL()}, {schema}, error string"
    added = [f.name for f in T.StructType.fromDDL(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for attempt in range(retries):
                try:
                    out = pd.concat([pdf.reset_index(drop=True), score(pdf).reset_index(drop=True)[added]], axis=1).assign(error=None)
                    break
                except Exception as e:  # noqa: BLE001
                    out = pdf.assign(**dict.fromkeys(added), error=f"{type(e).__name__}: {e}")
                    if attempt + 1 < retries:
                        time.sleep(pause * 2**attempt)
            yield out

    return df.mapInPandas(run, full)
