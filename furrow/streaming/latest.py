"""Streams of requests and scores.

The one rule on sequences that curation needs is that the latest request
wins; late scores are settled by watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import Scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet table read as a stream of files, by the schema the table has."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def latest_wins(stream: DataFrame, key: str, sequence: str, *cols: str) -> DataFrame:
    """The row of the highest sequence number of each key so far; older rows that come later change nothing."""
    return stream.groupBy(key).agg(F.max(F.struct(sequence, *cols)).alias("_t")).select(key, "_t.*")


def windowed_counts(stream: DataFrame, at: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and mean value by window and key; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return what it wrote last.

    Batches are written to the shared scratch folder, whose checkpoint lets
    the query go on after a failure.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark)
    at = f"{scratch.root}/stream-{uuid.uuid4().hex[:8]}"

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{at}/out")
        else:
            batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{at}/out")
    return out.select(*stream.columns)
