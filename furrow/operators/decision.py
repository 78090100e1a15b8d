"""Decision rules on class probabilities (FLT08, FLT10, WIN01, WIN02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked_scores(scores: Column) -> Column:
    """WIN01: array of (p, class), largest first, ties to the first class.

    ``scores`` is an array of structs (cls, p); names starting with an
    underscore are notes and no classes.
    """
    real = F.filter(scores, lambda s: ~s["cls"].startswith("_"))
    order = lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).when(a["cls"] < b["cls"], -1).when(a["cls"] > b["cls"], 1).otherwise(0)
    return F.array_sort(real, order)


def decide(df: DataFrame, scores: str, cluster: list[str], spread: str | None = None, top: int = 3, least_p: float = 0.65, least_margin: float = 0.12, low: float = 0.6) -> DataFrame:
    """FLT10, WIN02: top class, confidence, margin, abstention, low confidence and the ``top`` classes.

    A top class of ``cluster`` abstains under ``least_p`` or under
    ``least_margin`` (both exclusive); abstaining forces low confidence.  The
    margin is 1 where only one class is scored; no scores give NULLs.
    """
    r = df.withColumn("_r", ranked_scores(F.col(scores)))
    first, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    r = r.withColumn("top_class", first["cls"]).withColumn("confidence", first["p"])
    r = r.withColumn("margin", F.when(first.isNotNull(), F.coalesce(first["p"] - second["p"], F.lit(1.0))))
    abstain = F.col("top_class").isin(cluster) & ((F.col("confidence") < least_p) | (F.col("margin") < least_margin))
    unsure = F.col("confidence") < low
    if spread:
        unsure = unsure | F.coalesce(F.col(spread) > 0.5, F.lit(False))
    r = r.withColumn("abstain", abstain).withColumn("low_confidence", unsure | F.col("abstain"))
    return r.withColumn("top", F.slice("_r", 1, top)).drop("_r")
