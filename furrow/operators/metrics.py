"""Classifier metrics from prediction rows (AGG04-AGG12, AGG20-AGG23).

Everything starts from the confusion counts: one partially aggregated
group-by of the rows, after which only (runs x classes x classes) counts are
left.  ``keys`` are the columns that tell runs apart.  Rows without a true or
a predicted class are left out.  The class domain is the union of both
columns.  ``undefined`` names what a ratio without denominator is: ``zero``
(0.0) or ``nan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def ratio(a: Column, b: Column, undefined: str) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0 if undefined == "zero" else NAN))


def defined_mean(col: str) -> Column:
    """Mean that skips NaN; NaN when nothing is left."""
    return F.coalesce(F.avg(F.when(~F.isnan(col), F.col(col))), F.lit(NAN))


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG04: keys, true_class, pred, n."""
    return df.where("true_class IS NOT NULL AND pred IS NOT NULL").groupBy(*keys, "true_class", "pred").agg(F.count("*").alias("n"))


def accuracy(conf: DataFrame, keys: list[str]) -> DataFrame:
    """AGG05: keys, n, accuracy."""
    right = F.sum(F.when(F.col("true_class") == F.col("pred"), F.col("n")).otherwise(0))
    return conf.groupBy(*keys).agg(F.sum("n").alias("n"), (right / F.sum("n")).alias("accuracy"))


def class_report(conf: DataFrame, keys: list[str], undefined: str = "nan") -> DataFrame:
    """AGG06: keys, class, support, predicted, hits, precision, recall, f1."""
    n, hit = F.col("n"), F.when(F.col("true_class") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = conf.select(*keys, F.inline(F.array(
        F.struct(F.col("true_class").alias("class"), n.alias("s"), zero.alias("p"), hit.cast("bigint").alias("h")),
        F.struct(F.col("pred").alias("class"), zero.alias("s"), n.alias("p"), zero.alias("h")),
    )))
    out = sides.groupBy(*keys, "class").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    out = out.withColumn("precision", ratio(F.col("hits"), F.col("predicted"), undefined)).withColumn("recall", ratio(F.col("hits"), F.col("support"), undefined))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(F.isnan(both) | (both == 0), F.lit(0.0 if undefined == "zero" else NAN)).otherwise(2 * F.col("precision") * F.col("recall") / both)
    return out.withColumn("f1", f1)


def macro(report: DataFrame, keys: list[str], skip_undefined: bool = True) -> DataFrame:
    """AGG07: unweighted means over classes, skipping NaN (or, of a zero report, plain)."""
    mean = defined_mean if skip_undefined else F.avg
    return report.groupBy(*keys).agg(*[mean(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def weighted(report: DataFrame, keys: list[str]) -> DataFrame:
    """AGG08: support-weighted mean of F1, undefined ones counting 0."""
    f1 = F.when(F.isnan("f1"), 0.0).otherwise(F.col("f1"))
    return report.groupBy(*keys).agg((F.sum(F.col("support") * f1) / F.sum("support")).alias("weighted_f1"))


def majority_baseline(conf: DataFrame, keys: list[str]) -> DataFrame:
    """AGG09: the most frequent true class (ties: first by name) and its share."""
    n = conf.groupBy(*keys, "true_class").agg(F.sum("n").alias("n"))
    first = F.max_by("true_class", F.struct("n", _reverse_order("true_class")))
    return n.groupBy(*keys).agg(first.alias("class"), (F.max("n") / F.sum("n")).alias("accuracy")).select(*keys, "class", "accuracy")


def _reverse_order(col: str) -> Column:
    """A column that orders as ``col`` backwards (by code point), so a maximum takes the first name."""
    return F.transform(F.split(F.rpad(col, 64, " "), ""), lambda c: -F.ascii(c))


def confused_pairs(conf: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """AGG10, WIN10: off-diagonal counts with their share of the true class, the ``top`` largest of each run."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "true_class"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "true_class", "pred"))
    return conf.withColumn("share_of_true", share).where("true_class != pred").withColumn("place", place).where(F.col("place") <= top)


def segment_gap(df: DataFrame, keys: list[str], flag: str = "studio") -> DataFrame:
    """AGG11: accuracy of either segment and the gap; NULL where a segment is empty."""
    ok = (F.col("true_class") == F.col("pred")).cast("double")
    rows = df.where(f"true_class IS NOT NULL AND pred IS NOT NULL AND {flag} IS NOT NULL")
    out = rows.groupBy(*keys).agg(
        F.count_if(F.col(flag)).alias("n_studio"), F.avg(F.when(F.col(flag), ok)).alias("acc_studio"),
        F.count_if(~F.col(flag)).alias("n_other"), F.avg(F.when(~F.col(flag), ok)).alias("acc_other"),
    )
    return out.withColumn("gap", F.col("acc_studio") - F.col("acc_other"))


def mixed_segments(df: DataFrame, keys: list[str], flag: str = "studio") -> DataFrame:
    """AGG12: classes that both segments have, with each segment's accuracy."""
    return segment_gap(df, [*keys, "true_class"], flag).where("n_studio > 0 AND n_other > 0")


def rivals(conf: DataFrame, keys: list[str]) -> DataFrame:
    """AGG20: of each class the class it is most confused with, either way, and that as a share of its support."""
    wrong = conf.where("true_class != pred")
    both = wrong.select(*keys, F.col("true_class").alias("class"), F.col("pred").alias("rival"), "n").unionByName(wrong.select(*keys, F.col("pred").alias("class"), F.col("true_class").alias("rival"), "n"))
    n = both.groupBy(*keys, "class", "rival").agg(F.sum("n").alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "class").orderBy(F.desc("n"), "rival"))).where("r = 1").drop("r")
    support = conf.groupBy(*keys, F.col("true_class").alias("class")).agg(F.sum("n").alias("support"))
    return best.join(support, [*keys, "class"], "left").withColumn("pct", 100 * F.col("n") / F.col("support"))


def rival_pairs(best: DataFrame, keys: list[str]) -> DataFrame:
    """AGG21: the unordered pairs among classes and their rivals."""
    return best.select(*keys, F.least("class", "rival").alias("a"), F.greatest("class", "rival").alias("b")).distinct()


def low_confidence_rate(df: DataFrame, keys: list[str], below: float = 0.6) -> DataFrame:
    """AGG22: share of scored rows of each class under the bound."""
    low = (F.col("confidence") < below).cast("double")
    return df.where("true_class IS NOT NULL AND confidence IS NOT NULL").groupBy(*keys, "true_class").agg(F.count("*").alias("n"), F.avg(low).alias("low_rate"))


def observed_classes(conf: DataFrame) -> list[str]:
    """The class names on either side of the confusion counts, sorted."""
    names = conf.select("true_class").union(conf.select("pred")).where("true_class IS NOT NULL").distinct()
    return sorted(r[0] for r in names.collect())


def wide_confusion(conf: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """SNK02: one row a true class, one column a predicted class of ``classes``, in that order."""
    return conf.groupBy(*keys, "true_class").pivot("pred", classes).agg(F.sum("n")).fillna(0, classes)


def migration(old_new: DataFrame, old: str = "old_split", new: str = "new_split") -> DataFrame:
    """AGG23: counts by old and new split with both totals and the grand total (NULL marks a total)."""
    return old_new.cube(old, new).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
