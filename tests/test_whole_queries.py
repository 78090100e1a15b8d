"""Queries lose no photograph and no class."""

from pyspark.sql import functions as F

from furrow.plans.catalog import QUERIES
from furrow.sources.tables import predictions, table
from tests.comparing import DATA


def test_class_listing_lists_every_photograph(spark):
    listed = QUERIES["src03_class_listing"](spark, DATA).agg(F.sum("n")).first()[0]
    assert listed == table(spark, DATA, "features").where("path IS NOT NULL").select("path").distinct().count()


def test_confusion_holds_every_class(spark):
    pairs = predictions(spark, DATA).where("true_class IS NOT NULL AND pred IS NOT NULL")
    wide = QUERIES["snk02_wide_confusion"](spark, DATA)
    counts = [c for c in wide.columns if c not in ("run_tag", "true_class")]
    named = {r.pred for r in pairs.select("pred").distinct().collect()}
    assert named <= set(counts) or "other" in counts
    known = wide.collect()
    assert sum(r[c] for r in known for c in counts) == pairs.count()
    matrix = QUERIES["src13_snk02_matrix"](spark, DATA)
    observed = named | {r.true_class for r in pairs.select("true_class").distinct().collect()}
    assert matrix.count() == len(observed) ** 2 and matrix.agg(F.sum("n")).first()[0] == pairs.count()
