"""What the plans must and must not hold."""

import ast
import pathlib

import pytest

from furrow.operators import filters, graph, metrics, sampling
from furrow.plans.catalog import FLAGSHIP, ORACLE, QUERIES
from furrow.sources.tables import manifest, predictions, table
from tests.comparing import DATA

ROOT = pathlib.Path(__file__).resolve().parent.parent


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(filters.not_copies(table(spark, DATA, "manifest").where("batch_no = 2")).select("path"))
    assert "PushedFilters: [IsNotNull(batch_no), EqualTo(batch_no,2)]" in text
    assert "dhash" not in text.split("ReadSchema")[1].split("\n")[0]


def test_metrics_stay_in_the_jvm(spark):
    conf = metrics.confusion(predictions(spark, DATA), ["run_tag"])
    text = plan(metrics.macro(metrics.class_report(conf, ["run_tag"]), ["run_tag"]))
    assert "Python" not in text and "Arrow" not in text
    assert text.count("partial_count(1)") == 1


def test_caps_are_limited_before_the_shuffle(spark):
    text = plan(sampling.capped(manifest(spark, DATA).select("path", "final_class"), "final_class", "path", 5, 1))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("most", [5, 10])
def test_hamming_join_is_an_equi_join(spark, most):
    text = plan(graph.hamming_pairs(manifest(spark, DATA), most))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_query_multiplies_tables(spark):
    for name in ("joi01_manifest_predictions", "joi06_knowledge", "joi07_parent_split", "joi12_count_difference", "qa02_validation", "agg12_mixed_segments", "spl02_three_way", "grf04_leakage"):
        text = plan(QUERIES[name](spark, DATA))
        assert "CartesianProduct" not in text, name


def test_flagship_and_names():
    assert FLAGSHIP in QUERIES and set(ORACLE) <= set(QUERIES)
    assert not [q for q in QUERIES if q[0] == "p" and q[1].isdigit()]


def test_core_does_not_need_the_training_data_package():
    for path in [*ROOT.glob("furrow/**/*.py"), *ROOT.glob("tests/*.py")]:
        if path.parent.name == "llm":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("furrow.llm") for n in names), path
