"""Every registered query beside its SQL, and the shapes of a few plans."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_sql  # noqa: E402
from assayloom import bindings  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = bindings.QUERIES, bindings.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return check_sql.connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    line = check_sql.compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert line.startswith("ok"), line


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_filters_are_pushed(spark):
    text = plan(QUERIES["activity_scan"](spark, FOLDER))
    assert "EqualTo(l_returnflag,R)" in text and "EqualTo(l_linenumber,1)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double," in text


@pytest.mark.parametrize("name", ["holdout_exact", "kfold", "group_split", "three_way_split_exact"])
def test_splits_move_no_rows(spark, name):
    main = plan(QUERIES[name](spark, FOLDER)).split("Subquery")[0]
    assert "Exchange" not in main and "Window" not in main


@pytest.mark.parametrize("name", [
    "curate", "dedup_keep_first", "roc_curve", "undersample_bins", "robust_scale",
    "cached_lookup", "linear_score", "kde_grid",
])
def test_plans_stay_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "Python" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_dedup_uses_no_window(spark):
    assert "Window" not in plan(QUERIES["dedup_keep_first"](spark, FOLDER))


def test_features_take_one_kernel(spark):
    """A text goes to Python once, in Arrow batches, and is shuffled only to spread the work."""
    text = plan(QUERIES["assemble_features"](spark, FOLDER))
    assert text.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in text
    assert text.count("Exchange") == 1 and "Generate" not in text and "Aggregate" not in text
