import pytest
from pyspark.sql import functions as F

from assayloom.functions.numeric import coerce_double, finite_or_zero, format_fixed, neg_log10
from assayloom.operators.curate import (
    curate, keep_first, require_columns, require_rows, stage_audit,
)
from assayloom.sources.activity import ACTIVITY_SCHEMA, activity_scan

DIRTY = [
    ("T1", "e01", "aaa", "IC50", "nM", "1000"),
    ("T1", "e02", None, "IC50", "nM", "10"),
    ("T1", "e03", "bbb", "IC50", "nM", None),
    ("T1", "e04", "ccc", "IC50", "nM", "abc"),
    ("T1", "e05", "ddd", "IC50", "nM", "0"),
    ("T1", "e06", "eee", "IC50", "nM", "-5"),
    ("T1", "e07", "fff", "IC50", "nM", "1000000"),
    ("T1", "e08", "ggg", "IC50", "nM", "999999"),
    ("T1", "e09", "hhh", "IC50", "uM", "10"),
    ("T1", "e10", "iii", "Ki", "nM", "10"),
    ("T1", "e11", "aaa", "IC50", "nM", "50"),
    ("T2", "e12", "jjj", "IC50", "nM", "10"),
    ("T1", "e13", "  ", "IC50", "nM", "10"),
    ("T1", "e14", "kkk", "IC50", "nM", "NaN"),
    ("T1", "e15", "lll", "IC50", "nM", "7d"),
    ("T1", "e16", "mmm", "IC50", "nM", " 1e2 "),
]


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(DIRTY, ACTIVITY_SCHEMA)


def test_golden_values(spark):
    rows = spark.createDataFrame(
        [("m1", "a", 1000), ("m2", "b", 5000), ("m3", "c", 2500)],
        "entity_id string, key_text string, standard_value int",
    )
    got = {r.entity_id: r.p_value for r in curate(rows).collect()}
    assert got == pytest.approx({"m1": 6.0, "m2": 5.301030, "m3": 5.602060}, abs=1e-6)


def test_dirty_rows(dirty):
    got = curate(activity_scan(dirty, "T1")).orderBy("entity_id").collect()
    # The first of the two 'aaa' rows stays; blank keys, bad numbers and bounds drop out.
    assert [(r.entity_id, round(r.p_value, 6)) for r in got] == [
        ("e01", 6.0), ("e08", 3.0), ("e16", 7.0),
    ]


def test_older_variant_keeps_duplicates(dirty):
    rows = curate(activity_scan(dirty, "T1"), bounds=None, dedup=False, valid=None)
    assert sorted(r.entity_id for r in rows.collect()) == ["e01", "e08", "e11", "e13", "e16"]


def test_missing_column_and_empty_input(spark, dirty):
    with pytest.raises(ValueError, match="standard_value"):
        require_columns(dirty.drop("standard_value"))
    with pytest.raises(ValueError, match="No IC50 data"):
        activity_scan(dirty, "T9", must_exist=True)
    assert curate(dirty.limit(0)).count() == 0
    assert require_rows(dirty) is dirty


def test_stage_audit(dirty):
    got = {r.stage: (r.kept, r.removed) for r in stage_audit(activity_scan(dirty, "T1")).collect()}
    assert got == {
        "input": (13, 0), "not_null": (11, 2), "numeric": (8, 3), "above_lower": (6, 2),
        "below_upper": (5, 1), "derived_range": (5, 0), "distinct_key": (4, 1),
    }


def test_keep_first_with_one_dominating_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (F.lit(5000) - F.col("id")).alias("o"), F.col("id").alias("v"),
    )
    kept = keep_first(rows, ["k"], ["o"])
    assert kept.columns == ["k", "o", "v"]
    assert kept.count() == 2001
    assert kept.where("k = 'hot'").first().v == 2997


def test_number_expressions(spark):
    rows = spark.createDataFrame(
        [("1.5",), (".5",), ("1e-3",), ("1d",), ("0x1",), ("",), (None,), ("+2",)], "s string"
    )
    got = [r[0] for r in rows.select(coerce_double(F.col("s"))).collect()]
    assert got == [1.5, 0.5, 0.001, None, None, None, None, 2.0]
    nums = spark.createDataFrame(
        [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,), (0.0,), (-1.0,)],
        "x double",
    )
    assert [r[0] for r in nums.select(finite_or_zero(F.col("x"))).collect()] == [0, 0, 0, 0, 2, 0, -1]
    logs = [r[0] for r in nums.where("x <= 2").select(neg_log10(F.col("x"))).collect()]
    assert sum(v is None for v in logs) >= 2
    assert [r[0] for r in nums.where("x = 2 or x is null").select(
        format_fixed(F.col("x"), 2)).collect()] == ["N/A", "2.00"]
