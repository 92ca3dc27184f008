import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayloom.operators.split import (
    bin_counts, conditional_resample, equal_width_bin, group_split, holdout_exact, holdout_hash,
    kfold, kfold_hash, split_check, split_data, three_way_split, three_way_split_exact,
    undersample_bins,
)


def md5(key, seed=42):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 5, 35, 1003])
def test_exact_holdout_takes_the_smallest_hashes(spark, n):
    got = {r.id: r.split for r in holdout_exact(spark.range(n), "id").collect()}
    size = math.ceil(n * 0.2)
    test = set(sorted(range(n), key=md5)[:size])
    assert got == {i: "test" if i in test else "train" for i in range(n)}


def test_splits_do_not_depend_on_partitioning(spark):
    rows = spark.range(2000)
    for split in (holdout_hash, holdout_exact, three_way_split, three_way_split_exact, kfold,
                  kfold_hash):
        results = [
            sorted(map(tuple, split(rows.repartition(p), "id").collect())) for p in (1, 5, 16)
        ]
        assert results[0] == results[1] == results[2]


def test_three_way_sizes(spark):
    got = Counter(r.split for r in three_way_split_exact(spark.range(1003), "id").collect())
    assert got == {"test": 201, "val": 161, "train": 641}
    approx = Counter(r.split for r in three_way_split(spark.range(10000), "id").collect())
    assert abs(approx["test"] - 2000) < 200 and abs(approx["val"] - 1600) < 200


@pytest.mark.parametrize(("n", "k"), [(10, 3), (11, 3), (1000, 7), (2, 2)])
def test_kfold_sizes(spark, n, k):
    rows = kfold(spark.range(n), "id", k).collect()
    sizes = Counter(r.fold for r in rows)
    expected = {f: n // k + (1 if f < n % k else 0) for f in range(k)}
    assert sizes == expected
    ranked = sorted(range(n), key=md5)
    got = [r.fold for r in sorted(rows, key=lambda r: md5(r.id))]
    assert got == sorted(got) and len(ranked) == n


def test_group_split_with_a_dominating_and_a_missing_group(spark):
    rows = spark.range(900).select(
        "id",
        F.when(F.col("id") % 3 == 0, "big").when(F.col("id") < 10, F.lit(None))
        .otherwise((F.col("id") % 23).cast("string")).alias("g"),
    )
    out = group_split(rows, "g")
    per_group = out.groupBy("g").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s"))
    got = per_group.collect()
    assert all(r.n == 1 for r in got)
    assert sum(r.s == "test" for r in got) == math.ceil(0.2 * len(got))
    assert out.count() == 900
    check = split_check(out, "g").first()
    assert (check.n_rows, check.n_placed, check.n_straddling) == (900, 900, 0)


def test_split_data_by_name(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}") for i in range(5)], "id int, g string")
    assert split_data(rows, "random", key="id").count() == 5
    assert split_data(rows, "group", key="id", group="g").count() == 5
    with pytest.raises(ValueError, match="Unknown split method"):
        split_data(rows, "other", key="id")
    with pytest.raises(ValueError, match="group column"):
        split_data(rows, "group", key="id")


def test_bins_are_right_closed(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(0, 101)], "id int, x double")
    got = {r.x: r.bin for r in equal_width_bin(rows, "x").collect()}
    assert got == {float(i): max(0, math.ceil(i / 10) - 1) for i in range(101)}
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id int, x double")
    assert [r.bin for r in equal_width_bin(flat, "x").orderBy("id").collect()] == [0, 0, None]


def test_undersample_matches_brute_force(spark):
    values = [(i, float((i * i) % 97)) for i in range(1500)] + [(5000 + i, 3.0) for i in range(900)]
    rows = spark.createDataFrame(values, "id int, x double")
    hi = max(x for _, x in values)
    lo = min(x for _, x in values)
    bins = {}
    for i, x in values:
        bins.setdefault(max(0, math.ceil((x - lo) / ((hi - lo) / 10)) - 1), []).append(i)
    size = min(map(len, bins.values()))
    expected = sorted(i for members in bins.values() for i in sorted(members, key=md5)[:size])
    assert sorted(r.id for r in undersample_bins(rows, "x", "id").collect()) == expected
    counts = bin_counts(equal_width_bin(rows, "x")).collect()
    assert {r.bin: r.n_rows for r in counts} == {b: len(m) for b, m in bins.items()}
    assert {r.min_rows for r in counts} == {size}


def test_resample_only_when_distributions_differ(spark):
    same = holdout_hash(spark.range(3000).withColumn("x", (F.col("id") % 50).cast("double")), "id")
    kept, report = conditional_resample(same, "x", "id")
    assert not report["resampled"] and kept.count() == 3000
    differs = same.withColumn("split", F.when(F.col("x") < 10, "test").otherwise("train"))
    kept, report = conditional_resample(differs, "x", "id")
    assert report["resampled"] and report["p_value"] < 1e-6
    assert kept.where("split = 'test'").count() == 600
    assert kept.columns == same.columns


def test_null_keys_do_not_disturb_the_sizes(spark):
    rows = spark.range(1000).select(F.when(F.col("id") >= 300, F.col("id")).alias("k"))
    sizes = Counter((r.split, r.k is None) for r in holdout_exact(rows, "k").collect())
    assert sizes == {("test", False): 140, ("train", False): 560, ("train", True): 300}
    sizes = Counter((r.split, r.k is None) for r in three_way_split_exact(rows, "k").collect())
    assert sizes == {("test", False): 140, ("val", False): 112, ("train", False): 448,
                     ("train", True): 300}
    folds = Counter(r.fold for r in kfold(rows, "k", 3).collect() if r.k is not None)
    assert sorted(folds.values()) == [233, 233, 234]
    assert all(r.fold == 0 for r in kfold(rows, "k", 3).collect() if r.k is None)


def test_an_empty_test_part(spark):
    sizes = Counter(r.split for r in three_way_split_exact(spark.range(1000), "id", test=0.0).collect())
    assert sizes == {"val": 200, "train": 800}


def test_narrow_cells_give_the_same_thresholds(spark):
    from assayloom.functions.text import row_hash
    from assayloom.operators.ordered import hash_thresholds

    rows = spark.range(700).select(row_hash(F.col("id"), 42).alias("h"))
    cuts = spark.createDataFrame([(0, 1), (1, 350), (2, 700), (3, 0), (4, 701)], "cut int, position int")
    hashes = sorted(md5(i) for i in range(700))
    want = {0: hashes[0], 1: hashes[349], 2: hashes[699]}
    for digits, levels in ((1, 1), (1, 3), (4, 2)):
        got = hash_thresholds(rows, "h", cuts, digits=digits, levels=levels).collect()
        assert {r.cut: r.threshold for r in got} == want


def test_train_rows_without_a_value_stay(spark):
    rows = spark.range(600).select(
        "id", F.when(F.col("id") % 6 > 0, F.col("id").cast("double")).alias("v"),
        F.when(F.col("id") > 500, "test").otherwise("train").alias("split"))
    kept, report = conditional_resample(rows, "v", "id")
    assert report["resampled"]
    assert kept.where("v is null").count() == rows.where("v is null").count()


def test_small_bins_are_merged(spark):
    counts = {0: 50, 1: 3, 2: 4, 3: 40, 4: 2, 5: 1}
    rows = spark.createDataFrame([(b,) for b, n in counts.items() for _ in range(n)], "bin int")
    from assayloom.operators.split import merge_small_bins

    got = Counter(r.bin for r in merge_small_bins(rows, 30).collect())
    assert got == {0: 50, 1: 50}
    assert Counter(r.bin for r in merge_small_bins(rows, 1000).collect()) == {0: 100}


def test_whole_and_empty_fractions(spark):
    rows = spark.range(2000).withColumnRenamed("id", "k")
    assert holdout_hash(rows, "k", 1.0).where("split = 'test'").count() == 2000
    assert holdout_hash(rows, "k", 0.0).where("split = 'test'").count() == 0
    assert holdout_exact(rows, "k", 1.0).where("split = 'test'").count() == 2000
    parts = three_way_split(rows, "k", 0.0, 1.0).groupBy("split").count().collect()
    assert [(r["split"], r["count"]) for r in parts] == [("val", 2000)]
    with pytest.raises(ValueError):
        holdout_hash(rows, "k", 1.2)


def test_resampling_keeps_a_column_named_bin(spark):
    rows = spark.range(400).select(
        F.col("id").alias("k"), (F.col("id") % 50 + F.when(F.col("id") < 200, 0).otherwise(400)).cast("double").alias("v"),
        F.when(F.col("id") < 200, "train").otherwise("test").alias("split"), (F.col("id") * 3).alias("bin"))
    out, report = conditional_resample(rows, "v", "k")
    assert report["resampled"] and out.columns == rows.columns
    assert out.where("bin <> k * 3").count() == 0 and out.where("split = 'test'").count() == 200
