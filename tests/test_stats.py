import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators.scale import (
    CorrelationPrune, RobustScale, StandardScale, dropped_positions, prune_columns,
)
from assayloom.operators.split import kfold
from assayloom.operators.stats import (
    best_trial, correlation_columns, correlation_pairs, cv_mean, feature_summary,
    grouped_linear_fit, group_sizes, linear_cross_validate, prediction_summary, quantile_fit,
    regression_metrics, weighted_mean,
)


def vectors(spark, matrix):
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "id int, v array<double>"
    )


def test_metrics(spark):
    rows = spark.createDataFrame(
        [(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (None, 1.0), (1.0, None)], "y double, p double"
    )
    got = regression_metrics(rows, "y", "p").first()
    assert got.n == 3 and got.mse == pytest.approx(1.25 / 3)
    assert got.rmse == pytest.approx((1.25 / 3) ** 0.5)
    assert got.r2 == pytest.approx(1 - 1.25 / (14 / 3))
    flat = spark.createDataFrame([(2.0, 2.0, 2.5), (2.0, 2.0, 2.0)], "y double, p double, q double")
    assert regression_metrics(flat, "y", "p").first().r2 == 1.0
    assert regression_metrics(flat, "y", "q").first().r2 == 0.0
    empty = regression_metrics(rows.limit(0), "y", "p").first()
    assert empty.n == 0 and empty.mse is None


def test_quantiles_are_exact(spark):
    rng = random.Random(5)
    groups = {
        "wide": [rng.gauss(0, 1) for _ in range(6001)],
        "ties": [rng.choice([0.0, 0.0, 1.0, 5.0]) for _ in range(4000)],
        "hot": [7.0] * 3000 + [rng.random() for _ in range(6000)],
        "rare": [0.0] * 4999 + [1.0],
    }
    rows = spark.createDataFrame(
        [(g, float(x)) for g, xs in groups.items() for x in xs], "g string, x double"
    )
    fitted = quantile_fit(rows, "x", ["g"])
    for r in fitted.collect():
        assert r.n == len(groups[r.g])
        assert r.quantiles == pytest.approx(list(np.percentile(groups[r.g], [25, 50, 75])), abs=1e-12)


def test_quantiles_of_tiny_groups(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 2.0), ("b", float("nan"))],
                                 "g string, x double")
    got = {r.g: r.quantiles for r in quantile_fit(rows, "x", ["g"]).collect()}
    assert got["a"] == [3.0, 3.0, 3.0] and got["b"] == pytest.approx([1.25, 1.5, 1.75])


def test_robust_scale_keeps_rare_bits(spark):
    matrix = [[i, 0.0, 4.0] for i in range(10)]
    matrix[3][1] = 1.0
    rows = vectors(spark, matrix)
    scaler = RobustScale.fit(rows, "v")
    got = [r.v for r in scaler.transform(rows, "v").orderBy("id").collect()]
    assert scaler.medians == (4.5, 0.0, 4.0) and scaler.divisors == (4.5, 1.0, 1.0)
    assert got[3][1] == 1.0 and got[0][2] == 0.0
    assert got[9][0] == pytest.approx(1.0)


def test_standard_scale_round_trip(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "y double")
    scale = StandardScale.fit(rows, "y")
    assert scale.std == pytest.approx(np.std([1, 2, 6]))
    back = rows.select(scale.restored(scale.scaled(F.col("y"))).alias("y")).collect()
    assert [r.y for r in back] == pytest.approx([1.0, 2.0, 6.0])
    assert StandardScale.fit(spark.createDataFrame([(3.0,)], "y double"), "y").std == 1.0


def test_near_copies_are_dropped(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=100)
    m = np.column_stack([
        base, base + 0.01 * rng.normal(size=100), rng.normal(size=100),
        base + 0.02 * rng.normal(size=100), *[rng.normal(size=100) for _ in range(6)],
    ])
    names = [f"feature_{i}" for i in range(10)]
    fitted = CorrelationPrune.fit(vectors(spark, m), "v", names)
    assert fitted.removed_names == ["feature_1", "feature_3"]
    assert fitted.kept_names == [n for n in names if n not in ("feature_1", "feature_3")]
    out = fitted.transform(vectors(spark, m), "v").first().v
    assert len(out) == 8


def test_chain_and_constants(spark):
    rng = np.random.default_rng(3)
    f0 = rng.normal(size=400)
    f1 = f0 + 0.4 * rng.normal(size=400)
    f2 = f1 + 0.4 * rng.normal(size=400)
    m = np.column_stack([f0, f1, f2, np.full(400, 2.0), rng.normal(size=400)])
    r = np.abs(np.corrcoef(m[:, :3].T))
    assert r[0, 1] > 0.9 and r[1, 2] > 0.9 and r[0, 2] < 0.9
    pairs = correlation_pairs(vectors(spark, m), "v")
    assert pairs.count() == 10
    assert pairs.where("(i = 3 or j = 3) and abs_r is not null").count() == 0
    # f1 goes because of f0, f2 because of f1 although f1 itself is gone.
    assert sorted(x.j for x in dropped_positions(pairs, 0.9).collect()) == [1, 2]
    wide = spark.createDataFrame([tuple(map(float, row)) for row in m], list("abcde"))
    assert {x.name for x in prune_columns(wide, list("abcde")).where("not kept").collect()} == {"b", "c"}
    assert correlation_columns(wide, ["a", "d"]).first().abs_r is None


def test_feature_summary_and_sizes(spark):
    rows = vectors(spark, [[1, 2], [3, 2]])
    got = {r.pos: r for r in feature_summary(rows, "v").collect()}
    assert got[0].std == 1.0 and got[1].std == 0.0 and got[0].n_features == 2
    groups = spark.createDataFrame([("a",), ("a",), (None,)], "g string")
    assert {r.g: r.n_members for r in group_sizes(groups, "g").collect()} == {"a": 2, "invalid": 1}


def test_linear_cross_validation(spark):
    rng = random.Random(2)
    data = [(i, rng.random() * 10) for i in range(500)]
    data = [(i, x, 3 * x + 2 + rng.gauss(0, 1)) for i, x in data]
    rows = kfold(spark.createDataFrame(data, "id int, x double, y double"), "id", 3)
    got = {r.fold: r for r in linear_cross_validate(rows, "x", "y").collect()}
    local = rows.toPandas()
    for fold, r in got.items():
        t, v = local[local.fold != fold], local[local.fold == fold]
        b, a = np.polyfit(t.x, t.y, 1)
        expected = 1 - ((v.y - a - b * v.x) ** 2).sum() / ((v.y - v.y.mean()) ** 2).sum()
        assert (r.slope, r.intercept, r.r2) == pytest.approx((b, a, expected), abs=1e-9)
    assert cv_mean(linear_cross_validate(rows, "x", "y")).first().n_folds == 3


def test_grouped_fit_drops_constant_x(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0)],
        "g string, x double, y double",
    )
    got = grouped_linear_fit(rows, "x", "y", ["g"]).collect()
    assert [(r.g, round(r.slope, 9), round(r.r2, 9)) for r in got] == [("a", 2.0, 1.0)]


def test_best_trial_and_weights(spark):
    rows = spark.createDataFrame(
        [(1, 0.5), (2, None), (3, 0.2), (4, float("nan")), (5, 0.2)], "t int, s double"
    )
    low = best_trial(rows, "t", "s").first()
    assert (low.best_params, low.best_score, low.n_trials) == (3, 0.2, 5)
    assert best_trial(rows, "t", "s", maximise=True).first().best_params == 1
    failed = best_trial(rows.where("s is null"), "t", "s").first()
    assert failed.best_score == float("inf")
    batches = spark.createDataFrame([("r", 1.0, 3), ("r", 5.0, 1)], "run string, l double, n int")
    assert weighted_mean(batches, "l", "n", ["run"]).first().loss == 2.0
    preds = spark.createDataFrame([(None,), (None,)], "p double")
    got = prediction_summary(preds, "p").first()
    assert (got.successful, got.failed, got.min_predicted) == (0, 2, None)


def test_positions_without_numbers_keep_their_place(spark):
    rows = spark.createDataFrame(
        [([float(i), None, 10.0 * i],) for i in range(5)], "v array<double>")
    scaler = RobustScale.fit(rows, "v")
    assert scaler.medians == (2.0, 0.0, 20.0) and scaler.divisors == (2.0, 1.0, 20.0)


def test_metrics_compute_a_prediction_once(spark):
    from assayloom.operators.stats import regression_metrics

    rows = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", None, 1.0), ("a", 9.0, None), ("b", 1.0, None)],
        "g string, y double, x double")
    twice = F.udf(lambda x: x, "double")
    made = regression_metrics(rows.withColumn("p", twice("x")), "y", "p", ["g"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1
    got = made.collect()
    assert [(r.g, r.n, r.mse, r.r2) for r in got] == [("a", 2, 0.5, 0.5)]
    whole = regression_metrics(rows.where("g = 'b'").withColumn("p", F.col("x")), "y", "p").first()
    assert (whole.n, whole.mse) == (0, None)
