import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.plans.forest import feature_cuts, forest_importances, grow, poisson_weights
from assayloom.plans.training import feature_importance


def noise(spark, n, width=6):
    """Vectors without a pattern and a label that depends a little on the first position."""
    rng = np.random.default_rng(3)
    x = rng.random((n, width))
    y = x[:, 0] + rng.random(n)
    return spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "v array<double>, y double")


def test_passes_over_the_rows_do_not_grow_with_them(spark):
    jobs = []
    for n in (300, 3000):
        spark.sparkContext.setJobGroup(f"forest {n}", "")
        feature_importance(noise(spark, n), "v", "y", list("abcdef"), k=6, trees=30).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest {n}")))
    assert jobs[0] == jobs[1]


def plain(bins, y, w, depth, gains):
    """One node at a time, every position and cut."""
    total = w.sum()
    if depth == 0 or len(set(y)) < 2:
        return
    best = (0.0, 0, 0)
    error = (w * (y - (w * y).sum() / total) ** 2).sum()
    for p in range(bins.shape[1]):
        for c in range(31):
            left = bins[:, p] <= c
            if 0 < left.sum() < len(y):
                after = sum((w[s] * (y[s] - (w[s] * y[s]).sum() / w[s].sum()) ** 2).sum() for s in (left, ~left))
                best = max(best, (error - after, -p, -c))
    if best[0] <= 1e-12 * error:
        return
    gains[-best[1]] += best[0]
    left = bins[:, -best[1]] <= -best[2]
    for s in (left, ~left):
        plain(bins[s], y[s], w[s], depth - 1, gains)


@pytest.mark.parametrize("depth", [1, 3, 30])
def test_grow_takes_the_best_split_of_every_node(depth):
    rng = np.random.default_rng(5)
    bins, y = rng.integers(0, 32, (150, 3)).astype(np.uint8), rng.normal(size=150)
    w, wanted = rng.integers(1, 4, 150).astype(float), np.zeros(3)
    plain(bins, y, w, depth, wanted)
    assert grow(bins, y, w, 3, depth, rng) == pytest.approx(wanted)


def test_nodes_split_by_all_tasks_are_those_of_one_group(spark):
    rows = noise(spark, 900)
    whole = forest_importances(rows, 6, 1, 30, 42)
    assert forest_importances(rows, 6, 1, 30, 42, group_rows=40) == pytest.approx(whole, rel=1e-9)
    assert forest_importances(rows, 6, 1, 4, 42, group_rows=40) == pytest.approx(
        forest_importances(rows, 6, 1, 4, 42), rel=1e-9)
    many = [forest_importances(rows, 6, 20, 30, 42, group_rows=g) for g in (None, 100)]
    assert many[0] == pytest.approx(many[1], abs=0.03) and sum(many[1]) == pytest.approx(1.0)
    assert min(many[0][0], many[1][0]) > 1.5 * max(many[0][1:] + many[1][1:])


def test_bins_draws_and_odd_inputs(spark):
    rows = spark.range(4000).select(F.array(
        F.rand(1), (F.col("id") == 7).cast("double"), (F.col("id") != 7).cast("double"), F.lit(2.0),
        (F.col("id") % 32).cast("double")).alias("v"), F.col("id").cast("double").alias("y"))
    cuts = feature_cuts(rows, 5)
    assert [len(c) for c in cuts] == [31, 1, 1, 0, 31] and list(cuts[2]) == [0.0]
    w = poisson_weights(np.arange(100_000), 3, 42)
    assert w.mean() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert abs(np.corrcoef(w, poisson_weights(np.arange(100_000), 4, 42))[0, 1]) < 0.02
    same = forest_importances(rows.withColumn("y", F.lit(0.1)), 5, 3, 30, 1)
    assert same == [0.0] * 5
    with pytest.raises(ValueError, match="needs rows"):
        forest_importances(rows.where("y < 0"), 5, 3, 30, 1)
    with pytest.raises(Exception, match="4 names for 5 features"):
        forest_importances(rows, 4, 3, 30, 1)
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="features must"):
            forest_importances(rows.withColumn("v", F.array(F.lit(bad).cast("double"))), 1, 3, 30, 1)
