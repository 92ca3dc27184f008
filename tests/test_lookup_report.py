import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.functions.numeric import default_on_error
from assayloom.operators.lookup import (
    cached_lookup, linear_score, pattern_cross, reference_lookup, spread_join, target_lookup,
)
from assayloom.operators.report import (
    best_epoch, confidence_struct, early_stop, ensemble_confidence, kde_grid, rank_features,
    score_status, top_k,
)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise((F.col("id") % 400).cast("string")).alias("k"),
    )
    right = spark.range(300).select(
        F.when(F.col("id") == 7, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (F.col("id") * 2).alias("v"),
    )
    got = spread_join(left, right, "k", how, ["id"])
    want = left.join(right, "k", how)
    order = sorted(want.columns)
    assert sorted(got.columns) == order

    def rows(df):
        return sorted((tuple(r) for r in df.select(*order).collect()), key=repr)

    assert rows(got) == rows(want)


def test_target_and_reference_lookup(spark):
    ids = spark.createDataFrame([("CHEMBL238",), ("CHEMBL1861",), ("X",)], "target_id string")
    names = {r.target_id: (r.target_name, r.target_description)
             for r in target_lookup(ids, "target_id").collect()}
    assert names["CHEMBL238"] == ("DAT", "Dopamine Transporter") and names["X"] == ("X", "X")
    found = reference_lookup(ids, "target_id").collect()
    assert sorted(r.name for r in found if r.target_id == "CHEMBL238") == [
        "Cocaine", "Methamphetamine", "Methylphenidate"]
    assert not [r for r in found if r.target_id == "X"]


def test_linear_score_and_fallback(spark):
    rows = spark.createDataFrame(
        [("DAT", 2.0, 1.0, 2.0, 30.0, 200.0), ("5ht2A", 2.0, 1.0, 2.0, 30.0, 200.0),
         ("other", 2.0, 1.0, 2.0, 30.0, 200.0), ("dat", None, 1.0, 2.0, 30.0, 200.0)],
        "t string, a double, b double, c double, d double, e double",
    )
    terms = {"logp": "a", "donors": "b", "acceptors": "c", "tpsa": "d", "weight": "e"}
    got = [r.predicted for r in linear_score(rows, "t", terms).collect()]
    assert got[0] == pytest.approx(0.46 - 0.41 - 0.38 - 0.27 - 0.14 + 7.15)
    assert got[1] == pytest.approx(0.24 - 0.65 - 0.66 - 0.39 - 0.22 + 7.60)
    assert got[2] == pytest.approx(0.4 - 0.5 - 0.6 - 0.3 - 0.2 + 7.0)
    assert got[3] is None


def test_lookup_miss_is_null(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, t string")
    store = rows.where("id = 1").select(F.md5("t").alias("key"), F.lit(9).alias("f"))
    got = {r.id: r.f for r in cached_lookup(rows, "t", store, ["id"]).collect()}
    assert got == {1: 9, 2: None, 3: 9}
    flags = pattern_cross(rows, "t", [("a", "a"), ("bad", None)], ["id"]).collect()
    assert len(flags) == 6 and sum(r.flag for r in flags) == 2


def stop_by_hand(losses, patience):
    best, since = math.inf, 0
    for i, loss in enumerate(losses):
        if loss < best:
            best, since = loss, 0
        else:
            since += 1
            if since >= patience:
                return i + 1, i
    return len(losses), None


def test_early_stop_matches_a_loop(spark):
    rng = random.Random(4)
    runs = {
        "plateau": [3.0, 2.0, 2.0, 2.0, 2.0, 2.0, 1.0],
        "at_patience": [5.0, 4.0, 4.5, 4.5, 3.9, 4.0, 4.0, 4.0, 4.0],
        "never": [float(10 - i) for i in range(8)],
        "one": [1.0],
        "nan": [float("nan"), 2.0, 1.0, 3.0, 3.0, 3.0],
        **{f"r{j}": [rng.random() for _ in range(30)] for j in range(20)},
    }
    rows = spark.createDataFrame(
        [(n, i, x) for n, xs in runs.items() for i, x in enumerate(xs)],
        "run string, epoch int, loss double",
    )
    for r in early_stop(rows, "run", "epoch", "loss", patience=3).collect():
        n, stop = stop_by_hand(runs[r.run], 3)
        assert (r.epochs_run, r.stop_epoch) == (n, stop), r.run
        used = [x for x in runs[r.run][:n] if not math.isnan(x)]
        assert r.best_loss == min(used) and runs[r.run][r.best_epoch] == min(used)
    best = {r.run: r.best_epoch for r in best_epoch(rows, "run", "epoch", "loss").collect()}
    assert best["plateau"] == 6 and best["at_patience"] == 4 and best["nan"] == 2


def test_kde_matches_direct_sum(spark):
    rng = random.Random(8)
    data = {"a": [round(rng.gauss(0, 1), 1) for _ in range(200)], "b": [rng.random() for _ in range(50)],
            "flat": [1.0, 1.0]}
    rows = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g string, x double")
    got = kde_grid(rows.withColumnRenamed("x", "y"), "y", "g", points=25).collect()
    assert {r.g for r in got} == {"a", "b"}
    for r in got:
        xs = np.array(data[r.g])
        h = len(xs) ** -0.2 * xs.std(ddof=1)
        direct = np.exp(-0.5 * ((r.x - xs) / h) ** 2).sum() / (len(xs) * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(direct, rel=1e-9)


def test_rankings_and_status(spark):
    rows = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 3.0)], "n string, s double")
    assert [(r.n, r.rank) for r in top_k(rows, "s", "n", 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]
    assert rank_features(rows, "s", "n").where("n = 'b'").first()["rank"] == 3
    nulls = spark.createDataFrame([(1.5,), (None,)], "p double")
    got = nulls.select(score_status(F.col("p")).alias("s"), confidence_struct(F.col("p")).alias("c")).collect()
    assert [r.s for r in got] == ["success", "failed"]
    assert got[0].c.asDict() == {"mean": 1.5, "std": 0.0, "min": 1.5, "max": 1.5} and got[1].c is None
    models = spark.createDataFrame([("k", 1.0), ("k", 3.0)], "k string, p double")
    c = ensemble_confidence(models, "p", ["k"]).first().confidence
    assert (c.mean, c.std, c.min, c.max) == (2.0, 1.0, 1.0, 3.0)
    assert spark.range(1).select(default_on_error(F.lit(None).cast("double"))).first()[0] == 0.0
