"""The mini-batch network, the adaptive sampler and the median pruner."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators.report import best_epoch, early_stop
from assayloom.plans.network import Network, NetworkSettings, train_network
from assayloom.plans.search import (
    AdaptiveSampler, MedianPruner, hash_unit, network_search, search, trial_table,
)
from assayloom.plans.training import choice, draw_trials, log_uniform, uniform


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    network = Network((4, 6, 5, 1))
    weights, x, y = network.start(1), rng.normal(size=(9, 4)), rng.normal(size=9)
    loss, gradient = network.gradient(weights, x, y)
    assert loss == pytest.approx(float(((network.forward(weights, x)[-1][:, 0] - y) ** 2).sum()))
    for at in rng.choice(len(weights), 40, replace=False):
        step = np.zeros(len(weights))
        step[at] = 1e-6
        up, down = (network.gradient(weights + s, x, y)[0] for s in (step, -step))
        assert 2 * gradient[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_dropout_gradient_equals_differences():
    network, rng = Network((3, 8, 1)), np.random.default_rng(3)
    weights, x, y = network.start(2), rng.normal(size=(5, 3)), rng.normal(size=5)
    found = network.gradient(weights, x, y, 0.4, np.random.default_rng(7))[1]
    for at in range(len(weights)):
        step = np.zeros(len(weights))
        step[at] = 1e-6
        up, down = (network.gradient(weights + s, x, y, 0.4, np.random.default_rng(7))[0] for s in (step, -step))
        assert 2 * found[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.fixture(scope="module")
def curve(spark):
    """A label that follows from three features without noise."""
    rng = random.Random(1)
    rows = []
    for i in range(900):
        a, b, c = (rng.uniform(-1, 1) for _ in range(3))
        rows.append((i, [a, b, c], 50 + 10 * (abs(a) - b + a * c), "val" if i % 5 == 0 else "train"))
    rows += [(1000, None, 1.0, "train"), (1001, [0.0, 0.0, 0.0], None, "val"), (1002, [0.0] * 3, 1.0, "test")]
    return spark.createDataFrame(rows, "k int, x array<double>, y double, split string").repartition(3).cache()


SMALL = NetworkSettings(hidden=(32, 32), rate=0.05, epochs=30, batches=2, dropout=0.0, step_size=15)


def test_noiseless_fit_and_history(spark, curve):
    made = train_network(curve, "x", "y", "k", SMALL)
    scored = curve.where("split = 'val' and y is not null").withColumn("p", made.predict(F.col("x")))
    r2 = scored.agg(1 - F.sum((F.col("p") - F.col("y")) ** 2) / (F.var_pop("y") * F.count("*"))).first()[0]
    assert r2 > 0.99
    assert curve.where("k = 1000").select(made.predict(F.col("x")).alias("p")).first().p is None
    history = made.history_table(spark, "one")
    best = best_epoch(history, "run", "epoch", "loss").first()
    assert best.best_epoch == made.best_epoch
    assert early_stop(history, "run", "epoch", "loss").count() > 0
    again = train_network(curve, "x", "y", "k", replace(SMALL, epochs=2))
    assert np.allclose(again.history, made.history[:2], rtol=1e-9)


def test_patience_ends_training(curve):
    still = NetworkSettings(hidden=(4,), rate=0.0, epochs=40, batches=1, patience=2, dropout=0.0)
    made = train_network(curve, "x", "y", "k", still)
    assert made.stopped == "patience" and len(made.history) == 3


def test_draws_start_as_random_search(spark):
    space = {"a": uniform(0.0, 1.0), "b": log_uniform(1e-3, 1.0)}
    drawn = {r.trial: r for r in draw_trials(spark, space, 3).collect()}
    for trial, r in drawn.items():
        assert r.a == pytest.approx(hash_unit(trial, "a", 42), abs=1e-12)
        assert math.log(r.b) == pytest.approx(math.log(1e-3) * (1 - hash_unit(trial, "b", 42)), abs=1e-9)


def test_adaptive_draws_beat_random_ones():
    def bowl(u):
        return (u["a"] - 0.3) ** 2 + (u["b"] - 0.8) ** 2 + 0.3 * (u["c"] - 0.5) ** 2 + 0.2 * (u["d"] - 0.1) ** 2

    names, adaptive, plain = ["a", "b", "c", "d"], [], []
    for seed in range(12):
        for startup, out in ((10, adaptive), (10**9, plain)):
            sampler, past = AdaptiveSampler(startup=startup, seed=seed), []
            for trial in range(60):
                units = sampler.propose(names, past, trial)
                assert all(0 <= x < 1 for x in units.values())
                past.append((units, bowl(units)))
            out.append(min(s for _, s in past))
    assert np.mean(adaptive) < 0.6 * np.mean(plain)
    assert sum(a < p for a, p in zip(adaptive, plain)) >= 9


def test_search_is_reproducible_and_reports_failures(spark):
    space = {"x": uniform(-1.0, 1.0), "kind": choice("good", "bad", "good")}

    def objective(params, report):
        if params["kind"] == "bad":
            raise ValueError("bad kind")
        return (params["x"] - 0.4) ** 2

    one, two = (search(spark, space, objective, 24, AdaptiveSampler(startup=8), parallelism=4) for _ in range(2))
    assert [t.params for t in one] == [t.params for t in two]
    assert min(t.score for t in one) < 0.01
    assert all((t.reason is not None) == (t.params["kind"] == "bad") for t in one)
    assert trial_table(spark, one).where("reason is not null").count() == sum(t.reason is not None for t in one)
    with pytest.raises(ValueError):
        search(spark, space, lambda params, report: [].index(1), 2)


def test_planted_bad_trials_are_stopped(spark):
    """Every third trial is bad from the start: it is stopped after the warm-up, and rounds are saved."""
    space = {"x": uniform(0.0, 1.0)}
    numbers = iter(range(100))

    def objective(params, report):
        bad = next(numbers) % 3 == 2
        value = 1.0
        for step in range(30):
            value = 5.0 if bad else 1.0 / (step + 1 + params["x"])
            if report(step, value):
                break
        return value

    trials = search(spark, space, objective, 15, pruner=MedianPruner(startup=4, warmup=5), parallelism=1)
    for t in trials:
        if t.number % 3 == 2 and t.number > 5:
            assert t.pruned and t.steps == 6
    assert 15 * 30 - sum(t.steps for t in trials) >= 3 * 24
    assert not min(trials, key=lambda t: t.score).pruned


def test_network_search(spark, curve):
    space = {"rate": choice(0.01, 1e-9), "width": choice(16, 24)}
    settings = NetworkSettings(hidden=(8,), epochs=6, batches=1, dropout=0.0)
    made, trials = network_search(curve, "x", "y", "k", space, 4, settings, pruner=MedianPruner(1, 2))
    assert len(trials) == 4 and made.network.sizes[1] in (16, 24)
    best = min(trials, key=lambda t: t.score)
    assert best.params["rate"] == 0.01 or all(t.params["rate"] != 0.01 for t in trials)


def test_network_rows_are_stored_as_blocks(spark, monkeypatch):
    """Few wide rows reach the tasks of a mini-batch, and every row is in one mini-batch of an epoch."""
    import numpy as np

    from assayloom.plans import network

    made, kept = network.stored, []
    monkeypatch.setattr(network, "stored", lambda df, name: kept.append(made(df, name)) or kept[-1])
    rows = spark.range(4000).selectExpr(
        "id as k", "array(id / 4000.0D, 1.0D) as x", "id / 2000.0D as y", "if(id % 5 = 0, 'val', 'train') as split")
    got = network.train_network(rows.coalesce(2), "x", "y", "k", network.NetworkSettings(
        hidden=(4,), epochs=2, batches=3, dropout=0.0))
    assert len(got.history) == 2
    blocks = kept[0].collect()
    assert len(blocks) < 40 and sum(len(b.y) for b in blocks) == 8 * 4000
    h = np.concatenate([np.frombuffer(b.h, np.int64) for b in blocks])
    for epoch in range(2):
        sizes = np.bincount(network.dealt(h, epoch, 3).astype(int), minlength=3)
        assert sizes.sum() == 4000 and sizes.min() > 1200
    assert (network.dealt(h, 0, 3) != network.dealt(h, 1, 3)).mean() > 0.5
