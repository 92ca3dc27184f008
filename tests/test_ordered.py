import math
import random

import pytest
from pyspark.sql import functions as F

from assayloom.operators.ordered import auc, ecdf, ks_two_sample, roc_curve, running_totals


def sample(n=2000, seed=1):
    """Scores with a third of all rows on one value and other ties across classes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        score = 0.5 if rng.random() < 0.34 else round(rng.gauss(0.4 + 0.3 * y, 0.3), 2)
        rows.append((i, score, y))
    return rows


@pytest.mark.parametrize("ranges", [2, 7, 1024])
def test_running_totals(spark, ranges):
    data = sample()
    rows = spark.createDataFrame(data, "id int, s double, y int")
    got = running_totals(rows, "s", {"n": F.lit(1)}, ranges=ranges).collect()
    values = sorted({s for _, s, _ in data})
    assert sorted(r.s for r in got) == values
    by_value = {r.s: (r.n, r.cum_n) for r in got}
    total = 0
    for v in values:
        own = sum(s == v for _, s, _ in data)
        total += own
        assert by_value[v] == (own, total)


def pair_auc(data):
    pos = [s for _, s, y in data if y == 1]
    neg = [s for _, s, y in data if y == 0]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [3, 256])
def test_auc_and_roc(spark, ranges):
    data = sample(600)
    rows = spark.createDataFrame(data, "id int, s double, y int")
    assert auc(rows, "s", "y", ranges).first().auc == pytest.approx(pair_auc(data), abs=1e-12)
    points = sorted(roc_curve(rows, "s", "y", ranges=ranges).collect(), key=lambda r: -r.threshold)
    for p in points[:: max(1, len(points) // 20)]:
        assert p.tp == sum(y == 1 and s >= p.threshold for _, s, y in data)
        assert p.fp == sum(y == 0 and s >= p.threshold for _, s, y in data)
    assert points[-1].tpr == points[-1].fpr == 1.0
    full = roc_curve(rows, "s", "y", with_origin=True, ranges=ranges)
    assert full.count() == len(points) + 1
    assert full.where(F.col("threshold") == float("inf")).first().tpr == 0.0


def test_one_class(spark):
    rows = spark.createDataFrame([(1, 0.1, 1), (2, 0.4, 1), (3, None, 1)], "id int, s double, y int")
    assert auc(rows, "s", "y").first().auc is None
    assert {r.fpr for r in roc_curve(rows, "s", "y").collect()} == {None}


def test_ks_matches_brute_force(spark):
    data = sample(1500, seed=3)
    rows = spark.createDataFrame(data, "id int, s double, y int")
    a = [s for _, s, y in data if y == 0]
    b = [s for _, s, y in data if y == 1]
    values = set(a) | set(b)
    d = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in values)
    got = ks_two_sample(rows, "s", "y", (0, 1), ranges=16).first()
    assert (got.n_a, got.n_b) == (len(a), len(b))
    assert got.statistic == pytest.approx(d, abs=1e-12)
    assert ecdf(rows, "s", "y", (0, 1)).count() == len(values)


def test_ks_p_value(spark):
    from assayloom.functions.numeric import ks_p_value

    one = spark.range(1)
    p = one.select(ks_p_value(F.lit(0.0491), F.lit(1980.0), F.lit(496.0))).first()[0]
    assert p == pytest.approx(0.2829, abs=0.01)
    assert one.select(ks_p_value(F.lit(0.0), F.lit(50.0), F.lit(50.0))).first()[0] == 1.0
    far = one.select(ks_p_value(F.lit(1.0), F.lit(500.0), F.lit(500.0))).first()[0]
    assert 0.0 <= far < 1e-12 and not math.isnan(far)


def exact_ks_p(n1, n2, band):
    """Share of lattice paths that leave the band, by counting the paths inside with whole numbers."""
    inside = [[0] * (n2 + 1) for _ in range(n1 + 1)]
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if abs(i * n2 - j * n1) < band:
                inside[i][j] = 1 if i == j == 0 else (
                    (inside[i - 1][j] if i else 0) + (inside[i][j - 1] if j else 0))
    return 1 - inside[n1][n2] / math.comb(n1 + n2, n1)


def test_exact_ks_p_value_equals_counted_paths(spark):
    from assayloom.functions.numeric import ks_exact_p_value

    cases = [(n1, n2, band) for n1, n2 in ((1, 1), (2, 3), (5, 5), (4, 9), (30, 17)) for band in
             {0, 1, n1 * n2 // 3, n1 * n2 // 2, n1 * n2}]
    frame = spark.createDataFrame([(a, b, k / (a * b)) for a, b, k in cases], "a bigint, b bigint, d double")
    got = frame.select("a", "b", "d", ks_exact_p_value(F.col("d"), F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(exact_ks_p(r.a, r.b, round(r.d * r.a * r.b)), abs=1e-12)
    assert spark.range(1).select(ks_exact_p_value(F.lit(0.5), F.lit(0), F.lit(3))).first()[0] is None


def test_small_samples_get_exact_p_values(spark):
    rows = spark.createDataFrame([(0.1 * i, i % 3 == 0) for i in range(25)] + [(9.0, True)] * 4, "s double, g boolean")
    got = ks_two_sample(rows, "s", "g", (True, False)).first()
    assert got.p_value == pytest.approx(
        exact_ks_p(got.n_a, got.n_b, round(got.statistic * got.n_a * got.n_b)), abs=1e-12)
    far = ks_two_sample(rows, "s", "g", (True, False), exact_steps=0).first()
    assert far.statistic == got.statistic and abs(far.p_value - got.p_value) > 1e-4
