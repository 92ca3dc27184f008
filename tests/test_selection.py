"""Radix selection: images of doubles, exact ranks whatever the values, balanced ranges."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.functions.numeric import double_of_image, with_double_image
from assayloom.operators.ordered import balanced_ranges, running_totals
from assayloom.operators.selection import images
from assayloom.operators.stats import quantile_fit, vector_quantile_fit


def hard_doubles():
    rng = random.Random(0)
    out = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.7976931348623157e308]
    for e in range(-1074, 1024):
        power = math.ldexp(1.0, e)
        out += [power, -power, float(np.nextafter(power, math.inf)), float(np.nextafter(power, 0.0))]
    out += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    return sorted(float(x) for x in out if not math.isnan(x))


def test_images_grow_with_doubles_and_lead_back(spark):
    values = hard_doubles()
    frame = spark.createDataFrame([(x,) for x in values], "x double")
    rows = with_double_image(frame, "x", "image").select(
        "x", "image", double_of_image(F.col("image")).alias("back")).collect()
    assert all(r.back == r.x for r in rows)
    rows.sort(key=lambda r: r.x)
    got = [r.image for r in rows]
    assert all((a.x < b.x) == (a.image < b.image) for a, b in zip(rows, rows[1:]))
    assert got == images(np.array([r.x for r in rows])).tolist()
    assert with_double_image(spark.createDataFrame([(float("nan"),), (None,)], "x double"), "x", "i").where(
        "i is not null").count() == 0


def clustered(n):
    """A million values' worth of trouble in small: all within a few ulps, in steps of one."""
    x, out = 1.0, []
    for _ in range(n):
        out.append(x)
        x = float(np.nextafter(x, 2.0))
    return out


CASES = {
    "lognormal": lambda rng: [math.exp(rng.gauss(0, 30)) * rng.choice([1, -1]) for _ in range(5000)],
    "ulps": lambda rng: clustered(4000) + [1e300, -1e300],
    "ties": lambda rng: [rng.choice([0.0, 0.0, -0.0, 2.0]) for _ in range(3000)],
    "huge": lambda rng: [0.0] * 10 + [1e308] * 5 + [-1e308] * 4,
}


@pytest.mark.parametrize("case", CASES)
def test_exact_quantiles(spark, case):
    values = CASES[case](random.Random(1))
    random.Random(2).shuffle(values)
    frame = spark.createDataFrame(
        [(None if i % 7 == 0 else "g", x) for i, x in enumerate(values)] + [("nan", math.nan), ("g", None)],
        "g string, x double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {r.g: r for r in quantile_fit(frame, "x", ["g"], probs).collect()}
    for g in ("g", None):
        own = np.array([x for i, x in enumerate(values) if (i % 7 == 0) == (g is None)])
        assert got[g].n == len(own)
        low, high = np.quantile(own, probs, method="lower"), np.quantile(own, probs, method="higher")
        assert all(a <= q <= b for a, q, b in zip(low, got[g].quantiles, high))
        assert got[g].quantiles[0] == own.min() and got[g].quantiles[-1] == own.max()
    assert "nan" not in got
    whole = quantile_fit(frame, "x", [], probs).first()
    assert whole.n == len(values)


def test_a_million_values_within_few_ulps(spark):
    step = 2.0**-52
    frame = spark.range(1_000_000).select((1.0 + F.col("id") * step).alias("x"))
    low, mid, high = quantile_fit(frame, "x", []).first().quantiles
    assert (low, mid, high) == tuple(pytest.approx(1 + q * 999_999 * step, abs=step) for q in (0.25, 0.5, 0.75))
    sizes = balanced_ranges(frame, "x", 16).groupBy("_range").count().collect()
    assert {r["count"] for r in sizes} == {62_500}


def test_vector_quantiles(spark):
    rng = np.random.default_rng(3)
    matrix = np.stack([rng.normal(size=1500), np.exp(rng.normal(size=1500) * 20),
                       (rng.random(1500) < 0.01).astype(float), np.full(1500, -2.5)], axis=1)
    matrix[5, 0] = math.nan
    frame = spark.createDataFrame([(row.tolist(),) for row in matrix] + [(None,), ([9.0],)], "v array<double>")
    got = {r.pos: r for r in vector_quantile_fit(frame.repartition(4), "v").collect()}
    for pos in range(4):
        own = matrix[:, pos][~np.isnan(matrix[:, pos])]
        own = np.append(own, 9.0) if pos == 0 else own
        assert got[pos].n == len(own)
        assert got[pos].quantiles == pytest.approx(np.percentile(own, [25, 50, 75]).tolist(), rel=1e-12)


def test_heavy_tails_fall_into_ranges_of_one_size(spark):
    rng = random.Random(4)
    values = {math.exp(rng.gauss(0, 40)) for _ in range(6000)}
    frame = spark.createDataFrame([(x,) for x in values], "x double")
    for ranges in (3, 16, 100):
        counts = [r["count"] for r in balanced_ranges(frame, "x", ranges).groupBy("_range").count().collect()]
        assert len(counts) == ranges and max(counts) - min(counts) <= 1
    got = running_totals(frame.unionAll(frame), "x", {"n": F.lit(1)}, descending=True).collect()
    for i, r in enumerate(sorted(got, key=lambda r: -r.x), 1):
        assert (r.n, r.cum_n, r.all_n) == (2, 2 * i, 2 * len(values))


def test_ranks_of_whole_float_vectors_take_the_short_way(spark):
    """Vectors of one width without NaN, as floats: ranks equal those of each position sorted by itself."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 2, (1500, 4)), rng.normal(size=(1500, 3)) * 1e6, -np.ones((1500, 1)) * 0.0], 1)
    x = x.astype(np.float32)
    frame = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<float>").repartition(3)
    got = {r.pos: r.quantiles for r in vector_quantile_fit(frame, "v").collect()}
    want = np.quantile(x.astype(float), [0.25, 0.5, 0.75], axis=0).T
    assert sorted(got) == list(range(8))
    assert all(np.allclose(got[p], want[p], rtol=1e-12) for p in got)
