"""Numeric column expressions, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.settings import ACTIVE_THRESHOLD, NANO

_NUMBER = r"^[ \t\n\r\f]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\f]*$"


def coerce_double(text: Column) -> Column:
    """Number in a string, or null. Stricter than a plain cast, which also takes ``1d``."""
    text = text.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def neg_log10(value: Column, scale: float = NANO) -> Column:
    """``-log10(value * scale)``; null for values that are not positive."""
    return -F.log10(value * F.lit(scale))


def finite_or_zero(value: Column) -> Column:
    """NaN, infinity and null become 0.0."""
    value = value.cast("double")
    return F.when(
        value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(0.0)
    ).otherwise(value)


def default_on_error(value: Column, default: float = 0.0) -> Column:
    """Value of an expression that yields null on failure (``try_*``), else the default."""
    return F.coalesce(value, F.lit(default))


def binarise(value: Column, threshold: float = ACTIVE_THRESHOLD) -> Column:
    return (value >= F.lit(threshold)).cast("int")


def format_fixed(value: Column, digits: int = 4, missing: str = "N/A") -> Column:
    """Fixed-decimal text; a null value gives ``missing`` rather than an error."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(
        F.format_string(f"%.{digits}f", value)
    )


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for comparison across engines; adding 0.0 turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def _power_of_two(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def with_double_image(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with a 64-bit number that grows with the double ``value``: its bits, mirrored for negative
    ones, so -0.0 and 0.0 are both 0. NaN and null give null."""
    x, e, size = F.col(value), F.col("_exponent"), F.abs(F.col(value))
    # The logarithm may miss the exponent by one.
    guess = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)))
    shifted = df.withColumn("_exponent", guess).withColumn(
        "_exponent", e + F.when(size < _power_of_two(e), -1)
        .when(size / _power_of_two(e) >= 2.0, 1).otherwise(0))
    fraction = ((size / _power_of_two(e) - 1.0) * F.lit(2.0**52)).cast("bigint")
    image = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(size == float("inf"), F.lit(2047 << 52))
        .when(size < F.lit(2.0**-1022), (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint"))
        .otherwise(F.shiftleft((e + 1023).cast("bigint"), 52) + fraction)
    )
    signed = F.when(~F.isnan(x), F.when(x < 0, -image).otherwise(image))
    return shifted.withColumn(out, signed).drop("_exponent")


def double_of_image(image: Column) -> Column:
    """The double that ``with_double_image`` gave this number to."""
    size = F.abs(image)
    fraction = F.lit(1.0) + size.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(2.0**52)
    normal = fraction * _power_of_two(F.shiftright(size, 52) - 1023)
    tiny = size.cast("double") * F.lit(2.0**-537) * F.lit(2.0**-537)
    double = F.when(size < F.lit(1 << 52), tiny).when(
        size == F.lit(2047 << 52), F.lit(float("inf"))).otherwise(normal)
    return F.when(image < 0, -double).otherwise(double)


def r2(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; a constant target scores 1.0 when fitted exactly, else 0.0."""
    return F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0) - F.try_divide(sse, sst)
    )


def ks_p_value(statistic: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value with the usual finite-sample factor.

    The alternating series converges slowly near zero, where the p-value is 1 to many digits.
    """
    root = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (root + F.lit(0.12) + F.lit(0.11) / root) * statistic
    terms_sum = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * j * j * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms_sum))
    )


def ks_exact_p_value(statistic: Column, n1: Column, n2: Column) -> Column:
    """Exact two-sample p-value: the share of paths on a lattice of n1 x n2 steps that somewhere leave
    the band in which both shares of steps differ by less than the statistic.

    A fold over the diagonals carries, for each point, that share among the paths to it; a point outside
    has 1. The array runs along the smaller sample, so the work is (n1 + n2) * min(n1, n2) steps.
    """
    short, long = F.least(n1, n2).cast("bigint"), F.greatest(n1, n2).cast("bigint")
    made = F.struct(short.alias("m"), long.alias("n"),
                    F.round(statistic * short * long).cast("bigint").alias("band"))

    def share(size: Column) -> Column:
        m, n, band = size["m"], size["n"], size["band"]
        along = F.sequence(F.lit(0).cast("bigint"), m)

        def step(before: Column, diagonal: Column) -> Column:
            def point(i: Column) -> Column:
                j = diagonal - i
                outside = F.abs(i * n - j * m) >= band
                left = F.coalesce(F.get(before, (i - 1).cast("int")), F.lit(0.0))
                mixed = (i * left + j * F.get(before, i.cast("int"))) / diagonal
                return F.when((j < 0) | (j > n), F.lit(0.0)).when(outside, F.lit(1.0)).otherwise(mixed)

            return F.transform(along, point)

        first = F.transform(along, lambda i: F.when((band <= 0) & (i == 0), F.lit(1.0)).otherwise(F.lit(0.0)))
        last = F.aggregate(F.sequence(F.lit(1).cast("bigint"), m + n), first, step)
        return F.get(last, m.cast("int"))

    bound = F.get(F.transform(F.array(made), share), F.lit(0))
    return F.when((short > 0) & statistic.isNotNull(), F.least(bound, F.lit(1.0)))
