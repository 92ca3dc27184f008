"""Global order without a global sort task.

Two building blocks:

* ``hash_thresholds`` finds the hash values at given ranks. A histogram over hash prefixes
  tells which prefix holds each rank; the histogram is taken again inside those prefixes, and
  only the rows of the narrow prefixes that are left are ranked. Splits then compare a row's own
  hash with a few thresholds, so the rows themselves never move.
* ``running_totals`` gives running sums along a value: equal values are merged, values are put
  into ranges of equally many values, whose limits radix selection finds, the sums run inside each
  range, and the totals of the earlier ranges are added from a table with one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.numeric import ks_exact_p_value, ks_p_value
from assayloom.operators.selection import values_at_ranks
from assayloom.session import stored

DIGITS_PER_LEVEL = 4  # 65,536 cells in each histogram
LEVELS = 2
ROWS_PER_RANGE = 1_000_000
#: Lattice points up to which a KS p-value is exact; a second of work for one task.
KS_EXACT_STEPS = 2_000_000


def hash_thresholds(
    df: DataFrame, hash_col: str, positions: DataFrame, by: Sequence[str] = (),
    digits: int = DIGITS_PER_LEVEL, levels: int = LEVELS,
) -> DataFrame:
    """Hash values at given ranks.

    ``df`` holds ``hash_col`` (uniform hex, one value per row, so the hashed key should be
    unique) and the columns ``by``. ``positions`` holds ``by``, ``cut`` and the 1-based rank
    ``position``; it has one row per group and cut. Returns ``by``, ``cut``, ``threshold``; a
    position of 0, or one beyond the group, has no row. Rows without a hash do not count.

    Each level narrows the cell of a rank by a factor of 16 ** ``digits``; with two levels of
    four digits a cell of 10^12 rows holds a few hundred in the end, and those are ranked.
    """
    by = list(by)
    df = df.where(F.col(hash_col).isNotNull())
    held = positions.select(*by, "cut", F.col("position").alias("_rank"), F.lit("").alias("_cell"))
    for level in range(levels):
        outer = F.substring(hash_col, 1, digits * level)
        inner = F.substring(hash_col, 1, digits * (level + 1))
        # The cells of the ranks so far: one row per group and cut; Spark chooses the join.
        inside = df.select(*by, hash_col).withColumn("_cell", outer)
        if level:
            inside = inside.join(held.select(*by, "_cell").distinct(), [*by, "_cell"], "left_semi")
        cells = inside.groupBy(*by, "_cell", inner.alias("_next")).agg(F.count("*").alias("_in"))
        along = Window.partitionBy(*by, "_cell").orderBy("_next")
        cells = cells.withColumn("_upto", F.sum("_in").over(along))
        held = held.join(cells, [*by, "_cell"]).where(
            (F.col("_rank") > F.col("_upto") - F.col("_in")) & (F.col("_rank") <= F.col("_upto"))
        ).select(
            *by, "cut", (F.col("_rank") - (F.col("_upto") - F.col("_in"))).alias("_rank"),
            F.col("_next").alias("_cell"),
        )
    inside = (
        df.withColumn("_cell", F.substring(hash_col, 1, digits * levels))
        .join(held, [*by, "_cell"])
        .groupBy(*by, "cut", "_rank", hash_col)
        .agg(F.count("*").alias("_n"))
    )
    along = Window.partitionBy(*by, "cut").orderBy(hash_col)
    inside = inside.withColumn("_upto", F.sum("_n").over(along))
    return inside.where(
        (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))
    ).select(*by, "cut", F.col(hash_col).alias("threshold"))


def thresholds_by_cut(df: DataFrame, hash_col: str, cuts: Sequence[Column]) -> Column:
    """Map from cut number to threshold, for ranks that are expressions over the row count ``n``
    of the rows with a hash. A cut of rank 0 has no entry."""
    positions = df.agg(F.count(hash_col).alias("n")).select(
        F.inline(
            F.array(*[
                F.struct(F.lit(i).alias("cut"), c.cast("bigint").alias("position"))
                for i, c in enumerate(cuts)
            ])
        )
    )
    found = hash_thresholds(df, hash_col, positions)
    return found.agg(F.map_from_entries(F.collect_list(F.struct("cut", "threshold")))).scalar()


def even_cuts(ranges: int, start: int = 1):
    """Cut i, from ``start`` to ``ranges`` - 1, has the rank i * n / ranges, rounded down."""
    def wanted(before: Column, upto: Column, n: Column) -> Column:
        def reached(rank: Column) -> Column:  # the first cut at or behind a rank
            return F.call_function("div", rank * F.lit(ranges) + n - 1, n)

        first, behind = F.greatest(reached(before), F.lit(start)), F.least(reached(upto), F.lit(ranges))
        return F.when(first < behind, F.sequence(first, behind - 1)).otherwise(
            F.array().cast("array<bigint>"))

    return wanted


def balanced_ranges(values: DataFrame, value: str, ranges: int, out: str = "_range") -> DataFrame:
    """``values`` with the number of one of ``ranges`` ranges that hold equally many rows.

    ``value`` holds doubles, each once. The limits are values at exact ranks, so the spread of the
    values plays no part; one number per range comes to the driver.
    """
    limits = values_at_ranks(values, value, [], even_cuts(ranges)).select("value").collect()
    inner = sorted({r["value"] for r in limits if abs(r["value"]) != float("inf")})
    if not inner:
        return values.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *inner, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol=out).transform(values)


def running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, Column],
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """One row per distinct value: own sums (``name``), running sums (``cum_name``) and
    overall sums (``all_name``).

    Equal values are merged first, into a stored table that the later steps read. Its values are put
    into ranges of equally many, at least ``ranges`` of them (the shuffle partitions if not given) and
    one for each ROWS_PER_RANGE values. Null and NaN values are left out.
    """
    df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    # The merge combines on the map side: a value held by a third of all rows reaches the
    # shuffle as one row per task. Adding 0.0 makes -0.0 and 0.0 one value.
    merged = stored(
        df.withColumn("_v", F.col(value).cast("double") + F.lit(0.0)).groupBy("_v").agg(
            F.min(value).alias(value), *[F.sum(c).alias(n) for n, c in sums.items()]),
        "merged",
    )
    least = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = balanced_ranges(merged, "_v", max(least, -(-merged.count() // ROWS_PER_RANGE)))
    order = F.col("_v").desc() if descending else F.col("_v").asc()
    inside = Window.partitionBy("_range").orderBy(order)
    local = ranged.select(
        "_range", value, *sums,
        *[F.sum(n).over(inside).alias(f"_run_{n}") for n in sums],
    )
    totals = ranged.groupBy("_range").agg(*[F.sum(n).alias(f"_all_{n}") for n in sums])
    # One row per range.
    along = F.desc("_range") if descending else F.asc("_range")
    before = Window.orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(f"_all_{n}").over(Window.partitionBy()).alias(f"all_{n}") for n in sums],
    )
    return local.join(offsets, "_range").select(
        value,
        *sums,
        *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in sums],
        *[f"all_{n}" for n in sums],
    )


def roc_curve(
    df: DataFrame, score: str, truth: str, with_origin: bool = False, ranges: int | None = None
) -> DataFrame:
    """Threshold, tp, fp, tpr, fpr by descending score; tied scores share one point.

    One-class input leaves the rate of the missing class null. ``with_origin`` adds the point
    (0, 0) at threshold +infinity. All points are kept, also those on a straight line.
    """
    data = df.where(F.col(truth).isNotNull())
    curve = running_totals(
        data,
        score,
        {
            "pos": (F.col(truth) == 1).cast("bigint"),
            "neg": (F.col(truth) != 1).cast("bigint"),
        },
        descending=True,
        ranges=ranges,
    )
    points = curve.select(
        F.col(score).cast("double").alias("threshold"),
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
        F.try_divide(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
    )
    if with_origin:
        origin = df.sparkSession.range(1).select(
            F.lit(float("inf")).alias("threshold"),
            F.lit(0).cast("bigint").alias("tp"),
            F.lit(0).cast("bigint").alias("fp"),
            F.lit(0.0).alias("tpr"),
            F.lit(0.0).alias("fpr"),
        )
        points = origin.unionByName(points)
    return points


def auc(df: DataFrame, score: str, truth: str, ranges: int | None = None) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule, ties included; null for one class."""
    curve = running_totals(
        df.where(F.col(truth).isNotNull()),
        score,
        {
            "pos": (F.col(truth) == 1).cast("bigint"),
            "neg": (F.col(truth) != 1).cast("bigint"),
        },
        descending=True,
        ranges=ranges,
    )
    # A step of `neg` to the right lies between heights cum_pos - pos and cum_pos.
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    pos, neg = F.sum("pos"), F.sum("neg")
    return curve.agg(
        pos.alias("n_pos"),
        neg.alias("n_neg"),
        F.try_divide(area, pos.cast("double") * neg.cast("double")).alias("auc"),
    )


def ecdf(df: DataFrame, value: str, group: str, groups: tuple, ranges: int | None = None) -> DataFrame:
    """Empirical distribution functions of two groups at every distinct value of either."""
    first, second = groups
    curve = running_totals(
        df.where(F.col(group).isin(first, second)),
        value,
        {
            "a": (F.col(group) == first).cast("bigint"),
            "b": (F.col(group) == second).cast("bigint"),
        },
        ranges=ranges,
    )
    return curve.select(
        value,
        F.try_divide(F.col("cum_a"), F.col("all_a")).alias("cdf_a"),
        F.try_divide(F.col("cum_b"), F.col("all_b")).alias("cdf_b"),
        F.col("a").alias("n_a"),
        F.col("b").alias("n_b"),
    )


def ks_two_sample(
    df: DataFrame, value: str, group: str, groups: tuple, ranges: int | None = None,
    exact_steps: int = KS_EXACT_STEPS,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-value; one row.

    The p-value is exact while (n_a + n_b) * min(n_a, n_b) is at most ``exact_steps``, else the
    asymptotic one.
    """
    stats = ecdf(df, value, group, groups, ranges).agg(
        F.sum("n_a").alias("n_a"),
        F.sum("n_b").alias("n_b"),
        F.max(F.abs(F.col("cdf_a") - F.col("cdf_b"))).alias("statistic"),
    )
    few = (F.col("n_a") + F.col("n_b")) * F.least("n_a", "n_b") <= F.lit(exact_steps)
    sizes = (F.col("n_a").cast("double"), F.col("n_b").cast("double"))
    return stats.withColumn(
        "p_value",
        F.when(few, ks_exact_p_value(F.col("statistic"), F.col("n_a"), F.col("n_b"))).otherwise(
            ks_p_value(F.col("statistic"), *sizes)),
    )
