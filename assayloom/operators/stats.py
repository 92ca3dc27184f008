"""Summaries, metrics, correlation and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.numeric import r2
from assayloom.operators.selection import values_at_ranks, vector_values_at_ranks
from assayloom.session import constant_table


def dataset_summary(
    df: DataFrame, value: str, key: str, by: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    """Count, mean, sample deviation, min, max and number of distinct keys."""
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_samples"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        distinct.alias("unique_keys"),
    )


def feature_long(df: DataFrame, features: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per vector entry: (keep..., pos, x), x as double."""
    return df.select(*keep, F.posexplode(features).alias("pos", "_x")).select(
        *keep, "pos", F.col("_x").cast("double").alias("x")
    )


def feature_summary(df: DataFrame, features: str) -> DataFrame:
    """Per position: rows, mean, population deviation, min, max; n_features on each row."""
    per_pos = feature_long(df, features).groupBy("pos").agg(
        F.count("*").alias("n_samples"),
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    # The window spans one row per position.
    return per_pos.withColumn("n_features", F.count("*").over(Window.partitionBy()))


def regression_metrics(
    df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """n, mse, rmse, r2 over rows that have both values; one pass, combined on the map side.

    Rows without one drop out of the sums: a filter on the prediction would compute it twice.
    """
    error = F.col("_error")
    sums = (
        df.select(*by, F.col(y).alias("_label"), (F.col(y) - F.col(prediction)).alias("_error"))
        .groupBy(*by)
        .agg(
            F.count(error).alias("n"),
            F.sum(error * error).alias("_sse"),
            F.var_pop(F.when(error.isNotNull(), F.col("_label"))).alias("_var"),
        )
    )
    if by:
        sums = sums.where("n > 0")
    mse = F.try_divide(F.col("_sse"), F.col("n"))
    return sums.select(
        *by,
        "n",
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        r2(F.col("_sse"), F.col("_var") * F.col("n")).alias("r2"),
    )


def split_metrics(
    df: DataFrame, y: str, prediction: str, features: str | None = None, split_col: str = "split"
) -> DataFrame:
    """Regression metrics per split, with row and feature counts."""
    out = regression_metrics(df, y, prediction, [split_col])
    if features is not None:
        width = df.agg(F.max(F.size(features))).scalar()
        out = out.withColumn("n_features", width)
    return out


def prediction_summary(df: DataFrame, prediction: str) -> DataFrame:
    return df.agg(
        F.count(prediction).alias("successful"),
        F.count_if(F.col(prediction).isNull()).alias("failed"),
        F.min(prediction).alias("min_predicted"),
        F.max(prediction).alias("max_predicted"),
    )


def group_sizes(df: DataFrame, group: str, missing: str = "invalid") -> DataFrame:
    """Rows per group; rows without a group are counted together."""
    return df.groupBy(F.coalesce(F.col(group), F.lit(missing)).alias(group)).agg(
        F.count("*").alias("n_members")
    )


def distinct_keys(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.agg(count.alias("unique_keys"))


def weighted_mean(
    df: DataFrame, value: str, weight: str, by: Sequence[str], out: str = "loss"
) -> DataFrame:
    """Sum of value * weight over sum of weight."""
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(out)
    )


def best_trial(
    df: DataFrame, params: str, score: str, maximise: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """Parameters of the best trial; a failed trial (null or NaN score) is never the best
    unless all failed. Ties go to the smallest parameters."""
    worst = F.lit(float("-inf") if maximise else float("inf"))
    safe = F.when(F.col(score).isNull() | F.isnan(score), worst).otherwise(F.col(score))
    rank = F.struct((-safe if maximise else safe).alias("s"), F.col(params).alias("p"))
    return df.groupBy(*by).agg(
        F.min_by(F.col(params), rank).alias("best_params"),
        (F.max(safe) if maximise else F.min(safe)).alias("best_score"),
        F.count("*").alias("n_trials"),
    )


def cv_mean(fold_metrics: DataFrame, score: str = "r2") -> DataFrame:
    return fold_metrics.agg(F.count("*").alias("n_folds"), F.avg(score).alias("mean_score"))


def pearson(a: str, b: str) -> Column:
    """Correlation that is null, not an error, for a constant column."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """|r| of every column pair i < j in one pass; for a handful of columns."""
    pairs = list(combinations(range(len(columns)), 2))
    row = df.agg(*[pearson(columns[i], columns[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    return row.select(
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(i).alias("i"), F.lit(j).alias("j"),
                    F.abs(F.col(f"r_{i}_{j}")).alias("abs_r"),
                )
                for i, j in pairs
            ])
        )
    )


def correlation_pairs(df: DataFrame, features: str) -> DataFrame:
    """|r| of every vector position pair i < j; undefined correlations are null.

    One pass sums the d x d Gram matrix with a tree aggregation; its size depends on the vector
    width only. The pairs are spread into rows by Spark.
    """
    vectors = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    matrix = Correlation.corr(vectors, "v", "pearson").first()[0].toArray()
    d = matrix.shape[0]
    rows = constant_table(
        df.sparkSession, {"i": ("int", list(range(d))), "r": ("array<double>", matrix.tolist())}
    )
    r = F.col("r")
    return (
        rows.select("i", F.posexplode("r").alias("j", "r"))
        .where(F.col("i") < F.col("j"))
        .select("i", "j", F.when(~F.isnan(r), F.abs(r)).alias("abs_r"))
    )


def _quantile_cuts(probs: Sequence[float]):
    """Cut 2k is the rank below quantile k, cut 2k + 1 the one above."""
    def wanted(before: Column, upto: Column, n: Column) -> Column:
        ranks = F.array(*[
            F.struct(F.lit(2 * k + side).alias("cut"), edge(F.lit(p) * (n - 1)).alias("rank"))
            for k, p in enumerate(probs) for side, edge in enumerate((F.floor, F.ceil))
        ])
        inside = F.filter(ranks, lambda w: (w["rank"] >= before) & (w["rank"] < upto))
        return F.transform(inside, lambda w: w["cut"])

    return wanted


def _interpolated(found: DataFrame, by: list[str], probs: Sequence[float]) -> DataFrame:
    edges = found.groupBy(*by, "_n").agg(*[
        F.max(F.when(F.col("cut") == c, F.col("value"))).alias(f"_v{c}") for c in range(2 * len(probs))
    ])
    rank = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    return edges.select(
        *by,
        F.col("_n").alias("n"),
        F.array(*[
            F.col(f"_v{2 * k}")
            + (F.col(f"_v{2 * k + 1}") - F.col(f"_v{2 * k}")) * (r - F.floor(r))
            for k, r in enumerate(rank)
        ]).alias("quantiles"),
    )


def quantile_fit(
    df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Exact quantiles with linear interpolation: (by..., n, quantiles array).

    Radix selection finds the values at the ranks around each quantile, for groups of any size and
    values of any spread. ``by`` may be empty, or columns such as splits or positions.
    """
    by, probs = list(by), sorted(probs)
    return _interpolated(values_at_ranks(df, value, by, _quantile_cuts(probs)), by, probs)


def vector_quantile_fit(
    df: DataFrame, features: str, probs: Sequence[float] = (0.25, 0.5, 0.75), weight: str | None = None
) -> DataFrame:
    """(pos, n, quantiles) of every position of a vector column, without a row per number; a row counts
    ``weight`` (a whole number of) times."""
    probs = sorted(probs)
    found = vector_values_at_ranks(df, features, _quantile_cuts(probs), weight)
    return _interpolated(found, ["pos"], probs)


def mean_std_fit(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def grouped_linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """One straight line per group, all groups in one pass; groups with constant x drop out."""
    return (
        df.groupBy(*by)
        .agg(
            F.regr_count(F.col(y), F.col(x)).alias("n"),
            F.regr_slope(F.col(y), F.col(x)).alias("slope"),
            F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
            F.regr_r2(F.col(y), F.col(x)).alias("r2"),
            F.regr_sxx(F.col(y), F.col(x)).alias("_sxx"),
        )
        .where(F.col("_sxx") > 0)
        .drop("_sxx")
    )


def linear_cross_validate(df: DataFrame, x: str, y: str, fold: str = "fold") -> DataFrame:
    """Held-out r2 per fold of a one-feature line fitted on the other folds.

    One pass collects moments per fold (k rows). The moments of "all but this fold" follow from
    the totals, so the data is neither repeated k times nor scanned k times.
    """
    m = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(fold)
        .agg(
            F.count("*").cast("double").alias("n"),
            F.avg(x).alias("mx"),
            F.avg(y).alias("my"),
            F.var_pop(x).alias("vx"),
            F.var_pop(y).alias("vy"),
            F.covar_pop(x, y).alias("cxy"),
        )
    )
    # The window spans k rows, one per fold.
    everything = Window.partitionBy()
    gx = F.sum(F.col("n") * F.col("mx")).over(everything) / F.sum("n").over(everything)
    gy = F.sum(F.col("n") * F.col("my")).over(everything) / F.sum("n").over(everything)
    m = m.withColumn("gx", gx).withColumn("gy", gy)
    # Sums of squares around the common centre (gx, gy) add up across folds.
    dx, dy, n = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy"), F.col("n")
    m = m.withColumns({
        "sx": n * dx,
        "sy": n * dy,
        "sxx": n * (F.col("vx") + dx * dx),
        "sxy": n * (F.col("cxy") + dx * dy),
        "syy": n * (F.col("vy") + dy * dy),
    })
    for s in ("n", "sx", "sy", "sxx", "sxy"):
        m = m.withColumn(f"t_{s}", F.sum(s).over(everything) - F.col(s))
    tn, tx, ty = F.col("t_n"), F.col("t_sx"), F.col("t_sy")
    b = F.try_divide(F.col("t_sxy") - tx * ty / tn, F.col("t_sxx") - tx * tx / tn)
    m = m.withColumn("slope", b).withColumn(
        "offset", ty / tn - F.col("slope") * tx / tn
    )
    s, a = F.col("slope"), F.col("offset")
    sse = (
        F.col("syy") - 2 * s * F.col("sxy") - 2 * a * F.col("sy")
        + s * s * F.col("sxx") + 2 * a * s * F.col("sx") + a * a * n
    )
    return m.select(
        fold,
        n.cast("bigint").alias("n"),
        s.alias("slope"),
        (a + F.col("gy") - s * F.col("gx")).alias("intercept"),
        r2(sse, F.col("vy") * n).alias("r2"),
    )
