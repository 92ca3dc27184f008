"""Result projections, rankings, training history and the tables behind the plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.session import stored
from assayloom.settings import PATIENCE


def score_status(prediction: Column) -> Column:
    return F.when(prediction.isNotNull(), F.lit("success")).otherwise(F.lit("failed"))


def confidence_struct(prediction: Column) -> Column:
    """Spread of a single model: deviation 0, min and max equal to the mean; null if failed."""
    return F.when(
        prediction.isNotNull(),
        F.struct(
            prediction.alias("mean"),
            F.lit(0.0).alias("std"),
            prediction.alias("min"),
            prediction.alias("max"),
        ),
    )


def ensemble_confidence(
    df: DataFrame, prediction: str, by: Sequence[str]
) -> DataFrame:
    """Spread over several models' predictions for the same row."""
    return df.groupBy(*by).agg(
        F.struct(
            F.avg(prediction).alias("mean"),
            F.stddev_pop(prediction).alias("std"),
            F.min(prediction).alias("min"),
            F.max(prediction).alias("max"),
        ).alias("confidence")
    )


def with_residuals(df: DataFrame, y: str, prediction: str) -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(prediction))


def top_k(df: DataFrame, score: str, name: str, k: int = 20) -> DataFrame:
    """The k best rows with their rank; one heap per task, k rows to the last step."""
    best = df.orderBy(F.col(score).desc(), F.col(name)).limit(k)
    rank = F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(name)))
    return best.withColumn("rank", rank)


def rank_features(df: DataFrame, score: str, name: str) -> DataFrame:
    """Full descending rank of a feature table (one row per feature, so one task is enough)."""
    rank = F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(name)))
    return df.withColumn("rank", rank)


def early_stop(
    history: DataFrame, run: str, epoch: str, loss: str, patience: int = PATIENCE
) -> DataFrame:
    """Per run: stopping epoch (null if never), best epoch and loss up to it.

    Only a strictly lower loss counts as improvement; the run stops once ``patience`` epochs
    have passed without one. The history has one row per run and epoch, so a window over a
    run holds as many rows as the run had epochs; aggregate batch losses first
    (``stats.weighted_mean``).
    """
    ordered = Window.partitionBy(run).orderBy(epoch)
    seen = history.select(
        run,
        F.col(epoch).alias("epoch"),
        F.col(loss).alias("loss"),
        F.row_number().over(ordered).alias("_i"),
        F.min(loss).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("_best"),
    )
    improves = F.coalesce(F.col("loss") < F.col("_best"), ~F.isnan("loss"))
    along = Window.partitionBy(run).orderBy("_i")
    seen = seen.withColumn(
        "_last", F.coalesce(F.max(F.when(improves, F.col("_i"))).over(along), F.lit(0))
    )
    seen = seen.withColumn(
        "_stop", F.min(F.when(F.col("_i") - F.col("_last") >= patience, F.col("_i"))).over(
            Window.partitionBy(run))
    )
    used = F.col("_stop").isNull() | (F.col("_i") <= F.col("_stop"))
    return seen.where(used).groupBy(run).agg(
        F.count("*").alias("epochs_run"),
        F.max(F.when(F.col("_i") == F.col("_stop"), F.col("epoch"))).alias("stop_epoch"),
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"),
        F.min("loss").alias("best_loss"),
    )


def best_epoch(history: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """Checkpoint to keep per run: lowest loss, the earliest epoch on a tie."""
    return history.where(F.col(loss).isNotNull() & ~F.isnan(loss)).groupBy(run).agg(
        F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"),
        F.min(loss).alias("best_loss"),
    )


#: Cells per bandwidth, and terms kept of each cell's values around its centre. The terms left out
#: change the kernel by less than (1/8)^10 * 0.44 / sqrt(10!) = 3e-13 of its height.
KDE_CELLS, KDE_TERMS = 4, 10


def _kernel_terms() -> list[list[float]]:
    """Row k: coefficients by power of z of He_k(z) / k!, from He_k = z He_(k-1) - (k-1) He_(k-2)."""
    rows = [[1.0], [0.0, 1.0]]
    for k in range(2, KDE_TERMS):
        own = [0.0, *rows[-1]]
        for i, c in enumerate(rows[-2]):
            own[i] -= (k - 1) * c
        rows.append(own)
    return [[c / math.factorial(k) for c in row] for k, row in enumerate(rows)]


def kde_grid(
    df: DataFrame,
    value: str,
    by: str,
    points: int = 200,
    cut: float = 3.0,
) -> DataFrame:
    """Gaussian density of a value on its own grid for each group: (by, point, x, density).

    Bandwidth n^(-1/5) * sample deviation; the grid runs ``cut`` bandwidths beyond the data.
    A task sums its values into cells of a quarter bandwidth, as power sums around the centre of each
    cell, so the rows it sends depend on the number of cells near grid points (at most 320 for
    each point), not on how many different values there are. The kernel around a centre is a polynomial
    in these sums times a Gaussian (see KDE_TERMS for the error). Beyond 39 bandwidths the density is
    below the smallest double.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(
        by, F.col(value).cast("double").alias("_v"))
    # One row per group, stored, so Spark knows the size when it joins.
    shape = stored(rows.groupBy(by).agg(
        F.count("*").alias("_n"),
        (F.pow(F.count("*").cast("double"), F.lit(-0.2)) * F.stddev_samp("_v")).alias("_h"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    ).where(F.col("_h") > 0), "shape")
    h = F.col("_h")
    low, high = F.col("_lo") - cut * h, F.col("_hi") + cut * h
    step = (high - low) / F.lit(points - 1)
    cell = F.floor((F.col("_v") - F.col("_lo")) / h * KDE_CELLS)
    centre = F.col("_lo") + (F.col("_cell") + 0.5) * h / KDE_CELLS
    apart = (F.col("_v") - centre) / h

    def nearest(edge: Column) -> Column:
        at = F.floor((edge - low) / step)
        return F.least(F.greatest(at, F.lit(0)), F.lit(points - 1)).cast("int")

    placed = rows.join(shape, by).withColumn("_cell", cell)
    near = F.abs(low + step * nearest(centre + step / 2) - centre) <= 40 * h
    cells = placed.where(near).withColumn("_t", apart).groupBy(by, "_n", "_h", "_lo", "_hi", "_cell").agg(
        *[F.sum(F.pow("_t", F.lit(float(k)))).alias(f"_m{k}") for k in range(KDE_TERMS)])
    terms = _kernel_terms()
    powers = [
        sum((F.col(f"_m{k}") * row[j] for k, row in enumerate(terms) if j < len(row) and row[j]), F.lit(0.0))
        for j in range(KDE_TERMS)
    ]
    z = (low + step * F.col("point") - centre) / h
    summed = F.col(f"_p{KDE_TERMS - 1}")
    for j in range(KDE_TERMS - 2, -1, -1):
        summed = summed * F.col("_z") + F.col(f"_p{j}")
    reach = F.sequence(nearest(centre - 39 * h), nearest(centre + 39 * h + step))
    keys = [by, "_n", "_h", "_lo", "_hi", "point"]
    added = (
        cells.select(by, "_n", "_h", "_lo", "_hi", "_cell", *[p.alias(f"_p{j}") for j, p in enumerate(powers)])
        .withColumn("point", F.explode(reach)).withColumn("_z", z)
        .select(*keys, (summed * F.exp(-0.5 * F.col("_z") * F.col("_z"))).alias("_d"))
    )
    # Every grid point has a row, also where no value reaches.
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return (
        added.unionByName(grid.select(*keys, F.lit(0.0).alias("_d")))
        .withColumn("x", low + step * F.col("point"))
        .groupBy(by, "point")
        .agg(
            F.min("x").alias("x"),
            (F.sum("_d") / (F.min("_n") * F.min("_h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"),
        )
    )


def learning_curve(history: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """(run, epoch, loss) in order."""
    return history.select(run, epoch, loss).orderBy(run, epoch)
