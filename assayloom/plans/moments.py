"""Linear models from sums: one pass over the rows, whatever the folds and trials.

Least squares, with or without a penalty, sees its rows only through their count, means and covariances. A fold's
train rows have the sums of the other folds, so all folds and all trials follow from one set of sums per fold. The
regressor is still Spark's: it is given a few weighted rows that have the same sums. It standardises features by itself,
so the scaler's medians and divisors change nothing in the predictions and are not fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.session import constant_table

#: Parameters under which the fit follows from the sums.
PENALTIES = {"regParam", "elasticNetParam", "maxIter", "tol"}
#: Spark solves wider problems from the rows.
WIDEST = 4096


@dataclass(frozen=True)
class Moments:
    """Count, means and products of the deviations of (features..., label)."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, weights: np.ndarray) -> Moments:
        n = float(weights.sum())
        mean = weights @ rows / n
        return cls(n, mean, ((rows - mean) * weights[:, None]).T @ (rows - mean))

    @classmethod
    def from_bytes(cls, data: bytes) -> Moments:
        flat = np.frombuffer(data)
        width = int(np.sqrt(len(flat)))  # 1 + width + width ** 2 numbers
        return cls(flat[0], flat[1:width + 1], flat[width + 1:].reshape(width, width))

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.products.ravel()]).tobytes()

    def __add__(self, other: Moments) -> Moments:
        n, away = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + away * (other.n / n),
                       self.products + other.products + np.outer(away, away) * (self.n * other.n / n))

    @property
    def finite(self) -> bool:
        return bool(np.isfinite(self.mean).all() and np.isfinite(self.products).all())

    @property
    def covariance(self) -> np.ndarray:
        return self.products / self.n

    @property
    def std(self) -> np.ndarray:
        """Population deviations; 0 for a constant, whose variance is nothing but rounding."""
        variance = np.diag(self.covariance)
        return np.sqrt(np.where(variance > 1e-24 * self.mean**2, variance, 0.0))

    def correlated(self, threshold: float) -> set[int]:
        """Features j with a feature i < j whose |r| is above the threshold; constants have no r."""
        std = self.std[:-1]
        scale = np.where(std > 0, std, np.inf)
        r = np.abs(self.covariance[:-1, :-1] / np.outer(scale, scale))
        return set(np.flatnonzero((np.triu(r, 1) > threshold).any(0)).tolist())

    def moved(self, kept: list[int], centres: np.ndarray, divisors: np.ndarray) -> Moments:
        """Moments of (x - centre) / divisor of the numbers in ``kept``."""
        return Moments(self.n, (self.mean[kept] - centres) / divisors,
                       self.products[np.ix_(kept, kept)] / np.outer(divisors, divisors))

    def same_rows(self, spark: SparkSession) -> DataFrame:
        """(features, label, weight): twice as many rows as numbers in one, with these means and covariances."""
        covariance = self.covariance
        std = self.std
        varies = std > 0
        scale = np.where(varies, std, 1.0)
        values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale) * np.outer(varies, varies))
        away = (vectors * np.sqrt(np.maximum(values, 0.0) * len(std))).T * std
        rows = self.mean + np.concatenate([away, -away])
        table = constant_table(spark, {
            "a": ("array<double>", rows[:, :-1].tolist()), "label": ("double", rows[:, -1].tolist()),
            "weight": ("double", [self.n / len(rows)] * len(rows)),
        })
        return table.select(array_to_vector("a").alias("features"), "label", "weight")

    def r2(self, coefficients: np.ndarray, intercept: float) -> float:
        """1 - squared errors over squared deviations, of the line on these rows."""
        weights = np.append(-coefficients, 1.0)
        error = weights @ self.covariance @ weights + (weights @ self.mean - intercept) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(1.0 - error / self.covariance[-1, -1])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's moments of each fold; of fold -1 if the vectors are too wide."""
    held: dict[int, Moments] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            folds = part.column(0).to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
            if sizes.min() != sizes.max():
                raise ValueError("all feature vectors must have the same length")
            if sizes[0] >= WIDEST:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""])], ["fold", "sums"])
                return
            z = np.column_stack([
                part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(folds), -1),
                part.column(2).to_numpy(zero_copy_only=False)])
            weights = part.column(3).to_numpy(zero_copy_only=False)
            for fold in np.unique(folds).tolist():
                own = Moments.of(z[folds == fold], weights[folds == fold])
                held[fold] = held[fold] + own if fold in held else own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([m.to_bytes() for m in held.values()], pa.binary())],
        ["fold", "sums"])


def _added(table: pa.Table) -> pa.Table:
    parts = sorted(p for p in table.column("sums").to_pylist() if p)
    total = [reduce(Moments.__add__, map(Moments.from_bytes, parts)).to_bytes()] if parts else [b""]
    return pa.table({"fold": table.column("fold").slice(0, 1), "sums": pa.array(total, pa.binary())})


def _added_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum of what comes, of which one is held; empty if one is (of vectors too wide)."""
    total, wide = None, False
    for batch in batches:
        for sums in batch.column(0):
            wide = wide or not sums.as_py()
            if not wide:
                own = Moments.from_bytes(sums.as_py())
                total = own if total is None else total + own
    if wide or total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([b"" if wide else total.to_bytes()], pa.binary())], ["sums"])


def _sums(rows: DataFrame, array: Column, label: str, fold: Column, weight: str | None = None) -> DataFrame:
    """(fold, sums) of every task and fold. Rows without features, label or fold do not count."""
    times = F.lit(1.0) if weight is None else F.col(weight)
    made = rows.select(
        fold.cast("int").alias("fold"), array.alias("x"), F.col(label).cast("double").alias("y"), times.alias("w"))
    known = F.col("fold").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    return made.where(known).mapInArrow(_summed, "fold int, sums binary")


def fold_moments(rows: DataFrame, array: Column, label: str, fold_col: str) -> dict[int, Moments] | None:
    """Moments of every fold; ``array`` is the features as a column of numbers. Rows without features, label or
    fold do not count. None if the vectors are too wide."""
    found = _sums(rows, array, label, F.col(fold_col)).groupBy("fold").applyInArrow(
        _added, "fold int, sums binary").collect()
    if any(r["fold"] == -1 for r in found):
        return None
    moments = {r["fold"]: Moments.from_bytes(r["sums"]) for r in found}
    if not all(m.finite for m in moments.values()):
        raise ValueError("features and labels must be finite numbers")
    return moments


def row_moments(rows: DataFrame, array: Column, label: str, weight: str | None = None) -> Moments | None:
    """Moments of all rows that have features and label, each counted ``weight`` times. A task sends one set of sums, four tasks add these up and four
    reach the driver. None if there are no rows, the vectors are too wide or a number is not finite."""
    parts = [r["sums"] for r in _sums(rows, array, label, F.lit(0), weight).select("sums").repartition(4).mapInArrow(
        _added_on, "sums binary").collect()]
    if not parts or not all(parts):
        return None
    total = reduce(Moments.__add__, map(Moments.from_bytes, sorted(parts)))
    return total if total.finite else None


def held_out_r2(spark: SparkSession, moments: dict[int, Moments]) -> Callable[[dict], float]:
    """Mean over the folds of the r2 of a fit on the other folds, as a function of its parameters."""
    if len(moments) < 2:
        raise ValueError("cross-validation needs rows in two folds at least")
    trains = {f: reduce(Moments.__add__, (moments[g] for g in sorted(moments) if g != f)).same_rows(spark)
              for f in sorted(moments)}

    def score(params: dict) -> float:
        total = 0.0
        for fold, train in trains.items():
            model = LinearRegression(weightCol="weight").setParams(**params).fit(train)
            total += moments[fold].r2(model.coefficients.toArray(), model.intercept)
        return total / len(trains)

    return score
