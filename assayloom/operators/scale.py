"""Scaling and correlation pruning. Every fit is a small frozen object made from train rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.text import select_indices
from assayloom.operators.stats import (
    correlation_columns,
    correlation_pairs,
    mean_std_fit,
    vector_quantile_fit,
)
from assayloom.settings import CORRELATION_THRESHOLD


@dataclass(frozen=True)
class RobustScale:
    """Median and divisor per vector position; only these d pairs reach the driver."""

    medians: tuple[float, ...]
    divisors: tuple[float, ...]

    @classmethod
    def fit(cls, train: DataFrame, features: str, width: int | None = None, weight: str | None = None) -> RobustScale:
        """(x - median) / IQR; a position with zero IQR keeps divisor 1, so rare set bits stay.

        A position without any number is left as it is (median 0, divisor 1). A known ``width`` saves a pass.
        A row counts ``weight`` times.
        """
        fitted = vector_quantile_fit(train, features, weight=weight).collect()
        if not fitted:
            raise ValueError("cannot fit a scaler on no rows")
        if width is None:
            width = train.agg(F.max(F.size(features))).first()[0]
        medians, divisors = [0.0] * width, [1.0] * width
        for row in fitted:
            low, mid, high = row["quantiles"]
            medians[row["pos"]] = mid
            divisors[row["pos"]] = (high - low) or 1.0
        return cls(tuple(medians), tuple(divisors))

    def column(self, features: Column) -> Column:
        pairs = F.array(*[
            F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"))
            for m, s in zip(self.medians, self.divisors, strict=True)
        ])
        return F.zip_with(
            features, pairs, lambda x, p: (x.cast("double") - p["m"]) / p["s"]
        )

    def transform(self, df: DataFrame, features: str, out: str | None = None) -> DataFrame:
        return df.withColumn(out or features, self.column(F.col(features)))


@dataclass(frozen=True)
class StandardScale:
    """Mean and population deviation of one column; zero deviation divides by 1."""

    mean: float
    std: float

    @classmethod
    def fit(cls, train: DataFrame, value: str) -> StandardScale:
        row = mean_std_fit(train, value).first()
        if not row["n"]:
            raise ValueError("cannot fit a scaler on no rows")
        return cls(row["mean"], row["std"] or 1.0)

    def scaled(self, value: Column) -> Column:
        return (value - F.lit(self.mean)) / F.lit(self.std)

    def restored(self, value: Column) -> Column:
        return value * F.lit(self.std) + F.lit(self.mean)


@dataclass(frozen=True)
class CorrelationPrune:
    """Positions kept and names removed by the correlation rule."""

    names: tuple[str, ...]
    kept: tuple[int, ...]

    @property
    def kept_names(self) -> list[str]:
        return [self.names[i] for i in self.kept]

    @property
    def removed_names(self) -> list[str]:
        keep = set(self.kept)
        return [n for i, n in enumerate(self.names) if i not in keep]

    @classmethod
    def fit(
        cls,
        train: DataFrame,
        features: str,
        names: Sequence[str],
        threshold: float = CORRELATION_THRESHOLD,
    ) -> CorrelationPrune:
        """Position j goes if any earlier i < j has |r| above the threshold, even if i goes too.

        Undefined correlations (constant columns) never count.
        """
        dropped = {r["j"] for r in dropped_positions(correlation_pairs(train, features), threshold).collect()}
        return cls(tuple(names), tuple(i for i in range(len(names)) if i not in dropped))

    def transform(self, df: DataFrame, features: str, out: str | None = None) -> DataFrame:
        if len(self.kept) == len(self.names):
            return df if out in (None, features) else df.withColumn(out, F.col(features))
        return df.withColumn(out or features, select_indices(F.col(features), self.kept))


def dropped_positions(pairs: DataFrame, threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """Distinct j over pairs above the threshold; NaN must be excluded, as NaN > x is true."""
    strong = F.col("abs_r").isNotNull() & ~F.isnan("abs_r") & (F.col("abs_r") > threshold)
    return pairs.where(strong).select("j").distinct()


def kept_features(names: DataFrame, dropped: DataFrame, position: str = "pos") -> DataFrame:
    """Name table minus the dropped positions."""
    return names.join(dropped.withColumnRenamed("j", position), position, "left_anti")


def prune_columns(
    df: DataFrame, columns: Sequence[str], threshold: float = CORRELATION_THRESHOLD
) -> DataFrame:
    """(pos, name, kept) for plain columns, without leaving the query plan."""
    dropped = dropped_positions(correlation_columns(df, columns), threshold)
    lost = dropped.agg(F.collect_list("j")).scalar()
    names = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("pos", "name")
    )
    return names.withColumn("_lost", lost).select(
        "pos", "name", (~F.array_contains("_lost", F.col("pos"))).alias("kept")
    )
