"""Deterministic splits and resampling.

Every choice is a function of ``md5(key | seed)``: the same for any partitioning, retry or
engine. The key must be unique per row; copies of one key always land on the same side. Exact
sizes come from a few hash thresholds, so no row is shuffled by any of the splits. Rows with a
null key cannot be drawn: they do not count towards the sizes and stay in ``train`` (fold 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.functions.text import let, row_hash
from assayloom.operators.ordered import hash_thresholds, ks_two_sample, thresholds_by_cut
from assayloom.settings import (
    RANDOM_SEED,
    RESAMPLE_BINS,
    RESAMPLE_P_VALUE,
    TEST_FRACTION,
    VALIDATION_FRACTION,
)


def hash_limit(fraction: float) -> str:
    """First 8 hex digits of the hash below which about ``fraction`` of all rows fall; for 1 a
    limit above every hash."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError(f"a fraction lies between 0 and 1, not {fraction}")
    cells = round(fraction * 16**8)
    return "g" if cells == 16**8 else f"{cells:08x}"


def holdout_hash(
    df: DataFrame, key: str, fraction: float = TEST_FRACTION, seed: int = RANDOM_SEED
) -> DataFrame:
    """Adds ``split``; sizes are approximate, the cost is one projection."""
    is_test = row_hash(F.col(key), seed) < F.lit(hash_limit(fraction))
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def holdout_exact(
    df: DataFrame, key: str, fraction: float = TEST_FRACTION, seed: int = RANDOM_SEED
) -> DataFrame:
    """Adds ``split`` with exactly ceil(fraction * n) test rows."""
    h = row_hash(F.col(key), seed)
    limits = thresholds_by_cut(df.select(h.alias("_h")), "_h", [F.ceil(F.col("n") * fraction)])
    is_test = F.coalesce(h <= F.try_element_at(limits, F.lit(0)), F.lit(False))
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def three_way_split(
    df: DataFrame,
    key: str,
    test: float = TEST_FRACTION,
    validation: float = VALIDATION_FRACTION,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Adds ``split``: a test part, then a validation part of what is left, then train."""
    held_out = row_hash(F.col(key), seed) < F.lit(hash_limit(test))
    validates = row_hash(F.col(key), seed + 1) < F.lit(hash_limit(validation))
    return df.withColumn(
        "split",
        F.when(held_out, F.lit("test")).when(validates, F.lit("val")).otherwise(F.lit("train")),
    )


def three_way_split_exact(
    df: DataFrame,
    key: str,
    test: float = TEST_FRACTION,
    validation: float = VALIDATION_FRACTION,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Same with exact sizes: ceil(test * n), then ceil(validation * rest)."""
    n_test = F.ceil(F.col("n") * test)
    n_val = F.ceil((F.col("n") - n_test) * validation)
    h = row_hash(F.col(key), seed)
    limits = thresholds_by_cut(df.select(h.alias("_h")), "_h", [n_test, n_test + n_val])
    return (
        df.withColumn("_limits", limits)
        .withColumn(
            "split",
            F.when(h <= F.try_element_at("_limits", F.lit(0)), F.lit("test"))
            .when(h <= F.try_element_at("_limits", F.lit(1)), F.lit("val"))
            .otherwise(F.lit("train")),
        )
        .drop("_limits")
    )


def group_split(
    df: DataFrame, group: str, fraction: float = TEST_FRACTION, seed: int = RANDOM_SEED
) -> DataFrame:
    """Adds ``split`` so that no group straddles it; ceil(fraction * groups) groups are test.

    Rows without a group form one group ``invalid``. Membership is a comparison of the group's
    hash with one threshold, so a group of any size needs neither a join nor a shuffle.
    """
    h = row_hash(F.coalesce(F.col(group), F.lit("invalid")), seed)
    groups = df.select(h.alias("_h")).distinct()
    limits = thresholds_by_cut(groups, "_h", [F.ceil(F.col("n") * fraction)])
    is_test = F.coalesce(h <= F.try_element_at(limits, F.lit(0)), F.lit(False))
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def split_data(
    df: DataFrame,
    method: str = "random",
    key: str = "entity_id",
    group: str | None = None,
    fraction: float = TEST_FRACTION,
    seed: int = RANDOM_SEED,
) -> DataFrame:
    """Random or group holdout by name; an unknown method is an error."""
    if method == "random":
        return holdout_exact(df, key, fraction, seed)
    if method == "group":
        if group is None:
            raise ValueError("split method 'group' needs a group column")
        return group_split(df, group, fraction, seed)
    raise ValueError(f"Unknown split method: {method}")


def kfold(df: DataFrame, key: str, k: int = 3, seed: int = RANDOM_SEED) -> DataFrame:
    """Adds ``fold`` 0..k-1; sizes differ by at most one, larger folds first.

    Folds are consecutive stretches of the hash order, so k - 1 thresholds decide them.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    h = row_hash(F.col(key), seed)
    size, extra = F.floor(F.col("n") / k), F.col("n") % k
    cuts = [size * (i + 1) + F.least(F.lit(i + 1), extra) for i in range(k - 1)]
    limits = F.map_values(thresholds_by_cut(df.select(h.alias("_h")), "_h", cuts))
    fold = let(h, lambda v: F.size(F.filter(F.col("_limits"), lambda t: t < v)))
    fold = F.coalesce(F.greatest(fold, F.lit(0)), F.lit(0))
    return (
        df.withColumn("_limits", limits).withColumn("fold", fold.cast("int")).drop("_limits")
    )


def kfold_hash(df: DataFrame, key: str, k: int = 3, seed: int = RANDOM_SEED) -> DataFrame:
    """Adds ``fold`` straight from the hash; fold sizes are approximate."""
    digits = F.substring(row_hash(F.col(key), seed), 1, 8)
    return df.withColumn("fold", (F.conv(digits, 16, 10).cast("bigint") % k).cast("int"))


def equal_width_bin(df: DataFrame, value: str, bins: int = RESAMPLE_BINS) -> DataFrame:
    """Adds ``bin`` 0..bins-1 over [min, max]; right-closed, the minimum is in bin 0."""
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    step = (F.col("_span.hi") - F.col("_span.lo")) / F.lit(bins)
    raw = F.ceil(F.try_divide(F.col(value) - F.col("_span.lo"), step)) - 1
    bounded = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    return (
        df.withColumn("_span", span)
        .withColumn(
            "bin",
            F.when(F.col(value).isNull(), F.lit(None))
            .otherwise(F.coalesce(bounded, F.lit(0)))
            .cast("int"),
        )
        .drop("_span")
    )


def bin_counts(binned: DataFrame, bin_col: str = "bin") -> DataFrame:
    """Rows per non-empty bin, with the smallest count of all bins beside each."""
    counts = binned.where(F.col(bin_col).isNotNull()).groupBy(bin_col).agg(
        F.count("*").alias("n_rows")
    )
    # The window spans one row per bin.
    return counts.withColumn("min_rows", F.min("n_rows").over(Window.partitionBy()))


def merge_small_bins(binned: DataFrame, min_rows: int, bin_col: str = "bin") -> DataFrame:
    """Bins with fewer than ``min_rows`` rows, and those after them, joined to the bins before
    until they hold that many; a small rest joins the last full bin.

    The walk over the bins runs on their counts, one row per bin, as one array.
    """
    counts = binned.where(F.col(bin_col).isNotNull()).groupBy(bin_col).agg(
        F.count("*").alias("n")
    ).agg(F.array_sort(F.collect_list(F.struct(bin_col, "n"))).alias("bins"))
    start = F.struct(
        F.lit(0).cast("int").alias("to"), F.lit(0).cast("bigint").alias("held"),
        F.array().cast("array<struct<bin:int,to:int>>").alias("made"),
    )

    def step(state: Column, one: Column) -> Column:
        opens = state["held"] >= min_rows
        to = F.when(opens, one[bin_col]).otherwise(state["to"])
        return F.struct(
            to.cast("int").alias("to"),
            F.when(opens, one["n"]).otherwise(state["held"] + one["n"]).alias("held"),
            F.concat(state["made"], F.array(F.struct(
                one[bin_col].cast("int").alias("bin"), to.cast("int").alias("to")))).alias("made"),
        )

    walked = counts.select(F.aggregate("bins", start, step).alias("w"))
    before = F.array_max(F.transform(
        F.filter("w.made", lambda x: x["to"] < F.col("w.to")), lambda x: x["to"]))
    last = F.when(F.col("w.held") < min_rows, before)
    mapping = walked.select(F.map_from_entries(F.transform(
        "w.made",
        lambda x: F.struct(
            x["bin"], F.when(x["to"] == F.col("w.to"), F.coalesce(last, x["to"])).otherwise(x["to"])
        ),
    ))).scalar()
    return binned.withColumn("_to", mapping).withColumn(
        bin_col, F.try_element_at("_to", F.col(bin_col))
    ).drop("_to")


def undersample_bins(
    df: DataFrame,
    value: str,
    key: str,
    bins: int = RESAMPLE_BINS,
    seed: int = RANDOM_SEED,
    min_bin_count: int = 0,
) -> DataFrame:
    """Every non-empty bin cut to the size of the smallest one, without replacement.

    ``min_bin_count`` first merges bins with fewer rows than that into their neighbours. Rows
    without a value are in no bin and are left out. The rows kept are those with the smallest hashes in their bin. The limit of each bin is
    looked up in a map with one entry per bin; no bin is ever gathered in one task.
    """
    binned = equal_width_bin(df, value, bins).where(F.col("bin").isNotNull())
    if min_bin_count:
        binned = merge_small_bins(binned, min_bin_count)
    hashed = binned.withColumn("_h", row_hash(F.col(key), seed))
    wanted = bin_counts(binned).select(
        "bin", F.lit(0).alias("cut"), F.col("min_rows").alias("position")
    )
    limits = hash_thresholds(hashed.select("bin", "_h"), "_h", wanted, by=["bin"])
    lookup = limits.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "threshold")))
    ).scalar()
    return (
        hashed.withColumn("_limits", lookup)
        .where(F.col("_h") <= F.try_element_at("_limits", F.col("bin")))
        .drop("_h", "_limits")
    )


def union_samples(*samples: DataFrame) -> DataFrame:
    """Samples of separate bins put together by column name."""
    out = samples[0]
    for sample in samples[1:]:
        out = out.unionByName(sample)
    return out


def conditional_resample(
    df: DataFrame,
    value: str,
    key: str,
    split_col: str = "split",
    p_limit: float = RESAMPLE_P_VALUE,
    bins: int = RESAMPLE_BINS,
    seed: int = RANDOM_SEED,
) -> tuple[DataFrame, dict]:
    """Undersamples the train rows if train and test values differ by the KS test.

    Only the one-row test result reaches the driver. Test rows, and train rows without a value,
    are returned unchanged.
    """
    report = ks_two_sample(df, value, split_col, ("train", "test")).first().asDict()
    report["resampled"] = report["p_value"] is not None and report["p_value"] < p_limit
    if not report["resampled"]:
        return df, report
    drawn = F.col(split_col).eqNullSafe("train") & F.col(value).isNotNull()
    # The caller's columns travel as one, so a column named like one of the sampler's survives.
    whole = df.where(drawn).select(
        F.col(value).alias("_value"), F.col(key).alias("_key"), F.struct("*").alias("_row"))
    train = undersample_bins(whole, "_value", "_key", bins, seed).select("_row.*")
    return train.unionByName(df.where(~drawn)), report


def split_check(df: DataFrame, key: str, split_col: str = "split") -> DataFrame:
    """One row: rows in all, rows with a split, keys found in more than one split."""
    per_key = df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count(split_col).alias("placed"),
        F.count_distinct(split_col).alias("splits"),
    )
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.sum("placed").alias("n_placed"),
        F.count_if(F.col("splits") > 1).alias("n_straddling"),
    )
