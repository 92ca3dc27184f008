"""Joins: dimensions with defaults, keyed stores, alignment, groups and members.

Broadcast hints are given only for tables whose size is fixed in code. For every other small
side the choice is left to Spark, which broadcasts below ``spark.sql.autoBroadcastJoinThreshold``
and otherwise shuffles (AQE then splits skewed partitions). ``spread_join`` handles joins
whose left side may repeat one key very often.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.text import content_key, pattern_flag
from assayloom.session import constant_table
from assayloom.settings import LINEAR_COEFFICIENTS, REFERENCE_ENTITIES, TARGETS

HOT_SHARE = 0.005  # at most 1 / HOT_SHARE = 200 keys can be hot
ROWS_PER_PIECE = 1_000_000


def _fixed(spark: SparkSession, rows: list[tuple], names: str, numbers: bool = False) -> DataFrame:
    columns = names.split()
    types = ["string", *(["double" if numbers else "string"] * (len(columns) - 1))]
    return constant_table(
        spark, {n: (t, [r[i] for r in rows]) for i, (n, t) in enumerate(zip(columns, types))}
    )


def target_table(spark: SparkSession) -> DataFrame:
    return _fixed(spark, TARGETS, "target_id name description")


def reference_table(spark: SparkSession) -> DataFrame:
    return _fixed(spark, REFERENCE_ENTITIES, "target_id name key_text")


def coefficient_table(spark: SparkSession) -> DataFrame:
    """Per-target coefficients; the row with a null target is the fallback."""
    names = "target logp donors acceptors tpsa weight bias"
    return _fixed(spark, LINEAR_COEFFICIENTS, names, numbers=True)


def dim_join_default(
    fact: DataFrame,
    dim: DataFrame,
    on: tuple[str, str],
    outputs: dict[str, tuple[str, Column]],
    fixed_size: bool = False,
) -> DataFrame:
    """Left join on a dimension; ``outputs`` maps new column -> (dimension column, default).

    The dimension has one row per key. ``fixed_size`` states that it is a constant table.
    """
    fact_key, dim_key = on
    side = dim.select(
        F.col(dim_key).alias("_key"), *[F.col(c).alias(f"_d_{o}") for o, (c, _) in outputs.items()]
    )
    if fixed_size:
        side = F.broadcast(side)
    joined = fact.join(side, F.col(fact_key) == F.col("_key"), "left")
    return joined.select(
        *fact.columns,
        *[F.coalesce(F.col(f"_d_{o}"), d).alias(o) for o, (_, d) in outputs.items()],
    )


def target_lookup(fact: DataFrame, target: str, targets: DataFrame | None = None) -> DataFrame:
    """Adds ``target_name`` and ``target_description``; an unknown id stands for itself."""
    fixed = targets is None
    dim = target_table(fact.sparkSession) if fixed else targets
    own = F.col(target).cast("string")
    return dim_join_default(
        fact,
        dim,
        (target, "target_id"),
        {"target_name": ("name", own), "target_description": ("description", own)},
        fixed_size=fixed,
    )


def reference_lookup(
    targets: DataFrame, target: str, references: DataFrame | None = None
) -> DataFrame:
    """Reference entities of each target; a target without any gives no rows."""
    if references is None:
        references = F.broadcast(reference_table(targets.sparkSession))
    return targets.join(references.withColumnRenamed("target_id", target), target, "inner")


def linear_score(
    df: DataFrame, target: str, terms: dict[str, str], coefficients: DataFrame | None = None,
    out: str = "predicted",
) -> DataFrame:
    """Bias plus the sum of coefficient * term, by target name in any case.

    ``terms`` maps coefficient column -> data column. Unknown targets use the fallback row.
    A null term gives a null score.
    """
    if coefficients is None:
        coefficients = coefficient_table(df.sparkSession)
    names = [*terms, "bias"]
    known = coefficients.where(F.col("target").isNotNull()).select(
        F.lower("target").alias("_target"), *[F.col(n).alias(f"_c_{n}") for n in names]
    )
    fallback = coefficients.where(F.col("target").isNull()).select(F.struct(*names)).scalar()
    scored = (
        df.join(known, F.lower(F.col(target)) == F.col("_target"), "left")
        .withColumn("_fallback", fallback)
    )

    def coefficient(n: str) -> Column:
        return F.coalesce(F.col(f"_c_{n}"), F.col(f"_fallback.{n}"))

    score = coefficient("bias")
    for name, column in terms.items():
        score = score + coefficient(name) * F.col(column)
    return scored.select(*df.columns, score.alias(out))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    spread_by: Sequence[str] = (),
    hot_share: float = HOT_SHARE,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Equi-join that spreads hot left keys over several tasks; ``right`` is unique by key.

    A key is hot if it holds more than ``hot_share`` of the left rows, so there are fewer than
    1 / hot_share of them. Left rows with a hot key get a piece number from ``spread_by``
    (columns that differ within a key); there are as many pieces as the key has rows over
    ``rows_per_piece``, and the right rows of hot keys are repeated once per piece. Keys that are
    not hot are left to AQE.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = (
        counts.where(F.col(key).isNotNull() & (F.col("_n") > total * F.lit(hot_share)))
        .agg(F.map_from_entries(F.collect_list(F.struct(
            key, F.ceil(F.col("_n") / F.lit(rows_per_piece)).cast("int").alias("pieces")))))
        .scalar()
    )
    pieces = F.coalesce(F.try_element_at("_hot", F.col(key)), F.lit(1))
    piece = F.pmod(F.xxhash64(*(spread_by or left.columns)), pieces).cast("int")
    lhs = left.withColumn("_hot", hot).withColumn("_piece", piece)
    rhs = right.withColumn("_hot", hot).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), pieces - 1))
    )
    return lhs.drop("_hot").join(rhs.drop("_hot"), [key, "_piece"], how).drop("_piece")


def uncached_keys(
    df: DataFrame, text: str, store: DataFrame, key: str = "key", version: str | None = None
) -> DataFrame:
    """One (key, text) row per distinct text whose key the store does not hold yet.

    Copies of a text merge on the map side before anything is joined.
    """
    wanted = df.where(F.col(text).isNotNull()).select(
        content_key(F.col(text), version).alias(key), F.col(text)
    )
    distinct = wanted.groupBy(key).agg(F.any_value(text).alias(text))
    return distinct.join(store.select(key), key, "left_anti")


def cached_lookup(
    df: DataFrame,
    text: str,
    store: DataFrame,
    spread_by: Sequence[str],
    key: str = "key",
    version: str | None = None,
    keys_only: bool = False,
) -> DataFrame:
    """Rows with what the store holds for their text; a miss gives null.

    ``keys_only`` keeps the rows that have a hit and adds no columns of the store.
    """
    keyed = df.withColumn(key, content_key(F.col(text), version))
    if keys_only:
        return spread_join(keyed, store.select(key), key, "left_semi", spread_by)
    return spread_join(keyed, store, key, "left", spread_by)


def align_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Feature rows with their labels; rows without a partner on either side drop out."""
    return features.join(labels, key, "inner")


def group_members(
    groups: DataFrame, members: DataFrame, key: str, spread_by: Sequence[str]
) -> DataFrame:
    """All members of the given groups (one row per group), large groups spread over tasks."""
    return spread_join(members, groups, key, "inner", spread_by)


def pattern_cross(
    df: DataFrame, text: str, patterns: Sequence[tuple[str, str | None]], keep: Sequence[str]
) -> DataFrame:
    """One row per input row and pattern of a fixed catalogue: (keep..., pattern, flag).

    The catalogue sits in the projection, so this is a row expansion without any join.
    """
    return df.select(
        *keep,
        F.inline(
            F.array(*[
                F.struct(F.lit(n).alias("pattern"), pattern_flag(F.col(text), p).alias("flag"))
                for n, p in patterns
            ])
        ),
    )
