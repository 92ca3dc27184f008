"""From raw measurement rows to the curated table (entity, key text, derived value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.numeric import coerce_double, neg_log10
from assayloom.settings import DERIVED_BOUNDS, RAW_UPPER_BOUND

REQUIRED = ("entity_id", "key_text", "standard_value")


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED) -> DataFrame:
    """Projection to the required columns; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df.select(*columns)


def require_rows(df: DataFrame, message: str = "no rows left") -> DataFrame:
    """The frame itself, or an error if it is empty. Runs a job that stops at the first row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def coerce_numeric(df: DataFrame, column: str, drop: bool = True) -> DataFrame:
    out = df.withColumn(column, coerce_double(F.col(column)))
    return out.where(F.col(column).isNotNull()) if drop else out


def value_range(
    df: DataFrame, column: str, lower: float | None = 0.0, upper: float | None = RAW_UPPER_BOUND
) -> DataFrame:
    """Open interval; ``None`` leaves a side open."""
    if lower is not None:
        df = df.where(F.col(column) > F.lit(float(lower)))
    if upper is not None:
        df = df.where(F.col(column) < F.lit(float(upper)))
    return df


def with_neg_log(df: DataFrame, column: str, out: str = "p_value") -> DataFrame:
    return df.withColumn(out, neg_log10(F.col(column)))


def derived_range(
    df: DataFrame, column: str = "p_value", bounds: tuple[float, float] = DERIVED_BOUNDS
) -> DataFrame:
    """Closed interval."""
    return df.where(F.col(column).between(F.lit(float(bounds[0])), F.lit(float(bounds[1]))))


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row that comes first in ``order_by`` per key; columns keep their order.

    ``min_by`` combines on the map side, so a key with very many copies sends one row per task
    to the shuffle; a ranking window would gather all copies in one task.
    """
    keys, order_by = list(keys), list(order_by)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first")
    )
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns])


def keep_valid(df: DataFrame, valid: Column | Callable[[Column], Column], key: str) -> DataFrame:
    """Rows whose key text passes the check; a null result counts as invalid."""
    check = valid(F.col(key)) if callable(valid) and not isinstance(valid, Column) else valid
    return df.where(F.coalesce(check, F.lit(False)))


def not_blank(text: Column) -> Column:
    """Default validity of a key text: it holds something besides white space."""
    return text.rlike(r"[^ \t\n\r\f]")


def curate(
    df: DataFrame,
    entity: str = "entity_id",
    key: str = "key_text",
    value: str = "standard_value",
    order_by: Sequence[str] | None = None,
    lower: float | None = 0.0,
    upper: float | None = RAW_UPPER_BOUND,
    bounds: tuple[float, float] | None = DERIVED_BOUNDS,
    dedup: bool = True,
    valid: Callable[[Column], Column] | None = not_blank,
    extra: Sequence[str] = (),
    out: str = "p_value",
) -> DataFrame:
    """Project, drop nulls, coerce, range, transform, range, keep first, keep valid.

    Validity depends on the key text alone, so it is checked before the keep-first step: the
    result is the same and fewer rows are shuffled. ``lower=None, bounds=None, dedup=False,
    valid=None`` gives the older variant without these steps. With ``extra`` columns (a target
    id, say) keep-first works within each combination of them.
    """
    order_by = list(order_by or [entity])
    columns = list(dict.fromkeys([*extra, entity, key, value, *order_by]))
    rows = drop_nulls(require_columns(df, columns))
    rows = value_range(coerce_numeric(rows, value), value, lower, upper)
    rows = with_neg_log(rows, value, out)
    if bounds is not None:
        rows = derived_range(rows, out, bounds)
    if valid is not None:
        rows = keep_valid(rows, valid, key)
    if dedup:
        rows = keep_first(rows, [*extra, key], order_by)
    return rows.select(*extra, entity, key, out)


def stage_audit(
    df: DataFrame,
    entity: str = "entity_id",
    key: str = "key_text",
    value: str = "standard_value",
    lower: float | None = 0.0,
    upper: float | None = RAW_UPPER_BOUND,
    bounds: tuple[float, float] | None = DERIVED_BOUNDS,
) -> DataFrame:
    """Rows kept and removed by each stage, from one pass: (position, stage, kept, removed)."""
    rows = df.select(entity, key, F.col(value).alias("_raw"), coerce_double(F.col(value)).alias("_x"))
    rows = rows.withColumn("_p", neg_log10(F.col("_x")))
    yes = F.lit(True)
    stages = [
        ("input", yes),
        ("not_null", F.col(entity).isNotNull() & F.col(key).isNotNull() & F.col("_raw").isNotNull()),
        ("numeric", F.col("_x").isNotNull()),
        ("above_lower", F.col("_x") > float(lower) if lower is not None else yes),
        ("below_upper", F.col("_x") < float(upper) if upper is not None else yes),
        ("derived_range", F.col("_p").between(*map(float, bounds)) if bounds is not None else yes),
    ]
    passed, checks = yes, []
    for name, check in stages:
        passed = passed & F.coalesce(check, F.lit(False))
        checks.append((name, passed))
    counts = rows.agg(
        *[F.count_if(c).alias(n) for n, c in checks],
        F.count_distinct(F.when(passed, F.col(key))).alias("distinct_key"),
    )
    names = [n for n, _ in checks] + ["distinct_key"]
    return counts.select(
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(n).alias("stage"),
                    F.col(n).alias("kept"),
                    (F.col(names[max(i - 1, 0)]) - F.col(n)).alias("removed"),
                )
                for i, n in enumerate(names)
            ])
        )
    )
