"""Scans of activity rows, text lines and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.text import LINE_BREAK, strip
from assayloom.operators.curate import require_rows

ACTIVITY_SCHEMA = T.StructType([
    T.StructField("target_id", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("key_text", T.StringType()),
    T.StructField("standard_type", T.StringType()),
    T.StructField("standard_units", T.StringType()),
    T.StructField("standard_value", T.StringType()),
])


def read_activities(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
    **options: str,
) -> DataFrame:
    """Landed activity files in any Spark format; text formats get the explicit schema."""
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        reader = reader.schema(schema or ACTIVITY_SCHEMA)
    return reader.load(path)


def activity_scan(
    activities: DataFrame,
    target: object,
    standard_type: object = "IC50",
    units: object = "nM",
    columns: tuple[str, str, str] = ("target_id", "standard_type", "standard_units"),
    must_exist: bool = False,
) -> DataFrame:
    """Rows of one target, type and unit: three equalities that reach the file scan."""
    for column, wanted in zip(columns, (target, standard_type, units), strict=True):
        activities = activities.where(F.col(column) == F.lit(wanted))
    if must_exist:
        require_rows(activities, f"No {standard_type} data found for target {target}")
    return activities


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed row per non-blank line of a text file: (value)."""
    return (
        spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''")
    )


def text_line_scan(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Same for a text column: (keep..., line_no, value); line numbers count blank lines."""
    return (
        df.select(*keep, F.posexplode(F.split(text, LINE_BREAK)).alias("line_no", "value"))
        .withColumn("value", strip(F.col("value")))
        .where("value <> ''")
    )


def list_explode(
    df: DataFrame, items: str, keep: tuple[str, ...] = (), separator: str = ","
) -> DataFrame:
    """One row per trimmed item of a separated list: (keep..., item_no, item)."""
    return df.select(
        *keep, F.posexplode(F.split(items, separator)).alias("item_no", "item")
    ).withColumn("item", strip(F.col("item")))


def as_activities(
    df: DataFrame,
    target: Column,
    entity: Column,
    key: Column,
    value: Column,
    standard_type: Column | None = None,
    units: Column | None = None,
) -> DataFrame:
    """Any table in the shape of an activity table; the value stays text until coerced."""
    return df.select(
        target.cast("string").alias("target_id"),
        entity.alias("entity_id"),
        key.cast("string").alias("key_text"),
        (F.lit("IC50") if standard_type is None else standard_type).alias("standard_type"),
        (F.lit("nM") if units is None else units).alias("standard_units"),
        value.cast("string").alias("standard_value"),
    )
