"""Shared shapes: the events table as activity rows and its curated form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.bindings import table
from assayloom.operators.curate import curate
from assayloom.operators.stats import weighted_mean
from assayloom.sources.activity import as_activities


def event_activities(spark: SparkSession, folder: str) -> DataFrame:
    """events: target = event_type, entity = event_id, key text = user, value = value."""
    return as_activities(
        table(spark, folder, "events"),
        target=F.col("event_type"),
        entity=F.col("event_id"),
        key=F.col("user_id"),
        value=F.col("value"),
    )


def curated_events(spark: SparkSession, folder: str) -> DataFrame:
    return curate(event_activities(spark, folder), extra=["target_id"])


# The same curated rows in SQL, as a WITH item named `curated`.
CURATED_SQL = """ranked AS (
  SELECT event_type AS target_id, event_id AS entity_id, CAST(user_id AS VARCHAR) AS key_text,
         -log10(value * 1e-9) AS p_value,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rn
  FROM events
  WHERE value > 0 AND value < 1000000 AND -log10(value * 1e-9) BETWEEN 0 AND 15),
curated AS (SELECT target_id, entity_id, key_text, p_value FROM ranked WHERE rn = 1)"""


def event_history(spark: SparkSession, folder: str) -> DataFrame:
    """events as a loss history: run = user, epoch = day, loss weighted by props.k + 1."""
    batches = table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
        .cast("bigint").alias("epoch"),
        "value",
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("weight"),
    )
    history = weighted_mean(batches, "value", "weight", ["run", "epoch"])
    return history.withColumn("loss", F.round("loss", 6))


HISTORY_SQL = """history AS (
  SELECT user_id AS run,
         date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS epoch,
         round(sum(value * (CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1))
               / sum(CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1), 6) AS loss
  FROM events GROUP BY 1, 2)"""


def priced_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with a fixed-rate prediction of the price."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey",
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500.0).alias("predicted"),
    )


def line_key():
    """Unique per order line; order and line number alone are not."""
    parts = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return F.concat_ws("-", *[F.col(c).cast("string") for c in parts])
