"""Prediction and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_SCHEMA = "key_text string, predicted double, status string"


def save_predictions(predictions: DataFrame, path: str) -> None:
    """CSV with a header; separators, quotes and line breaks in the key text are quoted."""
    (
        predictions.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_predictions(
    spark: SparkSession, path: str, schema: str = PREDICTION_SCHEMA, multi_line: bool = True
) -> DataFrame:
    """``multi_line=False`` keeps large files splittable if key texts hold no line breaks."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def save_json(report: DataFrame, path: str) -> None:
    """Nested rows (best parameters, run reports) as JSON lines; null fields are kept."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_json(df: DataFrame, keep: tuple[str, ...] = (), out: str = "json") -> DataFrame:
    """One JSON text per row from all columns that are not kept beside it."""
    fields = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*fields)).alias(out))
