"""Batch scoring: featurise, select, scale, predict, restore, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators.featurise import FeatureSet, assemble_features
from assayloom.operators.report import confidence_struct, score_status
from assayloom.operators.scale import StandardScale
from assayloom.plans.training import PREDICTION, RAW_PREDICTION, Trained
from assayloom.sources.models import SavedModel, load_model


def trained_from(saved: SavedModel) -> Trained:
    y = saved.metadata["y_scaler"]
    return Trained(saved.pipeline, StandardScale(y["mean"], y["std"]), saved.metadata)


def batch_score(
    trained: Trained, df: DataFrame, features: str, out: str = PREDICTION
) -> DataFrame:
    """Adds prediction, status and confidence; rows without features fail, they do not stop
    the batch.

    The fitted stages cannot take null vectors, so a null is replaced by zeros of the fitted
    width for the pass through the model and its prediction is removed again: one pass, no union.
    """
    source = trained.pipeline.stages[0].getInputCol()
    width = len(trained.metadata.get("full_feature_names") or []) or None
    if width is None:
        first = df.where(F.col(features).isNotNull()).select(F.size(features)).first()
        width = first[0] if first else trained.metadata["input_dim"]
    element = df.schema[features].dataType.simpleString()
    filler = F.array_repeat(F.lit(0.0), width).cast(element)
    ready = df.select(F.struct("*").alias("_row")).withColumn(
        source, F.coalesce(F.col(f"_row.{features}"), filler)
    )
    scored = trained.pipeline.transform(ready)
    restored = trained.y_scale.restored(F.col(RAW_PREDICTION))
    usable = F.col(f"_row.{features}").isNotNull() & ~F.isnan(restored)
    made = scored.select("_row.*", F.when(usable, restored).alias(out))
    return made.withColumn("status", score_status(F.col(out))).withColumn(
        "confidence", confidence_struct(F.col(out))
    )


def score_texts(
    trained: Trained, df: DataFrame, text: str, features: FeatureSet, out: str = PREDICTION
) -> DataFrame:
    """Batch scoring straight from key texts: (columns of df, prediction, status, confidence)."""
    made = assemble_features(df, text, features, out="_features")
    return batch_score(trained, made, "_features", out).drop("_features")


def score_with_saved(
    spark: SparkSession, path: str, df: DataFrame, features: str, out: str = PREDICTION
) -> DataFrame:
    return batch_score(trained_from(load_model(spark, path)), df, features, out)
