"""Model directories: a fitted pipeline plus one metadata record."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayloom.functions.text import iso_timestamp
from assayloom.session import remove_others

REQUIRED_KEYS = (
    "version", "pipeline", "x_scaler", "y_scaler", "is_trained", "input_dim", "regressor",
    "model_type", "timestamp",
)
DEFAULTS = {
    "removed_features": [], "feature_names": [], "full_feature_names": [],
    "feature_indices": None, "feature_set": None,
}


@dataclass
class SavedModel:
    pipeline: PipelineModel
    metadata: dict = field(default_factory=dict)


def save_model(spark: SparkSession, model: PipelineModel, metadata: dict, path: str) -> None:
    """Writes the pipeline into a folder of its own first, and the metadata, which names that
    folder, last.

    The metadata is the commit mark: until it is replaced, the earlier save stays readable, and
    a directory without it is an unfinished save. (Renames are not atomic on object stores.)
    Pipelines of earlier saves are left in place for readers that have just read their mark;
    ``vacuum_model`` removes them.
    """
    folder = f"pipeline-{uuid.uuid4().hex}"
    stamp = spark.range(1).select(iso_timestamp(F.current_timestamp())).first()[0]
    record = {"version": 1.0, "pipeline": folder, "is_trained": True, "timestamp": stamp,
              **metadata}
    model.write().save(f"{path}/{folder}")
    text = json.dumps(record, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/metadata"
    )


def load_model(spark: SparkSession, path: str) -> SavedModel:
    """Missing directory: FileNotFoundError. Missing required keys: KeyError."""
    try:
        row = spark.read.option("wholetext", True).text(f"{path}/metadata").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"Model not found: {path}") from error
    metadata = json.loads(row[0])
    missing = [k for k in REQUIRED_KEYS if k not in metadata]
    if missing:
        raise KeyError(f"model metadata lacks {missing}")
    return SavedModel(PipelineModel.load(f"{path}/{metadata['pipeline']}"), {**DEFAULTS, **metadata})


def vacuum_model(spark: SparkSession, path: str) -> int:
    """Removes pipelines that the metadata does not name; the number removed."""
    current = load_model(spark, path).metadata["pipeline"]
    return remove_others(spark, path, "pipeline-", current)
