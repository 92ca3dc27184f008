"""One target from activity rows to a saved model and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.text import row_hash
from assayloom.operators.curate import curate
from assayloom.operators.featurise import FeatureSet
from assayloom.operators.lookup import reference_lookup
from assayloom.operators.split import (
    conditional_resample,
    group_split,
    hash_limit,
    three_way_split_exact,
)
from assayloom.plans.scoring import score_texts
from assayloom.plans.training import Trained, param_search, run_report, train_regressor
from assayloom.session import stored
from assayloom.settings import CORRELATION_THRESHOLD, RANDOM_SEED, TARGETS, VALIDATION_FRACTION
from assayloom.sources.activity import activity_scan
from assayloom.sources.models import save_model
from assayloom.sources.output import save_json
from assayloom.sources.stores import featurise_with_store, load_or_refresh


def split_rows(
    rows: DataFrame, method: str, key: str, group: str | None, seed: int = RANDOM_SEED
) -> DataFrame:
    """Random: exact train / val / test. Group: whole groups to test, then val by row hash."""
    if method == "random":
        return three_way_split_exact(rows, key, seed=seed)
    if method != "group" or group is None:
        raise ValueError(f"Unknown split method: {method}")
    validates = row_hash(F.col(key), seed + 1) < F.lit(hash_limit(VALIDATION_FRACTION))
    return group_split(rows, group, seed=seed).withColumn(
        "split", F.when((F.col("split") == "train") & validates, F.lit("val")).otherwise(F.col("split"))
    )


def train_target(
    spark: SparkSession,
    activities: DataFrame,
    target_id: str,
    folder: str,
    features: FeatureSet | None = None,
    split_method: str = "random",
    group: str | None = None,
    kind: str = "linear",
    preset: str = "base",
    n_trials: int = 0,
    resample: bool = False,
    force_refresh: bool = False,
) -> tuple[Trained, DataFrame]:
    """Curate (or reuse), split, featurise through the store, fit or search, save, report.

    ``folder`` is shared storage; it gets ``curated``, ``features``, ``models`` and ``reports``.
    ``group`` names a column of the activities that the curated rows must keep.
    """
    features = features or FeatureSet()
    extra = ["target_id"] if group is None else ["target_id", group]
    curated = load_or_refresh(
        spark, f"{folder}/curated", target_id,
        fetch=lambda t: activity_scan(activities, t, must_exist=True),
        preprocess=lambda rows: curate(rows, extra=extra),
        force_refresh=force_refresh,
    )
    # Split and resampling pass over the narrow rows several times: features come after them.
    rows = split_rows(curated, split_method, "entity_id", group)
    if resample:
        rows, _ = conditional_resample(rows, "p_value", "entity_id")
    rows = stored(
        featurise_with_store(rows, "key_text", "entity_id", f"{folder}/features", features),
        "featurised",
    )
    if n_trials:
        trained, _, _ = param_search(
            rows, "features", "p_value", kind, n_trials, threshold=CORRELATION_THRESHOLD,
            names=features.names,
        )
    else:
        trained = train_regressor(
            rows, "features", "p_value", kind, preset, names=features.names
        )
    trained.metadata["feature_set"] = features.version
    scored = trained.score(rows.where(F.col("features").isNotNull()))
    name = {t: n for t, n, _ in TARGETS}.get(target_id, target_id)
    report = run_report(trained, scored, "p_value", target_id, name, split_method, n_trials)
    label = f"{name}_{target_id}"
    save_json(report, f"{folder}/reports/{label}")
    save_model(spark, trained.pipeline, trained.metadata, f"{folder}/models/{label}")
    return trained, spark.read.schema(report.schema).json(f"{folder}/reports/{label}")


def reference_scores(trained: Trained, targets: DataFrame, features: FeatureSet) -> DataFrame:
    """Scores of the known reference entities of each target: (target_id, name, key_text, ...)."""
    return score_texts(trained, reference_lookup(targets, "target_id"), "key_text", features)
