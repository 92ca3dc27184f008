"""Activity measurements to property models, as Spark DataFrame plans."""

from assayloom.operators.curate import curate, stage_audit
from assayloom.operators.featurise import FeatureSet, assemble_features
from assayloom.operators.split import holdout_exact, kfold, split_data, three_way_split
from assayloom.session import build_session

__all__ = [
    "FeatureSet", "assemble_features", "build_session", "curate", "holdout_exact", "kfold",
    "split_data", "stage_audit", "three_way_split",
]
