"""Case-level features from timestamped event records, as Spark plans."""

from .config import (
    CheckPeriod,
    Compress,
    Feature,
    Filter,
    GrainColumn,
    GrainTable,
    RecordSource,
    Step,
    Tokens,
)
from .plans.features import build_feature, build_features

__all__ = [
    "CheckPeriod",
    "Compress",
    "Feature",
    "Filter",
    "GrainColumn",
    "GrainTable",
    "RecordSource",
    "Step",
    "Tokens",
    "build_feature",
    "build_features",
]
