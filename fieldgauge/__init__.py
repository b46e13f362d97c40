"""fieldgauge: Spark-native scoring and analysis of structured document extractions."""
from .frame import EvalFrame
from .schema import ScoringConfig, schema_leaves

__all__ = ["EvalFrame", "ScoringConfig", "schema_leaves"]
