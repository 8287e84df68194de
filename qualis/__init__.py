"""qualis: data profiling, quality checks and cleaning as Spark jobs.

    from qualis import detect_all, quality_score, CleaningPlan
"""

from .config import DEFAULT_CONFIG, QualityConfig, Thresholds
from .operators.audit import audit_values, boolean_like_columns, parse_json_responses
from .operators.clean import apply_method, register_method
from .operators.detect import detect_all, detect_report, register_detector
from .operators.profile import column_classes, column_profile, dataset_meta, profile_samples
from .operators.score import quality_breakdown, quality_score
from .operators.stats import TableStats
from .plans import CleaningPlan, review_progress
from .sources import DataLoadError, load_csv, with_row_id

__all__ = [
    "DEFAULT_CONFIG", "QualityConfig", "Thresholds", "audit_values", "boolean_like_columns",
    "parse_json_responses", "apply_method", "register_method", "detect_all", "detect_report",
    "register_detector", "column_classes", "column_profile", "dataset_meta", "profile_samples",
    "quality_breakdown", "quality_score", "TableStats", "CleaningPlan", "review_progress",
    "DataLoadError", "load_csv", "with_row_id",
]
