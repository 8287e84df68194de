"""Thresholds, weights and labels.

Everything a detector or the scorer compares against lives here, in one frozen
dataclass, so a run can be reproduced from its config alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Mapping

# --- Fixed values: these must equal the reference's for equal results. ---
# Score weight per issue category (points lost at full effect).
QUALITY_WEIGHTS: Mapping[str, float] = MappingProxyType({
    "missing_values": 25.0,
    "duplicate_rows": 15.0,
    "duplicate_columns": 5.0,
    "outliers": 15.0,
    "wrong_dtypes": 10.0,
    "invalid_values": 15.0,
    "constant_columns": 5.0,
    "high_cardinality": 5.0,
    "encoding_issues": 5.0,
})
DEFAULT_WEIGHT = 5.0
# Score label thresholds, highest first.
QUALITY_LABELS = (
    (90.0, "Excellent"),
    (75.0, "Good"),
    (60.0, "Fair"),
    (40.0, "Needs Cleaning"),
    (0.0, "Poor"),
)
SEVERITY_ORDER = ("HIGH", "MEDIUM", "LOW", "INFO")
# Column-name tokens that mark an identifier (substring match on lower name).
ID_TOKENS_NUMERIC = ("id", "code", "number", "no.")
ID_TOKENS_TEXT = ("id", "uuid", "code")
# Known two-value vocabularies for boolean-like text columns.
BOOLEAN_VOCABULARIES = (
    ("yes", "no"), ("y", "n"), ("true", "false"), ("t", "f"),
    ("0", "1"), ("male", "female"),
)
# Missing-value tokens read as null by the CSV loader (pandas read_csv defaults).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
# CSV fallbacks: separators tried in this order.
CSV_SEPARATORS = (",", ";", "\t", "|")
# Issue kinds: id -> (category, title, alternative methods offered).
ISSUE_KINDS: Mapping[str, tuple[str, str, tuple[str, ...]]] = MappingProxyType({
    "missing_values": ("missing_values", "Missing Values",
                       ("fill_mean", "fill_mode", "forward_fill", "backward_fill", "interpolate",
                        "drop_rows", "drop_columns")),
    "duplicate_rows": ("duplicate_rows", "Duplicate Rows", ("drop_duplicate_rows_keep_last",)),
    "duplicate_columns": ("duplicate_columns", "Duplicate Columns", ()),
    "constant_columns": ("constant_columns", "Constant Columns", ("keep_as_metadata",)),
    "near_constant_columns": ("constant_columns", "Near-Constant Columns", ("drop_columns",)),
    "high_cardinality": ("high_cardinality", "High Cardinality Columns",
                         ("drop_columns", "keep_as_identifier")),
    "whitespace_issues": ("invalid_values", "Whitespace Issues", ("remove_all_whitespace",)),
    "inconsistent_capitalization": ("invalid_values", "Inconsistent Capitalization",
                                    ("lower_case", "upper_case")),
    "mixed_dtypes": ("wrong_dtypes", "Mixed Data Types", ("convert_to_string", "review_manually")),
})
# --- End of fixed values. ---


@dataclass(frozen=True)
class Thresholds:
    missing_high: float = 0.30
    missing_medium: float = 0.05
    dup_rows_high: float = 0.10
    dup_rows_medium: float = 0.02
    dup_cols_medium: float = 0.05
    near_constant_share: float = 0.99
    high_cardinality_ratio: float = 0.90
    high_cardinality_min_rows: int = 10
    mixed_low: float = 0.1
    mixed_high: float = 0.9
    id_unique_ratio: float = 0.9
    date_like_share: float = 0.8
    date_sample_rows: int = 30
    outlier_iqr_multiplier: float = 1.5


@dataclass(frozen=True)
class QualityConfig:
    thresholds: Thresholds = field(default_factory=Thresholds)
    weights: Mapping[str, float] = field(default_factory=lambda: QUALITY_WEIGHTS)
    default_weight: float = DEFAULT_WEIGHT
    # Case and mixed-type checks: None = whole column (order-free), or the
    # first N non-null values by row order (the interactive tool's rule).
    head_rows: int | None = None
    # Rows per block for order-dependent fills (section "blocked fills").
    fill_block_rows: int = 1 << 20


DEFAULT_CONFIG = QualityConfig()
