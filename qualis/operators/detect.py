"""Issue detectors.

Each detector reads the shared `TableStats` (whose metrics come from whole-table
Spark aggregates) and returns issue records. `detect_all` runs them in a fixed
order, isolates failures, sorts by severity and returns an `issues` DataFrame.
"""

from __future__ import annotations

import logging
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT_CONFIG, SEVERITY_ORDER, QualityConfig
from ..functions.columns import quoted
from ..functions.missing import is_missing
from ..functions.types import is_atomic, is_numeric_like, is_string
from ..schema import ISSUE_SCHEMA, kind_issue
from .stats import TableStats

log = logging.getLogger(__name__)

Detector = Callable[[TableStats], list]


def detect_missing_values(st: TableStats) -> list:
    n, t = st.n_rows, st.cfg.thresholds
    if n == 0:
        return []
    hit = {c: st.n_missing(c) for c in st.all_columns if st.n_missing(c) > 0}
    if not hit:
        return []
    ratio = sum(hit.values()) / (n * st.n_cols)
    worst = max(hit.values()) / n
    severity = "HIGH" if worst >= t.missing_high else "MEDIUM" if worst >= t.missing_medium else "LOW"
    types = [st.types[c] for c in hit]
    method = ("fill_median" if any(map(is_numeric_like, types)) else
              "fill_mode" if any(map(is_atomic, types)) else "review_manually")
    return [kind_issue(
        "missing_values", severity, list(hit), ratio,
        f"{len(hit)} column(s) have missing values; the worst is {worst * 100:.1f}% empty.",
        "Fill numbers with the median and text with the most frequent value.",
        method, per_column_pct={c: round(m / n * 100, 2) for c, m in hit.items()},
    )]


def detect_duplicate_rows(st: TableStats) -> list:
    n, t = st.n_rows, st.cfg.thresholds
    if n == 0:
        return []
    dup = st.n_duplicate_rows
    if dup == 0:
        return []
    ratio = dup / n
    severity = "HIGH" if ratio > t.dup_rows_high else "MEDIUM" if ratio > t.dup_rows_medium else "LOW"
    return [kind_issue(
        "duplicate_rows", severity, [], ratio,
        f"{dup} row(s) repeat an earlier row exactly ({ratio * 100:.1f}% of the table).",
        "Remove repeated rows and keep the first of each.",
        "drop_duplicate_rows", duplicate_count=dup,
    )]


def detect_duplicate_columns(st: TableStats) -> list:
    groups = st.duplicate_column_groups
    if not groups:
        return []
    redundant = [c for g in groups for c in g[1:]]
    ratio = len(redundant) / max(st.n_cols, 1)
    return [kind_issue(
        "duplicate_columns", "MEDIUM" if ratio > st.cfg.thresholds.dup_cols_medium else "LOW",
        redundant, ratio,
        f"{len(groups)} group(s) of identical columns: "
        + "; ".join(" = ".join(g) for g in groups) + ".",
        "Drop the copies and keep one column of each group.",
        "drop_duplicate_columns", groups=groups,
    )]


def detect_constant_columns(st: TableStats) -> list:
    if st.n_rows == 0:
        return []
    constant, near = [], []
    for c in st.columns:
        n_unique, max_cnt = st.unique_stats(c)
        if n_unique <= 1:
            constant.append(c)
        elif max_cnt / st.column(c).non_null >= st.cfg.thresholds.near_constant_share:
            near.append(c)
    out = []
    if constant:
        out.append(kind_issue(
            "constant_columns", "LOW", constant, len(constant) / st.n_cols,
            f"{len(constant)} column(s) hold a single value or none: {', '.join(constant)}.",
            "Drop these columns; they carry no information.", "drop_columns"))
    if near:
        out.append(kind_issue(
            "near_constant_columns", "LOW", near, len(near) / st.n_cols,
            f"{len(near)} column(s) have one value in 99% or more of the non-empty rows: "
            f"{', '.join(near)}.",
            "Review: drop, or keep if the rare value matters.", "review_manually"))
    return out


def detect_high_cardinality(st: TableStats) -> list:
    t = st.cfg.thresholds
    if st.n_rows < t.high_cardinality_min_rows:
        return []
    hit = [c for c in st.columns if not is_numeric_like(st.types[c])
           and st.unique_stats(c)[0] / st.n_rows >= t.high_cardinality_ratio]
    if not hit:
        return []
    return [kind_issue(
        "high_cardinality", "LOW", hit, len(hit) / st.n_cols,
        f"{len(hit)} non-numeric column(s) have nearly one distinct value per row: "
        f"{', '.join(hit)}.",
        "Do not one-hot encode; use frequency encoding or treat as an identifier.",
        "frequency_encoding")]


def _text_columns(st: TableStats) -> list[str]:
    return [c for c in st.columns if is_string(st.types[c])]


def detect_whitespace_issues(st: TableStats) -> list:
    hit = [c for c in _text_columns(st) if st.column(c).ws_issue]
    if not hit:
        return []
    return [kind_issue(
        "whitespace_issues", "LOW", hit, len(hit) / max(st.n_cols, 1),
        f"{len(hit)} text column(s) have leading, trailing or repeated whitespace: "
        f"{', '.join(hit)}.",
        "Trim the ends and collapse repeated inner whitespace.", "trim_spaces")]


def detect_inconsistent_capitalization(st: TableStats) -> list:
    hit = [c for c in _text_columns(st) if st.case_mixed(c)]
    if not hit:
        return []
    return [kind_issue(
        "inconsistent_capitalization", "LOW", hit, len(hit) / max(st.n_cols, 1),
        f"{len(hit)} column(s) spell the same value with different case: {', '.join(hit)}.",
        "Standardise the case (title, lower or upper).", "title_case")]


def detect_mixed_dtypes(st: TableStats) -> list:
    t = st.cfg.thresholds
    hit = []
    for c in _text_columns(st):
        share = st.numeric_share(c)
        if share is not None and t.mixed_low < share < t.mixed_high:
            hit.append(c)
    if not hit:
        return []
    return [kind_issue(
        "mixed_dtypes", "MEDIUM", hit, len(hit) / max(st.n_cols, 1),
        f"{len(hit)} text column(s) mix numbers with words: {', '.join(hit)}.",
        "Convert to numbers; entries that are not numbers become missing.", "convert_to_numeric")]


DETECTORS: list[Detector] = [
    detect_missing_values,
    detect_duplicate_rows,
    detect_duplicate_columns,
    detect_constant_columns,
    detect_high_cardinality,
    detect_whitespace_issues,
    detect_inconsistent_capitalization,
    detect_mixed_dtypes,
]


def register_detector(fn: Detector) -> Detector:
    """Add a detector (TableStats -> list of issue records) after the built-in ones."""
    DETECTORS.append(fn)
    return fn


def run_detectors(st: TableStats, detectors: Sequence[Detector] | None = None) -> list:
    found = []
    for d in detectors or DETECTORS:
        try:
            found.extend(d(st))
        except Exception as exc:  # a failing detector is logged and skipped
            log.warning("detector %s failed: %s", d.__name__, exc)
            st.failed.append(d.__name__)
    rank = {s: i for i, s in enumerate(SEVERITY_ORDER)}
    found.sort(key=lambda r: rank.get(r["severity"], len(rank)))  # stable
    for i, r in enumerate(found):
        r["position"] = i
    return found


class DetectorsFailed(RuntimeError):
    """Names of the detectors that failed; see the log for the reasons."""

    def __init__(self, names: Sequence[str]):
        super().__init__("detectors failed: " + ", ".join(names))
        self.names = list(names)


def issues_frame(spark: SparkSession, records: list) -> DataFrame:
    return spark.createDataFrame(records, ISSUE_SCHEMA)


def detect_all(df: DataFrame, exclude: Sequence[str] = (), order_by: str | None = None,
               cfg: QualityConfig = DEFAULT_CONFIG, stats: TableStats | None = None) -> DataFrame:
    """All issues of `df`, sorted HIGH, MEDIUM, LOW, INFO (stable). Raises DetectorsFailed
    if a detector fails, as a score over the others would be too good; `detect_report`
    gives the others' issues and the failed names."""
    st = stats or TableStats(df, exclude=exclude, order_by=order_by, cfg=cfg).prefetch()
    found = run_detectors(st)
    if st.failed:
        raise DetectorsFailed(st.failed)
    return issues_frame(df.sparkSession, found)


def detect_report(df: DataFrame, exclude: Sequence[str] = (), order_by: str | None = None,
                  cfg: QualityConfig = DEFAULT_CONFIG) -> tuple[DataFrame, list[str]]:
    """(issues, names of detectors that failed and were skipped)."""
    st = TableStats(df, exclude=exclude, order_by=order_by, cfg=cfg).prefetch()
    return issues_frame(df.sparkSession, run_detectors(st)), list(st.failed)


def detect_one(df: DataFrame, detector: Detector, exclude: Sequence[str] = (),
               order_by: str | None = None, cfg: QualityConfig = DEFAULT_CONFIG) -> DataFrame:
    st = TableStats(df, exclude=exclude, order_by=order_by, cfg=cfg)
    found = run_detectors(st, [detector])
    if st.failed:
        raise DetectorsFailed(st.failed)
    return issues_frame(df.sparkSession, found)


def missing_by_column(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """column, n_missing, missing_pct for every column: one aggregate, unpivoted."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in df.columns if c not in set(exclude)]
    one = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.struct(F.lit(c).alias("column"), F.count_if(is_missing(c, types[c])).alias("n_missing")) for c in cols]).alias("m"))
    return (one.select("n", F.explode("m").alias("m"))
            .select("m.column", "m.n_missing",
                    F.round(F.col("m.n_missing") / F.greatest(F.col("n"), F.lit(1)) * 100, 2)
                    .alias("missing_pct")))
