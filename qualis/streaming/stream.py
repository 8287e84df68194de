"""The library's row-local steps and metrics on streaming DataFrames.

* `clean_stream` applies cleaning steps that read only the row they change
  (drop rows or columns, text and type conversions); steps that need table
  statistics or row order are refused, since a stream has neither.
* `audit_stream` keeps the value-rule counts of `audit_values` as streaming
  state (complete output mode).
* `missing_by_window` counts missing cells per column in event-time windows,
  with a watermark so old windows are emitted once and their state dropped
  (append output mode): the missing-value map with time blocks instead of row
  blocks. The windows still open when a stream ends come from `open_windows`.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col_ref
from ..functions.missing import is_missing
from ..operators.audit import audit_values
from ..operators.clean import ROW_LOCAL, apply_method


def clean_stream(stream: DataFrame, steps: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    for method, columns in steps:
        if method not in ROW_LOCAL:
            raise ValueError(f"'{method}' needs table statistics or row order; "
                             "it cannot run on a stream")
        stream = apply_method(stream, method, list(columns))
    return stream


def audit_stream(stream: DataFrame, rules: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Running (column, rule, n_non_null, n_valid, n_invalid, invalid_ratio)."""
    return audit_values(stream, rules)


def missing_by_window(stream: DataFrame, time_col: str, window: str = "1 hour",
                      watermark: str = "1 hour", columns: Sequence[str] | None = None) -> DataFrame:
    """window_start, window_end, column, n_rows, n_missing per event-time window."""
    return _window_counts(_with_time(stream, time_col).withWatermark(time_col, watermark), time_col, window, columns)


def open_windows(closed: DataFrame, rows: DataFrame, time_col: str, window: str = "1 hour",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """The windows that an ended stream has not closed: a batch aggregate over the rows (of the stream's source) at or
    after the end of the last window in `closed`, what `missing_by_window` has written. Together they are all windows."""
    last = closed.agg(F.max("window_end")).first()[0]
    rows = _with_time(rows, time_col)
    if last is not None:
        rows = rows.where(col_ref(time_col) >= F.lit(last))
    return _window_counts(rows, time_col, window, columns)


def _with_time(df: DataFrame, time_col: str) -> DataFrame:
    if isinstance(df.schema[time_col].dataType, T.TimestampType):  # watermarks need TIMESTAMP
        return df
    return df.withColumn(time_col, col_ref(time_col).cast("timestamp"))


def _window_counts(df: DataFrame, time_col: str, window: str, columns: Sequence[str] | None) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(columns) if columns is not None else [c for c in df.columns if c != time_col]
    per = (df.groupBy(F.window(col_ref(time_col), window).alias("w"))
           .agg(F.count(F.lit(1)).alias("n"), F.array(*[
               F.struct(F.lit(c).alias("column"), F.count_if(is_missing(c, types[c])).alias("n_missing")) for c in cols]).alias("m")))
    long = per.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.col("n").alias("n_rows"),
                      F.explode("m").alias("m"))
    return long.select("window_start", "window_end", "m.column", "n_rows", "m.n_missing")
