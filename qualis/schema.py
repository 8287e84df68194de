"""Output schemas fixed for every run."""

from __future__ import annotations

from pyspark.sql import types as T

ISSUE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType(), False),
    T.StructField("issue_id", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("affected_columns", T.ArrayType(T.StringType(), False), False),
    T.StructField("affected_ratio", T.DoubleType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("recommendation", T.StringType(), False),
    T.StructField("recommended_method", T.StringType(), False),
    T.StructField("alternative_methods", T.ArrayType(T.StringType(), False), False),
    T.StructField("per_column_pct", T.MapType(T.StringType(), T.DoubleType(), False), True),
    T.StructField("groups", T.ArrayType(T.ArrayType(T.StringType(), False), False), True),
    T.StructField("duplicate_count", T.LongType(), True),
])

HISTORY_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("columns", T.ArrayType(T.StringType(), False), False),
    T.StructField("rows_before", T.LongType(), True),
    T.StructField("rows_after", T.LongType(), True),
    T.StructField("cols_before", T.IntegerType(), False),
    T.StructField("cols_after", T.IntegerType(), False),
])


def kind_issue(issue_id: str, severity: str, affected_columns: list, affected_ratio: float,
               description: str, recommendation: str, recommended_method: str, **extra) -> dict:
    """An issue of one of the fixed kinds (category, title and alternatives from config)."""
    from .config import ISSUE_KINDS
    category, title, alternatives = ISSUE_KINDS[issue_id]
    return issue(issue_id, category, title, severity, affected_columns, affected_ratio,
                 description, recommendation, recommended_method, list(alternatives), **extra)


def issue(issue_id: str, category: str, title: str, severity: str, affected_columns: list,
          affected_ratio: float, description: str, recommendation: str,
          recommended_method: str, alternative_methods: list, *, per_column_pct=None,
          groups=None, duplicate_count=None) -> dict:
    return {
        "position": 0, "issue_id": issue_id, "category": category, "title": title,
        "severity": severity, "affected_columns": list(affected_columns),
        "affected_ratio": float(affected_ratio), "description": description,
        "recommendation": recommendation, "recommended_method": recommended_method,
        "alternative_methods": list(alternative_methods), "per_column_pct": per_column_pct,
        "groups": groups, "duplicate_count": duplicate_count,
    }
