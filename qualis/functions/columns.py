"""References to columns of any name: dots and backticks are quoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col_ref(name: str) -> Column:
    return F.col(quoted(name))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns c0, c1, ... (so that no name a step adds clashes), and the name each column has there."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
