"""Missing-value expressions: null, and NaN for floating columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .columns import col_ref
from .types import is_floating


def is_missing(name: str, dt: T.DataType) -> Column:
    c = col_ref(name)
    if is_floating(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def normalized(name: str, dt: T.DataType) -> Column:
    """NaN -> null and -0.0 -> 0.0, so equal values compare, hash and print alike."""
    c = col_ref(name)
    if is_floating(dt):
        return F.when(F.isnan(c), F.lit(None).cast(dt)).when(c == 0, F.lit(0).cast(dt)).otherwise(c)
    return c
