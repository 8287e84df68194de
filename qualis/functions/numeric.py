"""Text -> number coercion with a strict grammar.

Spark's own cast accepts forms such as `12d` or `12f`; the grammar below admits
only plain decimal and scientific notation (optionally signed, surrounded by
whitespace) and the words inf / infinity. Anything else becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

_DECIMAL = r"(?U)^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY = r"(?iU)^\s*[+-]?inf(inity)?\s*$"


def to_double(c: Column) -> Column:
    s = c.cast("string")
    t = strip(s)
    inf = F.when(F.startswith(t, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(s.rlike(_DECIMAL), t.try_cast("double")).when(s.rlike(_INFINITY), inf)
