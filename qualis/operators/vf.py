"""The value-frequency table (VF): one row per (column, distinct non-null value).

Columns are grouped by their exact type; each group is unpivoted to
(column, value) in its native type and aggregated, and only the resulting
distinct values are turned into text. So a branch reads only its own columns,
grouping compares native values, and the costly number-to-text cast runs once
per distinct value instead of once per cell.

The aggregation is partial on the map side, so a value that fills a third of the
table leaves each map task as a single row; the shuffle carries distinct values
only. Profile and detector figures derive from this table instead of one
`count(distinct)` per column, which Spark would plan as an Expand that copies
every row once per distinct aggregate.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import col_ref, quoted
from ..functions.missing import normalized


def column_families(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns by type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fam: dict[str, list[str]] = {}
    for c in columns:
        fam.setdefault(types[c].simpleString(), []).append(c)
    return fam


def stacked_values(df: DataFrame, columns: Sequence[str], order_by: str | None = None,
                   keep_nulls: bool = False, as_text: bool = True) -> DataFrame:
    """(column, value[, _o]) rows, one per cell of the chosen columns; value as text
    (all columns), or native when `as_text` is False (columns of one type only)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    ids = [col_ref(order_by).alias("_o")] if order_by else []
    vals = [normalized(c, types[c]) for c in columns]
    if as_text:
        vals = [v.cast("string") for v in vals]
    wide = df.select(*ids, *[v.alias(c) for v, c in zip(vals, columns)])
    long = wide.unpivot(["_o"] if order_by else [], [quoted(c) for c in columns], "column", "value")
    return long if keep_nulls else long.where(F.col("value").isNotNull())


def value_frequencies(df: DataFrame, columns: Sequence[str], order_by: str | None = None
                      ) -> DataFrame:
    """column STRING, value STRING, cnt BIGINT[, first_o]: distinct non-null values."""
    parts = []
    for cols in column_families(df, columns).values():
        long = stacked_values(df, cols, order_by, as_text=False)
        aggs = [F.count(F.lit(1)).alias("cnt")]
        if order_by:
            aggs.append(F.min("_o").alias("first_o"))
        grouped = long.groupBy("column", "value").agg(*aggs)
        parts.append(grouped.select("column", F.col("value").cast("string").alias("value"),
                                    *[a for a in ("cnt", "first_o") if a in grouped.columns]))
    if not parts:
        schema = "column string, value string, cnt bigint" + (", first_o bigint" if order_by else "")
        return df.sparkSession.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b), parts)


def case_collisions(values: DataFrame) -> DataFrame:
    """column, mixed: does a text column hold two stripped values equal up to case?

    Over distinct values: one group per (column, lower-cased stripped value); a
    group whose smallest and largest original differ holds two spellings. No
    distinct aggregates, no collect_set.
    """
    from ..functions.text import strip
    s = strip(F.col("value"))
    return (values.select("column", s.alias("s")).where(F.col("s") != "")
            .groupBy("column", F.lower("s").alias("l"))
            .agg((F.min("s") != F.max("s")).alias("mixed"))
            .groupBy("column").agg(F.bool_or("mixed").alias("mixed")))


def column_value_summary(df: DataFrame, columns: Sequence[str], case_of_text: bool = False
                         ) -> DataFrame:
    """column, n_unique, max_cnt, n_non_null[, mixed] from the VF, grouped on native
    values. With `case_of_text`, text columns also get the case-collision flag,
    computed from the same grouped values (the plan shares the shuffle)."""
    from ..functions.text import strip
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for cols in column_families(df, columns).values():
        long = stacked_values(df, cols, as_text=False)
        grouped = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
        if case_of_text and isinstance(types[cols[0]], T.StringType):
            # one more grouping of the distinct values, by lower-cased stripped
            # text: it yields the counts and the case flag together (a blank
            # value strips to '' and never flags)
            st = strip(F.col("value"))
            by_lower = grouped.groupBy("column", F.lower(st).alias("_l")).agg(
                F.count(F.lit(1)).alias("_n"), F.max("cnt").alias("_m"), F.sum("cnt").alias("_s"),
                (F.min(st) != F.max(st)).alias("_x"))
            summary = by_lower.groupBy("column").agg(
                F.sum("_n").alias("n_unique"), F.max("_m").alias("max_cnt"),
                F.sum("_s").alias("n_non_null"), F.bool_or("_x").alias("mixed"))
        else:
            summary = grouped.groupBy("column").agg(
                F.count(F.lit(1)).alias("n_unique"), F.max("cnt").alias("max_cnt"),
                F.sum("cnt").alias("n_non_null"))
            if case_of_text:
                summary = summary.withColumn("mixed", F.lit(None).cast("boolean"))
        parts.append(summary)
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "column string, n_unique bigint, max_cnt bigint, n_non_null bigint"
            + (", mixed boolean" if case_of_text else ""))
    return reduce(lambda a, b: a.unionByName(b), parts)


def long_text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_unique, max_cnt, n_non_null, mixed for long text columns, without
    shuffling every text.

    A value is identified by two 64-bit hashes (128 bits), its stripped lower-cased
    form likewise, so no text is shuffled and copies collapse map-side.
    """
    from ..functions.text import strip
    st = strip(F.col("value"))
    keyed = stacked_values(df, columns, as_text=False).select(
        "column", F.xxhash64("value").alias("_h"), F.xxhash64(F.lit(7), "value").alias("_h2"),
        F.xxhash64(F.lower(st)).alias("_l"), F.xxhash64(F.lit(7), F.lower(st)).alias("_l2"),
        F.xxhash64(st).alias("_s"), (st == "").alias("_blank"))
    grouped = keyed.groupBy("column", "_h", "_h2").agg(
        F.count(F.lit(1)).alias("cnt"), *[F.first(c).alias(c) for c in ("_l", "_l2", "_s", "_blank")])
    by_lower = grouped.groupBy("column", "_l", "_l2").agg(
        F.count(F.lit(1)).alias("_n"), F.max("cnt").alias("_m"), F.sum("cnt").alias("_c"),
        (~F.first("_blank") & (F.min("_s") != F.max("_s"))).alias("_x"))
    found = by_lower.groupBy("column").agg(
        F.sum("_n").alias("n_unique"), F.max("_m").alias("max_cnt"), F.sum("_c").alias("n_non_null"),
        F.bool_or("_x").alias("mixed"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").select(
        "column", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "max_cnt",
        F.coalesce("n_non_null", F.lit(0)).alias("n_non_null"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
