"""Cleaning methods: `(df, columns, order_by=None) -> DataFrame`, never in place.

Row-local methods are column expressions. Fill statistics (median, mean, mode)
are computed by a Spark job when the step is built and then embedded as
literals, as an estimator's `fit` does; the step is then a plain projection and
replays identically. Frequency encoding joins a per-value count table back, with
a broadcast only when the number of distinct values is known to be small.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.columns import col_ref, numbered
from ..functions.missing import is_missing, normalized
from ..functions.numeric import to_double
from ..functions.types import is_atomic, is_floating, is_number, is_string
from . import fill as _fill
from .parallel import map_jobs
from .quantile import quantiles
from .stats import comparable
from .vf import column_families, stacked_values

# distinct values up to which a per-value table is broadcast (estimated with
# HyperLogLog, so the bound has a wide margin); its rows have fixed-width keys, so
# this bounds its bytes too
BROADCAST_DISTINCT = 1_000_000


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col_ref(c) for c in df.columns])


def _fill_with(df: DataFrame, values: dict[str, object], as_double: bool) -> DataFrame:
    types = _types(df)
    new = {}
    for c, v in values.items():
        cur = normalized(c, types[c])
        if as_double:
            cur = cur.cast("double")
        new[c] = F.coalesce(cur, F.lit(v).cast("double" if as_double else types[c])) if v is not None else cur
    return _replace(df, new)


def fill_median(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    """Nulls (and NaN) of numeric columns take the exact median; result is double."""
    types = _types(df)
    cols = [c for c in columns if is_number(types[c])]
    return _fill_with(df, _medians(df, cols), as_double=True)


def _medians(df: DataFrame, cols: Sequence[str]) -> dict:
    return {c: v[0] for c, v in quantiles(df, cols, [0.5]).items()}


def _modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value of each column; ties go to the smallest value. Columns of one type are counted
    together, in one value-frequency table."""
    cols = [c for c in dict.fromkeys(cols) if is_atomic(df.schema[c].dataType)]

    def of_type(own: list[str]) -> dict:
        counts = stacked_values(df, own, as_text=False).groupBy("column", "value").agg(F.count("*").alias("n"))
        best = F.min_by("value", F.struct((-F.col("n")).alias("n"), "value"))
        found = {r["column"]: r["m"] for r in counts.groupBy("column").agg(best.alias("m")).collect()}
        return {c: found.get(c) for c in own}
    families = column_families(df, cols).values()
    return {c: v for part in map_jobs(of_type, families) for c, v in part.items()}


def fill_mean(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    types = _types(df)
    return _fill_with(df, _means(df, [c for c in columns if is_number(types[c])]), as_double=True)


def _means(df: DataFrame, cols: Sequence[str]) -> dict:
    if not cols:
        return {}
    types = _types(df)
    row = df.agg(*[F.avg(normalized(c, types[c])).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"a{i}"] for i, c in enumerate(cols)}


def fill_mode(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    """Any atomic type; an all-null column and nested columns stay as they are."""
    return _fill_with(df, _modes(df, list(columns)), as_double=False)


def forward_fill(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    return _fill.forward_fill(df, columns, _need_order(order_by))


def backward_fill(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    return _fill.backward_fill(df, columns, _need_order(order_by))


def interpolate(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    return _fill.interpolate(df, columns, _need_order(order_by))


def _need_order(order_by):
    if not order_by:
        raise ValueError("this method depends on row order: pass order_by")
    return order_by


def drop_rows(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    """Drop rows with a null (or NaN) in any of the columns."""
    types = _types(df)
    for c in columns:
        df = df.where(~is_missing(c, types[c]))
    return df


def drop_columns(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    return df.drop(*[c for c in columns if c in df.columns])


def drop_duplicate_rows(df: DataFrame, columns: Sequence[str] = (), order_by=None) -> DataFrame:
    return _fill.drop_duplicate_rows(df, order_by, keep="first")


def drop_duplicate_rows_keep_last(df: DataFrame, columns: Sequence[str] = (), order_by=None
                                  ) -> DataFrame:
    return _fill.drop_duplicate_rows(df, order_by, keep="last")


def drop_duplicate_columns(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    """`columns` is the list of redundant copies found by the detector."""
    return drop_columns(df, columns)


def _text_step(fn: Callable[[Column], Column]):
    def step(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
        types = _types(df)
        new = {}
        for c in columns:
            s = col_ref(c) if is_string(types[c]) else normalized(c, types[c]).cast("string")
            new[c] = F.when(s.isNull(), F.lit(None).cast("string")).otherwise(fn(s))
        return _replace(df, new)
    step.__doc__ = fn.__doc__
    return step


trim_spaces = _text_step(tx.trim_spaces)
lower_case = _text_step(F.lower)
upper_case = _text_step(F.upper)
title_case = _text_step(tx.title_case)
remove_all_whitespace = _text_step(tx.remove_all_whitespace)


def convert_to_numeric(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    """Text that reads as a number becomes double; anything else becomes null."""
    types = _types(df)
    new = {c: (normalized(c, types[c]).cast("double") if is_number(types[c]) else to_double(col_ref(c)))
           for c in columns}
    return _replace(df, new)


def convert_to_string(df: DataFrame, columns: Sequence[str], order_by=None,
                      null_text: str | None = None) -> DataFrame:
    """Values as text. Nulls stay null unless `null_text` is given (e.g. "nan")."""
    types = _types(df)
    new = {}
    for c in columns:
        s = normalized(c, types[c]).cast("string") if is_floating(types[c]) else col_ref(c).cast("string")
        new[c] = s if null_text is None else F.coalesce(s, F.lit(null_text))
    return _replace(df, new)


def frequency_encoding(df: DataFrame, columns: Sequence[str], order_by=None) -> DataFrame:
    """Adds `<col>_freq_enc` (in place of a column of that name): the value's share among the non-null rows;
    null stays null.

    The per-value counts are aggregated with map-side combine (a hot value costs
    one row per task), then joined back; texts are identified by 128-bit hashes, so
    none is shuffled or broadcast. The count table is broadcast only when HyperLogLog
    puts its size under BROADCAST_DISTINCT; see `_join_shares` for larger ones.
    """
    cols = list(dict.fromkeys(columns))
    new = [f"{c}_freq_enc" for c in cols]
    own = [c for c in df.columns if c not in new]
    plain, names = numbered(df)
    at = [names[c] for c in cols]
    shares = _join_shares(plain, at, map_jobs(lambda c: _share_table(plain, c), at))
    return shares.select(*[col_ref(names[c]).alias(c) for c in own],
                         *[col_ref(f"{a}_freq_enc").alias(n) for a, n in zip(at, new)])


# Above the broadcast bound, values holding more than this share of the rows are
# joined by broadcast (at most 1 / HOT_SHARE of them), the rest by a shuffle join.
HOT_SHARE = 0.001


def _share_keys(df: DataFrame, c: str) -> dict[str, Column]:
    """What identifies a value in the share table: numbers and times themselves, text
    and nested values by two 64-bit hashes; null for a missing value."""
    dt = df.schema[c].dataType
    if is_atomic(dt) and not is_string(dt):
        return {"_qk0": normalized(c, dt)}
    v, there = comparable(c, dt), ~is_missing(c, dt)
    return {"_qk0": F.when(there, F.xxhash64(v)), "_qk1": F.when(there, F.xxhash64(F.lit(7), v))}


def _share_table(df: DataFrame, c: str) -> tuple[DataFrame, bool]:
    """(value key -> share table, whether it is small enough to broadcast)."""
    keys = _share_keys(df, c)
    keyed = df.select(*[k.alias(name) for name, k in keys.items()]).where(F.col("_qk0").isNotNull())
    stats = keyed.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_qk0").alias("d")).first()
    counts = keyed.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(max(int(stats["n"]), 1))).alias("_qs"))
    return counts, stats["d"] <= BROADCAST_DISTINCT


def _join_shares(df: DataFrame, cols: Sequence[str], tables: Sequence[tuple[DataFrame, bool]]
                 ) -> DataFrame:
    """Attach each column's value shares. A small share table is broadcast. Of a large
    one, values over HOT_SHARE of the rows (a bounded set) are broadcast; the rest come
    by a shuffle join, in which the rows that are settled already (hot values, nulls)
    are spread over 1,024 keys without a partner."""
    out = df
    for c, (counts, small) in zip(cols, tables):
        share, keys = f"{c}_freq_enc", list(_share_keys(out, c))
        out = out.withColumns(_share_keys(out, c))
        if small:
            out = out.join(F.broadcast(counts), keys, "left").withColumnRenamed("_qs", share).drop(*keys)
            continue
        hot = counts.where(F.col("_qs") > HOT_SHARE).withColumnRenamed("_qs", "_qhot")
        cold = counts.where(F.col("_qs") <= HOT_SHARE).withColumn("_qspread", F.lit(0).cast("long"))
        settled = F.col("_qhot").isNotNull() | F.col("_qk0").isNull()
        spread = F.when(settled, F.monotonically_increasing_id() % 1024 + 1).otherwise(0).cast("long")
        out = (out.join(F.broadcast(hot), keys, "left").withColumn("_qspread", spread)
               .join(cold, [*keys, "_qspread"], "left")
               .withColumn(share, F.coalesce("_qhot", "_qs")).drop(*keys, "_qspread", "_qhot", "_qs"))
    return out.select(*[col_ref(c) for c in df.columns], *[col_ref(f"{c}_freq_enc") for c in cols])


def review_manually(df: DataFrame, columns: Sequence[str] = (), order_by=None) -> DataFrame:
    """No change; the step only records that the issue was reviewed."""
    return df


def keep_as_metadata(df: DataFrame, columns: Sequence[str] = (), order_by=None) -> DataFrame:
    return df


def keep_as_identifier(df: DataFrame, columns: Sequence[str] = (), order_by=None) -> DataFrame:
    return df


Method = Callable[..., DataFrame]

METHODS: dict[str, Method] = {
    "fill_median": fill_median,
    "fill_mean": fill_mean,
    "fill_mode": fill_mode,
    "forward_fill": forward_fill,
    "backward_fill": backward_fill,
    "interpolate": interpolate,
    "drop_rows": drop_rows,
    "drop_columns": drop_columns,
    "drop_duplicate_rows": drop_duplicate_rows,
    "drop_duplicate_rows_keep_last": drop_duplicate_rows_keep_last,
    "drop_duplicate_columns": drop_duplicate_columns,
    "trim_spaces": trim_spaces,
    "lower_case": lower_case,
    "upper_case": upper_case,
    "title_case": title_case,
    "convert_to_numeric": convert_to_numeric,
    "convert_to_string": convert_to_string,
    "frequency_encoding": frequency_encoding,
    "review_manually": review_manually,
    "keep_as_metadata": keep_as_metadata,
    "remove_all_whitespace": remove_all_whitespace,
    "keep_as_identifier": keep_as_identifier,
}

def label_of(method: str) -> str:
    """A method's display label, from its key."""
    return method.replace("_", " ").capitalize()


LABELS: dict[str, str] = {m: label_of(m) for m in METHODS}

# Methods that read only the row they change: safe on a streaming DataFrame.
ROW_LOCAL = frozenset({
    "drop_rows", "drop_columns", "drop_duplicate_columns", "trim_spaces", "lower_case",
    "upper_case", "title_case", "convert_to_numeric", "convert_to_string",
    "remove_all_whitespace", "review_manually", "keep_as_metadata", "keep_as_identifier",
})


def register_method(name: str, fn: Method, label: str | None = None) -> None:
    METHODS[name] = fn
    LABELS[name] = label or label_of(name)


Transform = Callable[[DataFrame], DataFrame]


def prepare_method(df: DataFrame, method: str, columns: Sequence[str], order_by=None) -> Transform:
    """The step as a DataFrame -> DataFrame function. Statistics a method needs
    (median, mean, mode, value shares) are computed here, once, from `df`."""
    if method not in METHODS:
        raise KeyError(f"Unknown cleaning method: '{method}'")
    cols = list(columns)
    types = _types(df)
    if method == "fill_median":
        vals = _medians(df, [c for c in cols if is_number(types[c])])
        return lambda d: _fill_with(d, vals, as_double=True)
    if method == "fill_mean":
        vals = _means(df, [c for c in cols if is_number(types[c])])
        return lambda d: _fill_with(d, vals, as_double=True)
    if method == "fill_mode":
        vals = _modes(df, cols)
        return lambda d: _fill_with(d, vals, as_double=False)
    if method == "frequency_encoding":
        tables = map_jobs(lambda c: _share_table(df, c), cols)
        return lambda d: _join_shares(d, cols, tables)
    fn = METHODS[method]
    return lambda d: fn(d, cols, order_by=order_by)


def apply_method(df: DataFrame, method: str, columns: Sequence[str], order_by=None) -> DataFrame:
    return prepare_method(df, method, columns, order_by)(df)
