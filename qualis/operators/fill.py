"""Order-dependent steps without a single-partition window.

A window with only `orderBy` moves every row into one task. Instead rows are cut
into blocks along the order, at quantiles of the order key, so a block holds about
`block_rows` rows however the key is spread (see `_block`). Rows are ordered by the
key, nulls first; rows with equal keys by a 64-bit hash of all their values, the
same way in every step. A hot key (or the null key) is cut by ranges of that hash,
so it does not land in one block; only identical rows cannot be told apart.

1. inside each block a window `partitionBy(blk).orderBy(key)` computes the local
   answer (last / next non-null value, row position);
2. each block is summarised to one row (its last and first non-null value, row
   count), and a running window over the block summary (one row per block, so
   n / B rows) gives the carry from earlier or later blocks;
3. the carry is joined back on `blk`. The rows are already hash-partitioned on
   `blk` by step 1, so only the small carry table moves; AQE broadcasts it when
   its measured size is small.

Used for forward fill, backward fill, linear interpolation by row position, and
keep-first / keep-last de-duplication.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import DEFAULT_CONFIG
from ..functions.columns import col_ref, numbered
from ..functions.missing import normalized
from ..functions.types import is_number
from ..session import stored


def _key_number(df: DataFrame, order_by: str) -> Column:
    """The order key as a number that keeps its order (dates and timestamps as
    epoch days / microseconds); used only to cut blocks."""
    dt = df.schema[order_by].dataType
    c = col_ref(order_by)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return c


# The order key is cut at up to so many quantiles, and evenly between them.
QUANTILES = 1024
_ORD, _TIE = "_qo", "_qt"


def _fraction(h: Column) -> Column:
    """A 64-bit hash as a number in [0, 1), in the hash's order."""
    return F.least(h.cast("double") / F.lit(2.0 ** 64) + 0.5, F.lit(1 - 1e-9))


def _below(bounds: Column, n: int, k: Column, equal: bool) -> Column:
    """How many of the `n` sorted bounds are smaller than `k` (or equal to it): bisection."""
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        at + step > n, at).otherwise(F.when(
            (F.get(bounds, at + step - 1) <= k) if equal else (F.get(bounds, at + step - 1) < k), at + step).otherwise(at)))


def _block(df: DataFrame, order_by: str, block_rows: int) -> Column | None:
    """Block id, growing along the order, with about `block_rows` rows per block.

    One aggregate gives the counts and extremes of the key, and where there are several blocks another one its
    quantiles. A key between two quantiles is placed by linear interpolation, a key that fills several quantiles by
    its row's tie hash; positions are then cut evenly. Null keys are blocks below 0. None where one block holds all.
    """
    k = _key_number(df, order_by)
    row = df.agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.count(k).alias("n"),
                 F.count_if(k.isNull()).alias("nulls")).first()
    if row["n"] + row["nulls"] <= block_rows:
        return None
    n_blocks, null_blocks = -(-row["n"] // block_rows), -(-row["nulls"] // block_rows)
    cuts = min(QUANTILES, n_blocks)
    grid = [i / cuts for i in range(1, cuts)]
    quantiles = df.agg(F.percentile_approx(k, grid).alias("q")).first()["q"] if grid else []
    h = _fraction(F.col(_TIE))
    null_block = (F.floor(h * null_blocks) - null_blocks).cast("long")
    if n_blocks <= 1:
        return F.when(k.isNull(), null_block).otherwise(F.lit(0).cast("long"))
    inner = list(quantiles)
    dt = df.select(k.alias("k")).schema["k"].dataType
    bounds = F.array(*[F.lit(v) for v in inner]).cast(T.ArrayType(dt))
    ends = F.array(*[F.lit(v) for v in (row["lo"], *inner, row["hi"])]).cast(T.ArrayType(dt))
    less, upto = _below(bounds, len(inner), k, False), _below(bounds, len(inner), k, True)
    low, high = F.get(ends, less).cast("double"), F.get(ends, less + 1).cast("double")
    within = F.coalesce(F.try_divide(k.cast("double") - low, high - low), F.lit(0.0))
    place = F.when(upto > less, less + 1 + h * (upto - less - 1)).otherwise(
        less + F.greatest(F.lit(0.0), F.least(within, F.lit(1 - 1e-9))))
    per_cut = max(1, round(n_blocks / cuts))
    return F.when(k.isNull(), null_block).otherwise(F.floor(place * per_cut).cast("long"))


def _ordered(df: DataFrame, order_by: str, block_rows: int) -> DataFrame:
    return _placed(df, order_by, block_rows)[0]


def _placed(df: DataFrame, order_by: str, block_rows: int) -> tuple[DataFrame, bool]:
    """The rows with `_qblk`, the order `_qo` (key, tie hash) and the tie hash; and whether there are several blocks."""
    from .stats import row_hashes
    tied = df.select(*[col_ref(c) for c in df.columns], row_hashes(df, df.columns)[0].alias(_TIE))
    block = _block(tied, order_by, block_rows)
    placed = tied.withColumn("_qblk", F.lit(0).cast("long") if block is None else block).withColumn(
        _ORD, F.struct(col_ref(order_by).alias("k"), F.col(_TIE).alias("h")))
    return placed, block is not None


def with_positions(df: DataFrame, order_by: str, columns: Sequence[Column], block_rows: int | None = None
                   ) -> DataFrame:
    """`columns` and `_qpos`, the row's position (0, 1, 2, ...) in the order. Only these
    columns are shuffled, once, by block; a block's offset comes from the block counts."""
    rows = _ordered(df, order_by, block_rows or DEFAULT_CONFIG.fill_block_rows).select(
        "_qblk", col_ref(order_by).alias("_qkey"), _TIE, *columns)
    before = Window.orderBy("_qblk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_qblk").agg(F.count(F.lit(1)).alias("_qn")).select(
        "_qblk", F.coalesce(F.sum("_qn").over(before), F.lit(0)).alias("_qoff"))
    place = F.row_number().over(Window.partitionBy("_qblk").orderBy("_qkey", _TIE))
    kept = [c for c in rows.columns if c not in ("_qblk", "_qkey", _TIE)]
    return rows.join(offsets, "_qblk").select(*map(col_ref, kept), (F.col("_qoff") + place - 1).alias("_qpos"))


def _running(spec, keys: Sequence[Column], forward: bool, exclusive: bool = False):
    """Rows from the start up to the current row (or the row before it), in key
    order for forward steps and in reverse key order for backward ones. Growing
    frames are evaluated in one pass."""
    ordered = spec.orderBy(*[k if forward else k.desc() for k in keys])
    return ordered.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)


def _valued(c: str, dt) -> Column:
    return normalized(c, dt)


def _fill(df: DataFrame, columns: Sequence[str], order_by: str, forward: bool,
          block_rows: int) -> DataFrame:
    if not columns:
        return df
    types = {f.name: f.dataType for f in df.schema.fields}
    blk = "_qblk"
    base, several = _placed(df, order_by, block_rows)
    o = F.col(_ORD)
    # A frame reaching to UNBOUNDED FOLLOWING is recomputed for every row; the
    # backward direction is the forward one over a descending order instead.
    w = _running(Window.partitionBy(blk), [col_ref(order_by), F.col(_TIE)], forward)
    local = base.select(*[col_ref(c) for c in df.columns], blk, *[
        F.last(_valued(c, types[c]), ignorenulls=True).over(w).alias(f"_ql{i}")
        for i, c in enumerate(columns)])
    if not several:
        out = {c: F.col(f"_ql{i}").cast(types[c]).alias(c) for i, c in enumerate(columns)}
        return local.select(*[out.get(c, col_ref(c)) for c in df.columns])
    # one row per block: its last (forward) or first (backward) non-null value
    edge = F.max_by if forward else F.min_by
    summary = base.groupBy(blk).agg(*[
        edge(col_ref(c), F.when(_valued(c, types[c]).isNotNull(), o)).alias(f"_qs{i}")
        for i, c in enumerate(columns)])
    sw = _running(Window, [F.col(blk)], forward, exclusive=True)
    carry = summary.select(blk, *[
        F.last(F.col(f"_qs{i}"), ignorenulls=True).over(sw).alias(f"_qc{i}")
        for i in range(len(columns))])
    joined = local.join(carry, blk, "left")
    out = {c: F.coalesce(F.col(f"_ql{i}"), F.col(f"_qc{i}")).cast(types[c]).alias(c)
           for i, c in enumerate(columns)}
    return joined.select(*[out.get(c, col_ref(c)) for c in df.columns])


def forward_fill(df: DataFrame, columns: Sequence[str], order_by: str,
                 block_rows: int = DEFAULT_CONFIG.fill_block_rows) -> DataFrame:
    """Each null takes the last non-null value before it; leading nulls stay."""
    return _filled(df, columns, order_by, True, block_rows)


def backward_fill(df: DataFrame, columns: Sequence[str], order_by: str,
                  block_rows: int = DEFAULT_CONFIG.fill_block_rows) -> DataFrame:
    """Each null takes the next non-null value after it; trailing nulls stay."""
    return _filled(df, columns, order_by, False, block_rows)


def _filled(df: DataFrame, columns: Sequence[str], order_by: str, forward: bool, block_rows: int) -> DataFrame:
    plain, names = numbered(df)
    return _fill(plain, [names[c] for c in columns], names[order_by], forward, block_rows).toDF(*df.columns)


def interpolate(df: DataFrame, columns: Sequence[str], order_by: str,
                block_rows: int = DEFAULT_CONFIG.fill_block_rows) -> DataFrame:
    """Linear interpolation in row position (0, 1, 2, ... by `order_by`, whatever
    the gaps in the key), both ends padded with the nearest value. Numeric
    columns only; results are double.

    Every per-block figure comes from the source, not from windowed rows, so
    the rows are shuffled once (by block, for the window pass):
    1. per block: row count, and the last / first non-null (key, value) per column;
    2. per block: the in-block rank of those rows (a second narrow pass, joined
       to the small step-1 table);
    3. on the block table: offsets (running row count) and the carried
       (position, value) from earlier and later blocks;
    4. one window pass per block: row position, nearest non-null (position, value)
       before and after, and the linear formula.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in columns if is_number(types[c])]
    if not cols:
        return df
    plain, names = numbered(df)
    return _interpolated(plain, [names[c] for c in cols], names[order_by], block_rows).toDF(*df.columns)


def _block_carry(base: DataFrame, cols: list[str], vals: dict[str, Column]) -> DataFrame:
    """Per block its offset (`_qoff`) and, per column, the nearest (position, value) before (`_qcb`) and after it (`_qca`)."""
    blk, o = "_qblk", F.col(_ORD)
    # 1. block counts and edge rows
    edges = base.groupBy(blk).agg(
        F.count(F.lit(1)).alias("_qn"),
        *[x for i, c in enumerate(cols) for x in (
            F.max_by(F.struct(o.alias("k"), vals[c].alias("v")), F.when(vals[c].isNotNull(), o)).alias(f"_ql{i}"),
            F.min_by(F.struct(o.alias("k"), vals[c].alias("v")), F.when(vals[c].isNotNull(), o)).alias(f"_qf{i}"))])
    # 2. in-block rank of each edge row: rows of the block with a smaller key
    ranks = base.select(blk, o).join(edges, blk).groupBy(blk).agg(
        *[x for i in range(len(cols)) for x in (
            (F.count_if(o <= F.col(f"_ql{i}.k")) - 1).alias(f"_qlr{i}"),
            F.count_if(o < F.col(f"_qf{i}.k")).alias(f"_qfr{i}"))])
    # 3. offsets and carries on the block table (one row per block)
    blocks = edges.join(ranks, blk, "left")
    off = F.coalesce(F.sum("_qn").over(
        Window.orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_qoff", off)
    pts = []
    for i in range(len(cols)):
        last_pt = F.when(F.col(f"_ql{i}").isNotNull(), F.struct(
            (F.col("_qoff") + F.col(f"_qlr{i}")).cast("double").alias("p"), F.col(f"_ql{i}.v").alias("v")))
        first_pt = F.when(F.col(f"_qf{i}").isNotNull(), F.struct(
            (F.col("_qoff") + F.col(f"_qfr{i}")).cast("double").alias("p"), F.col(f"_qf{i}.v").alias("v")))
        pts += [last_pt.alias(f"_qlp{i}"), first_pt.alias(f"_qfp{i}")]
    blocks = blocks.select(blk, "_qoff", *pts)
    fwd = _running(Window, [F.col(blk)], True, exclusive=True)
    bwd = _running(Window, [F.col(blk)], False, exclusive=True)
    return blocks.select(blk, "_qoff", *[x for i in range(len(cols)) for x in (
        F.last(f"_qlp{i}", ignorenulls=True).over(fwd).alias(f"_qcb{i}"),
        F.last(f"_qfp{i}", ignorenulls=True).over(bwd).alias(f"_qca{i}"))])


def _interpolated(df: DataFrame, cols: list[str], order_by: str, block_rows: int) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    blk = "_qblk"
    base, several = _placed(df, order_by, block_rows)
    vals = {c: normalized(c, types[c]).cast("double") for c in cols}
    if several:
        rows = base.join(_block_carry(base, cols, vals), blk, "left")
    else:
        none = F.lit(None).cast("struct<p:double,v:double>")
        rows = base.withColumns({"_qoff": F.lit(0), **{f"_qc{x}{i}": none for i in range(len(cols)) for x in "ba"}})
    # 4. one window pass: rows partitioned by block (the only full shuffle)
    order = [col_ref(order_by), F.col(_TIE)]  # as the struct `_qo` orders them
    wpos = Window.partitionBy(blk).orderBy(*order)
    pos = (F.col("_qoff") + F.row_number().over(wpos) - 1).cast("double")
    rows = rows.withColumn("_qpos", pos)
    up = _running(Window.partitionBy(blk), order, True)
    down = _running(Window.partitionBy(blk), order, False)
    out = {}
    for i, c in enumerate(cols):
        here = F.when(vals[c].isNotNull(), F.struct(F.col("_qpos").alias("p"), vals[c].alias("v")))
        b = F.coalesce(F.last(here, ignorenulls=True).over(up), F.col(f"_qcb{i}"))
        a = F.coalesce(F.last(here, ignorenulls=True).over(down), F.col(f"_qca{i}"))
        rows = rows.withColumn(f"_qb{i}", b).withColumn(f"_qa{i}", a)
        bb, aa = F.col(f"_qb{i}"), F.col(f"_qa{i}")
        slope = (aa["v"] - bb["v"]) / (aa["p"] - bb["p"])
        mid = F.when(aa["p"] == bb["p"], bb["v"]).otherwise(bb["v"] + slope * (F.col("_qpos") - bb["p"]))
        out[c] = (F.when(vals[c].isNotNull(), col_ref(c).cast("double"))
                  .when(bb.isNull() & aa.isNull(), F.lit(None).cast("double"))
                  .when(bb.isNull(), aa["v"]).when(aa.isNull(), bb["v"]).otherwise(mid)).alias(c)
    return rows.select(*[out.get(c, col_ref(c)) for c in df.columns])


# Candidate hashes broadcast at most (16 bytes and the order key each).
BROADCAST_HASHES = 4_000_000
HOT_GROUPS = 1000


def drop_duplicate_rows(df: DataFrame, order_by: str | None = None, keep: str = "first",
                        columns: Sequence[str] | None = None) -> DataFrame:
    """Keep one row of each group of identical rows (all columns but `order_by`): the
    first or last by `order_by`, any one of those that tie (null keys count only where
    a group has no other). Without an order any one copy is kept.

    Rows are identified by two 64-bit hashes of their normalised values, whatever
    their width, so the grouping shuffles 16 bytes a row and a hot group collapses
    map-side. Only the hashes that repeat are joined back, by broadcast while they are
    few; rows are not shuffled then. Where they are many, those of the largest groups are
    broadcast, so no key of the shuffle join has more than 1 / HOT_GROUPS of the rows.
    """
    keys = list(columns) if columns else [c for c in df.columns if c != order_by]
    if not keys:
        return df
    plain, names = numbered(df)
    out = _without_copies(plain, names[order_by] if order_by else None, keep, [names[c] for c in keys])
    return df if out is None else out.toDF(*df.columns)


def _without_copies(df: DataFrame, order_by: str | None, keep: str, keys: list[str]) -> DataFrame | None:
    from .stats import row_hashes
    own, h = df.columns, ["_qh1", "_qh2"]
    hashed = df.select(*own, *row_hashes(df, keys))
    if order_by is None:
        return hashed.dropDuplicates(h).select(*own)
    pick = F.min if keep == "first" else F.max
    repeated = (hashed.groupBy(*h).agg(F.count(F.lit(1)).alias("_qc"), pick(col_ref(order_by)).alias("_qk"))
                .where(F.col("_qc") > 1))
    n_repeated = repeated.count()
    if n_repeated == 0:
        return None
    if n_repeated <= BROADCAST_HASHES:
        return _one_of_each(hashed, F.broadcast(repeated), order_by, own)
    largest = stored(repeated.orderBy(F.desc("_qc"), *h).limit(HOT_GROUPS))  # so every other group is smaller
    hot = F.broadcast(largest)
    others = repeated.join(F.broadcast(largest.select(*h)), h, "left_anti")
    cold = hashed.join(F.broadcast(largest.select(*h)), h, "left_anti")
    return _first_of(hashed.join(hot, h), order_by, own).unionByName(_one_of_each(cold, others, order_by, own))


def _first_of(joined: DataFrame, order_by: str, own: list[str]) -> DataFrame:
    """One row of each group among those with its key `_qk`; ties collapse before they are shuffled."""
    first = joined.where(F.col(order_by).eqNullSafe(F.col("_qk")))
    return first.groupBy("_qh1", "_qh2").agg(F.first(F.struct(*own)).alias("_qr")).select("_qr.*")


def _one_of_each(hashed: DataFrame, repeated: DataFrame, order_by: str, own: list[str]) -> DataFrame:
    """Rows that do not repeat, and one of each group that does."""
    h = ["_qh1", "_qh2"]
    single = hashed.join(repeated, h, "left_anti").select(*own)
    return single.unionByName(_first_of(hashed.join(repeated, h), order_by, own))
