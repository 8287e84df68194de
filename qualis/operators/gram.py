"""Pearson correlation of all pairs of columns in one pass, over rows where both are present.

With the values X (0 where missing) and the presence M of a batch, the products M'M, X'M, (X*X)'M and
X'X hold every count, sum, sum of squares and cross product that a pair needs. A task
adds them up over its batches, with each column less a value near its mean, and sends them
block by block (`BLOCK` x `BLOCK` columns); a block's parts, moved to a common shift, add to the
whole. The pass reads the table once for any number of columns; what is shuffled depends on the
number of tasks and of pairs, not on the rows, and no block is larger than about a megabyte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.missing import normalized

BLOCK = 128
TASKS = 4096  # more partitions than that are read by so many tasks, each sending its blocks once
# a pair's variance below this share of its mean square (about the shift) is rounding: no variance
LEAST_VARIANCE = 1e-13

_PARTS = 8  # count, sums and squares of a and of b, cross products, infinite values, per pair
_SENT = "i int, j int, payload binary"


def _near_mean(x: np.ndarray) -> np.ndarray:
    """A finite value near the mean of each column: its only value where it has one; 0 without values."""
    with np.errstate(all="ignore"):
        finite = np.where(np.isfinite(x), x, np.nan)
        n = np.isfinite(x).sum(0)
        low, high = np.nanmin(finite, 0, initial=np.inf), np.nanmax(finite, 0, initial=-np.inf)
        mean = np.nansum(finite / np.maximum(n, 1), 0)
    return np.where(n == 0, 0.0, np.where(low == high, low, mean))


class _Sums:
    def __init__(self, k: int):
        self.shift = None
        self.n, self.s, self.q, self.p, self.infinite = (np.zeros((k, k)) for _ in range(5))

    def add(self, x: np.ndarray) -> None:
        if self.shift is None:
            self.shift = _near_mean(x)
        there = ~np.isnan(x)
        m = there.astype(np.float64)
        far = np.isinf(x)
        if far.any():
            f = far.astype(np.float64)
            self.infinite += f.T @ m
        x = np.where(there & ~far, x - self.shift, 0.0)
        with np.errstate(over="ignore", invalid="ignore"):
            self.n += m.T @ m
            self.s += x.T @ m
            self.q += (x * x).T @ m
            self.p += x.T @ x

    def blocks(self, block: int):
        """(i, j, bytes): the shifts of the block's rows and columns, then its parts."""
        cuts = range(0, len(self.n), block)
        for i in cuts:
            for j in cuts:
                if j < i:
                    continue
                a, b = slice(i, i + block), slice(j, j + block)
                parts = [self.n[a, b], self.s[a, b], self.s[b, a].T, self.q[a, b], self.q[b, a].T, self.p[a, b],
                         self.infinite[a, b], self.infinite[b, a].T]
                yield i, j, np.concatenate([self.shift[a], self.shift[b], *(x.ravel() for x in parts)]).tobytes()


def _products(k: int, block: int):
    def run(batches):
        sums = _Sums(k)
        for batch in batches:
            if batch.num_rows:
                sums.add(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
        if sums.shift is not None:
            for i, j, payload in sums.blocks(block):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()),
                                                  pa.array([payload], pa.binary())], ["i", "j", "payload"])
    return run


def _unpacked(payload: bytes, rows: int, columns: int):
    x = np.frombuffer(payload, np.float64)
    return x[:rows], x[rows:rows + columns], x[rows + columns:].reshape(_PARTS, rows, columns)


def _added(total, part):
    """The sums of both about the shift of `total`."""
    if total is None:
        return part[0], part[1], part[2].copy()
    da, db = (part[0] - total[0])[:, None], (part[1] - total[1])[None, :]
    n, sa, sb, qa, qb, p, fa, fb = part[2]
    total[2][...] += [n, sa + da * n, sb + db * n, qa + 2 * da * sa + da * da * n, qb + 2 * db * sb + db * db * n,
                      p + db * sa + da * sb + da * db * n, fa, fb]
    return total


def _correlations(parts: np.ndarray) -> np.ndarray:
    """NaN where a value is infinite; masked (as a second result) where a column has no variance."""
    n, sa, sb, qa, qb, p, fa, fb = parts
    with np.errstate(all="ignore"):
        va, vb = qa - sa * sa / n, qb - sb * sb / n
        none = (n == 0) | (va <= LEAST_VARIANCE * qa) | (vb <= LEAST_VARIANCE * qb)
        r = (p - sa * sb / n) / (np.sqrt(va) * np.sqrt(vb))
        r = np.where((fa > 0) | (fb > 0), np.nan, np.clip(r, -1.0, 1.0))
    return r, none & ~((fa > 0) | (fb > 0))


def _summed(k: int, block: int):
    """Parts sorted by (i, j) to (a, b, corr) of every ordered pair of the block."""
    def run(batches):
        key, total = None, None

        def out():
            i, j = key
            r, none = _correlations(total[2])
            a, b = (x.ravel() for x in np.meshgrid(np.arange(i, i + r.shape[0]), np.arange(j, j + r.shape[1]), indexing="ij"))
            keep = (a <= b) if i == j else np.ones(len(a), bool)
            a, b, r, none = a[keep], b[keep], r.ravel()[keep], none.ravel()[keep]
            r = np.where(a == b, np.where(np.isnan(r), r, 1.0), r)
            twice = a != b
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((a, b[twice])), pa.int32()), pa.array(np.concatenate((b, a[twice])), pa.int32()),
                 pa.array(np.concatenate((r, r[twice])), pa.float64(), mask=np.concatenate((none, none[twice])))],
                ["a", "b", "corr"])

        for batch in batches:
            for i, j, payload in zip(*[batch.column(c).to_pylist() for c in ("i", "j", "payload")]):
                if key is not None and key != (i, j):
                    yield from out()
                    total = None
                key = (i, j)
                total = _added(total, _unpacked(payload, min(block, k - i), min(block, k - j)))
        if key is not None:
            yield from out()
    return run


def pair_correlations(df: DataFrame, columns, block: int = BLOCK) -> DataFrame:
    """a, b (places in `columns`), corr of every ordered pair; null where a column has no variance over the rows
    where both are present (or there are none). Without rows every pair is null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    k = len(columns)
    values = df.select(*[normalized(c, types[c]).cast("double").alias(f"c{n}") for n, c in enumerate(columns)])
    sent = values.coalesce(TASKS).mapInArrow(_products(k, block), _SENT)
    found = sent.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_summed(k, block), "a int, b int, corr double")
    blocks = df.sparkSession.range(0, k * k).select(
        F.floor(F.col("id") / k).cast("int").alias("a"), (F.col("id") % k).cast("int").alias("b"), F.lit(None).cast("double").alias("corr"))
    return found.unionByName(blocks).groupBy("a", "b").agg(F.max("corr").alias("corr"))
