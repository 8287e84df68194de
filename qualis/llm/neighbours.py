"""Approximate nearest neighbours with learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced partitions: recursive
bisection at the median of the graph's slowest mode, then swaps of vertices across the cut
that remove edges. A small classifier (one hidden layer) learns from a vector the share of its
neighbours in each partition. Every vector is indexed in its most probable partition; a query
goes to its most probable partitions, where it is compared with every vector, and
the best are ranked by their exact distance. How many partitions a query probes is measured on
sample vectors that the classifier has not seen: the fewest that find `RECALL` of their neighbours.

Search: a partition is dealt by hash into tiles of at most about `TILE_BYTES` of vectors, and its
queries into chunks of about `CHUNK` for each tile, so a partition that holds a third of the rows or
of the queries is many tasks. A task holds one tile and streams its queries; each gives its best k.

Copies: equal vectors are one point with its k + 1 smallest ids. No more of them can be among the k
nearest of any query, so nothing is lost and a vector with a million copies is one row.

Bounds: the sample has at most `SAMPLE` vectors and `SAMPLE_BYTES`, taken by hash of the vector; it alone
passes through the driver, with two counts per partition.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components takes no
part, nor does one whose dimension is not the most frequent (ties: the least); equal rows (id and vector)
count once; of rows with one id and different vectors each is a row and, if its id is a query's, a
query; a null id is never a query and, as a candidate, sorts after every other id; a query has fewer than k rows
where there are fewer candidates; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import stored
from .text import LAST_ID, ref

K = 10
SAMPLE = 16384
SAMPLE_BYTES = 64 << 20
POINTS = 256  # sample points of a partition, about
PARTITIONS = 64
HIDDEN = 128
RECALL = 0.98
TILE_BYTES = 32 << 20
CHUNK = 1 << 18
BLOCK = 1 << 22  # distances held at once


# --- the neighbour graph and its partitions --------------------------------------------------

def nearest(points: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k nearest points (squared distances by blocks) of each query, without point own[i]."""
    squares = (points ** 2).sum(1)
    out = np.empty((len(queries), k), np.int64)
    step = max(1, BLOCK // max(1, len(points)))
    for at in range(0, len(queries), step):
        d = squares - 2 * (queries[at:at + step] @ points.T)
        if own is not None:
            d[np.arange(len(d)), own[at:at + step]] = np.inf
        out[at:at + step] = np.argpartition(d, k - 1, 1)[:, :k]
    return out


def _sides(src: np.ndarray, dst: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A balanced bisection of a symmetric graph: True for half of the n vertices (one less if n is odd)."""
    degree = np.maximum(np.bincount(src, minlength=n), 1)
    x = rng.standard_normal(n)
    for _ in range(60):  # power iteration on the lazy walk, without its constant mode
        x -= (x * degree).sum() / degree.sum()
        x = (x + np.bincount(src, x[dst], n) / degree) / 2
        x /= np.abs(x).max() or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[:n // 2]] = True
    cut = np.count_nonzero(side[src] != side[dst])
    for _ in range(20):
        gain = np.bincount(src, np.where(side[src] != side[dst], 1.0, -1.0), n)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        pairs = np.count_nonzero(gain[a[:m]] + gain[b[:m]] > 0)
        moved = side.copy()
        few = -(-pairs // 4)  # a part of them: gains of neighbours change when one moves
        moved[a[:few]], moved[b[:few]] = False, True
        new = np.count_nonzero(moved[src] != moved[dst])
        if new >= cut:
            break
        side, cut = moved, new
    return side


def balanced_partitions(neighbours: np.ndarray, levels: int, seed: int = 0) -> np.ndarray:
    """Numbers 0..2**levels - 1 of partitions of the neighbour graph, equal in size but for one vertex a level."""
    n, k = neighbours.shape
    rng = np.random.default_rng(seed)
    src, dst = np.repeat(np.arange(n), k), neighbours.ravel()
    src, dst = np.concatenate((src, dst)), np.concatenate((dst, src))
    label = np.zeros(n, np.int64)
    place = np.empty(n, np.int64)
    for _ in range(levels):
        inside = label[src] == label[dst]
        src, dst = src[inside], dst[inside]
        new = label * 2
        for part in range(label.max() + 1):
            own = np.flatnonzero(label == part)
            place[own] = np.arange(len(own))
            edges = label[src] == part
            new[own] += _sides(place[src[edges]], place[dst[edges]], len(own), rng)
        label = new
    return label


# --- the classifier --------------------------------------------------------------------------

@dataclass
class Router:
    """Standardised vectors through one hidden layer to partition scores; `probes` partitions per query."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def partitions(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -100, 100)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def partition(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(1)

    def most_probable(self, x: np.ndarray, n: int | None = None) -> np.ndarray:
        return np.argsort(-self.scores(x), 1, kind="stable")[:, :n or self.probes]


def train(x: np.ndarray, target: np.ndarray, hidden: int = HIDDEN, epochs: int = 20, seed: int = 0) -> Router:
    """Fits shares `target` (rows sum to 1) by cross entropy with Adam."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = np.clip((x - mean) / scale, -100, 100)
    d, p = x.shape[1], target.shape[1]
    weights = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden),
               rng.standard_normal((hidden, p)) * np.sqrt(1 / hidden), np.zeros(p)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    batch = 256
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at:at + batch]
            h = np.maximum(z[i] @ weights[0] + weights[1], 0)
            s = h @ weights[2] + weights[3]
            e = np.exp(s - s.max(1, keepdims=True))
            ds = (e / e.sum(1, keepdims=True) - target[i]) / len(i)
            dh = (ds @ weights[2].T) * (h > 0)
            grads = [z[i].T @ dh, dh.sum(0), h.T @ ds, ds.sum(0)]
            step += 1
            rate = 3e-3 * (1 - step / (total + 1))
            for w, g, a, b in zip(weights, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Router(mean, scale, *weights)


def fit(x: np.ndarray, partitions: int = PARTITIONS, points: int = POINTS, k: int = K,
        recall: float = RECALL) -> Router:
    """Partitions of a sample's neighbour graph, the classifier, and the number of partitions to probe."""
    x = np.asarray(x, np.float64)
    levels = max(0, min(int(np.log2(max(1, partitions))), int(np.log2(max(1, len(x) // points)))))
    if levels == 0 or len(x) <= k + 1:
        d = x.shape[1] if x.ndim == 2 else 1
        return Router(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    neighbours = nearest(x, x, k, np.arange(len(x)))
    label, p = balanced_partitions(neighbours, levels), 1 << levels
    target = np.zeros((len(x), p))
    for column in (label[:, None], label[neighbours]):
        for c in column.T:
            target[np.arange(len(x)), c] += 1 / (k + 1)
    held = np.arange(len(x)) % 8 == 0  # the sample's order is a hash
    router = train(x[~held], target[~held])
    found = router.partition(x)
    order = router.most_probable(x[held], p)
    rank = np.argsort(order, 1)  # of each partition for each held vector
    needed = np.sort(np.take_along_axis(rank, found[neighbours[held]], 1).ravel())
    router.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return router


# --- on Spark ---------------------------------------------------------------------------------

def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id (a null one as LAST_ID), v, h1, h2 (128 bits of hash) of the rows that take part."""
    v = ref(vector_col)
    rows = df.select(F.coalesce(ref(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), v.alias("v")).where(_usable(F.col("v")))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (most.d if most else 0))
    return rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))


def points(rows: DataFrame, k: int) -> DataFrame:
    """One row per different vector: h1, h2, v and its k + 1 smallest ids, ascending. The ids are limited before
    they are shuffled together; the vectors are shuffled once."""
    order = W.partitionBy("h1", "h2").orderBy("id")
    ids = (rows.select("h1", "h2", "id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
           .groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    return rows.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(ids, ["h1", "h2"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _routed(router, n: int | None):
    """Adds each row's n most probable partitions (the first alone if n is None)."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                best = router.value.most_probable(x, n or 1)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1]), pa.int32()),
                                                 pa.array(best.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "parts"])
    return run


def route(rows: DataFrame, router: Router, n: int | None = None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(router)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_routed(shared, n), f"{schema}, parts array<int>")


def _best(tile: np.ndarray, squares: np.ndarray, q: np.ndarray, k: int):
    """Per query the indices of its k nearest vectors of the tile, and all that may tie with them, with their
    distances: chosen by products, then computed by differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        own = (q ** 2).sum(1)
        d = squares + own[:, None] - 2 * (q @ tile.T)
        near = np.partition(d, k - 1, 1)[:, k - 1] if len(tile) > k else d.max(1)
        slack = 1e-12 * (own + squares.max())
        for i in range(len(q)):
            # products of huge values overflow: then every vector is compared
            at = np.flatnonzero(d[i] <= near[i] + slack[i]) if np.isfinite(d[i]).all() else np.arange(len(tile))
            yield at, np.sqrt(((tile[at] - q[i]) ** 2).sum(1))


_FOUND = "query_id long, q1 long, q2 long, vec_id long, score double"


def _search(k: int):
    """Rows sorted by (part, tile, chunk, id of a query): a tile's points, then its queries."""
    def run(batches):
        key, xs, ids, hashes, tile = None, [], [], [], None

        def found(part):
            nonlocal tile
            if tile is None:
                tile = np.concatenate(xs)
            squares = (tile ** 2).sum(1)
            q, step = _matrix(part.column("v")), max(1, BLOCK // len(tile))
            names = zip(part.column("query_id").to_pylist(), part.column("h1").to_pylist(), part.column("h2").to_pylist())
            out = []
            for at in range(0, len(q), step):
                for near, d in _best(tile, squares, q[at:at + step], k + 1):
                    own, q1, q2 = next(names)
                    rows = [(s, i) for p, s in zip(near.tolist(), d.tolist()) for i in ids[p]
                            if i != own or hashes[p] != (q1, q2)]
                    out += [(own, q1, q2, i, s) for s, i in sorted(rows)[:k]]
            columns = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.float64())],
                ["query_id", "q1", "q2", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("part", "tile", "chunk")], 1)
            asks = batch.column("query_id").is_valid().to_numpy(zero_copy_only=False)
            marks = np.concatenate((keys, asks[:, None]), 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if (now := tuple(keys[i].tolist())) != key:
                    key, xs, ids, hashes, tile = now, [], [], [], None
                part = batch.slice(i, j - i)
                if not asks[i]:
                    xs.append(_matrix(part.column("v")))
                    ids += part.column("ids").to_pylist()
                    hashes += zip(part.column("h1").to_pylist(), part.column("h2").to_pylist())
                elif xs:
                    yield found(part)
    return run


def _dealt(rows: DataFrame, counts: dict[int, int], name: str, out: str) -> DataFrame:
    """Copies of rows for each of counts[part] tiles (or chunks)."""
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("int") for p, c in counts.items() for x in (p, c)]),
                                F.col("part")), F.lit(1)) if counts else F.lit(1)
    return rows.withColumn(out, F.pmod(F.col("h1"), n.cast("long")).cast("int") if name == "one"
                           else F.explode(F.sequence(F.lit(0), n - 1)))


def nearest_neighbours(rows: DataFrame, queries: Column, k: int = K, partitions: int = PARTITIONS,
                       sample: int = SAMPLE, recall: float = RECALL, tile_bytes: int = TILE_BYTES,
                       chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each row for which `queries` (a condition on the id, as column `id`) holds:
    query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    spark = rows.sparkSession
    taken = vectors(rows, id_col, vector_col)
    all_points = stored(points(taken, k))
    first = all_points.select(F.size("v").alias("d")).first()
    dim = first.d if first else 1
    n = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
    some = all_points.select("v", "h1", "h2").orderBy("h1", "h2").limit(n).collect()
    router = fit(np.array([r.v for r in some], np.float64).reshape(len(some), dim), partitions, k=k, recall=recall)

    indexed = route(all_points, router).withColumn("part", F.element_at("parts", 1)).drop("parts")
    asked = taken.where(queries & (F.col("id") != LAST_ID)).dropDuplicates(["id", "h1", "h2"])
    probes = route(asked, router, router.probes).withColumn("part", F.explode("parts")).drop("parts")
    tiles = {r.part: -(-r.n // max(1, tile_bytes // (8 * dim))) for r in
             indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    chunks = {r.part: -(-r.n // chunk) for r in probes.groupBy("part").agg(F.count("*").alias("n")).collect()}

    null = F.lit(None)
    left = _dealt(_dealt(indexed.where(F.col("part").isin(list(chunks))), tiles, "one", "tile"), chunks, "each", "chunk") \
        .withColumn("query_id", null.cast("long"))
    right = _dealt(_dealt(probes, tiles, "each", "tile"), chunks, "one", "chunk") \
        .withColumnRenamed("id", "query_id").withColumn("ids", null.cast("array<long>"))
    both = left.unionByName(right).repartition("part", "tile", "chunk") \
        .sortWithinPartitions("part", "tile", "chunk", F.col("query_id").isNotNull())
    found = both.mapInArrow(_search(k), _FOUND)
    order = W.partitionBy("query_id", "q1", "q2").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    vec_id = F.when(F.col("vec_id") != LAST_ID, F.col("vec_id"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), vec_id.alias("vec_id"), "score")
