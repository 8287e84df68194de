"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared as numpy tiles: exclusive or, then bit counts. Tiles
are keyed by population counts. The four 16-bit quarters of a fingerprint are
counted, equal count vectors share a cell, and a cell of more than `tile_rows`
fingerprints is dealt over several tiles by hash. The differing bits of two
fingerprints are at least the sum of the differences of their counts, so tile
pairs whose cells differ by more than the radius are never formed. This is exact:
no link is lost.

A tile pair returns a spanning forest of its links instead of all of them (at
most one row per fingerprint), so a large group of near copies costs a linear
number of rows. `components` then joins the forests.

Defined cases: a null, empty or blank text has the fingerprint zero and links like
any other; a null id takes part, and its component is the smallest id reached
(null if there is none); rows repeated with one id share its component rules like
any rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .components import components
from .text import in_slices, ref, space_words, texts

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE_ROWS = 4096
LANES = 4
_STRIPE = 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included: a bit is set if it is
    set in over half of the shingles' xxHash64 values."""
    words = space_words(text.lower())  # bytes: A-Z only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(values[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, th, fp): the id, a hash of the text, and the fingerprint, one row per row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in texts(batch.column("text"))], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("th"), pa.array(fps.view(np.int64))], ["id", "th", "fp"])
    rows = docs.select(ref(id_col).cast("long").alias("id"), F.xxhash64(ref(text_col)).alias("th"),
                       ref(text_col).alias("text"))
    return rows.mapInArrow(in_slices(run, "text"), "id long, th long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints a and b, as edges (u, v)."""
    nodes = np.concatenate((a, b))
    root = np.arange(len(nodes))
    edges: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for at in range(0, len(a), _STRIPE):
        near = np.bitwise_count(a[at:at + _STRIPE, None] ^ b[None, :]) <= radius
        rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(rows):
            continue
        near = near[np.ix_(rows, cols)]
        rows, cols = rows + at, cols + len(a)
        while True:  # links that still join two trees; each round every such row and column joins one
            apart = near & (root[rows][:, None] != root[cols][None, :])
            r, c = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
            if not len(r):
                break
            pairs = [*zip(rows[r].tolist(), cols[apart[r].argmax(axis=1)].tolist()),
                     *zip(rows[apart[:, c].argmax(axis=0)].tolist(), cols[c].tolist())]
            for x, y in pairs:
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges.append((x, y))
            while (root[root] != root).any():
                root = root[root]
    at = np.array(edges, np.int64).reshape(-1, 2)
    return nodes[at[:, 0]], nodes[at[:, 1]]


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of count vectors within the radius, one of each pair of opposites."""
    out = [()]
    for _ in range(LANES):
        out = [o + (d,) for o in out for d in range(-radius, radius + 1)
               if sum(map(abs, o)) + abs(d) <= radius]
    return [o for o in out if o >= (0,) * LANES]


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct values of `fp` within the radius."""
    step = 32  # cell number: the quarters' counts (0 to 16, with room to add an offset) in base 32
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)) + 8) * step ** i
               for i in range(LANES)).cast("long")
    cells = fps.select("fp").distinct().select("fp", cell.alias("cell"))
    # cells are bounded by 17**4, whatever the input
    n_tiles = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("long").alias("n"))
    tiles = stored(cells.join(n_tiles, "cell")
                 .groupBy("cell", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).alias("t"))
                 .agg(F.collect_list("fp").alias("fps")))
    names = tiles.select("cell", "t")
    moves = [sum(d * step ** i for i, d in enumerate(o)) for o in _offsets(radius)]
    pairs = (names.select("cell", "t", F.explode(F.array(*[F.lit(m).cast("long") for m in moves])).alias("m"))
             .select(F.col("cell").alias("c1"), F.col("t").alias("t1"), (F.col("cell") + F.col("m")).alias("c2"))
             .join(names.select(F.col("cell").alias("c2"), F.col("t").alias("t2")), "c2")
             .where("c1 != c2 OR t1 <= t2"))
    one = tiles.select(F.col("cell").alias("c1"), F.col("t").alias("t1"), F.col("fps").alias("a"))
    two = tiles.select(F.col("cell").alias("c2"), F.col("t").alias("t2"), F.col("fps").alias("b"))
    both = pairs.join(one, ["c1", "t1"]).join(two, ["c2", "t2"]).select("a", "b")

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                u, v = _forest(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
    return both.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, th, fp, root, component_id) for every row; root is the component's smallest linked fingerprint, component_id
    the smallest id reachable (null where no row of the component has one)."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle))
    groups = fps.groupBy("fp").agg(F.min("id").alias("first"))  # exact copies meet here, map side first
    roots = components(links(groups, radius)).select(F.col("node").alias("fp"), "root")
    named = groups.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select("id", "th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the row with the smallest (id, text hash), all columns kept."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    first = found.groupBy("root") \
        .agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "th")).alias("r")) \
        .select(F.col("r.id").alias("__id"), F.col("r.th").alias("__th"))
    first = first.distinct()
    rows = docs.select(*[ref(c) for c in docs.columns], ref(id_col).cast("long").alias("__simhash_id"),
                       F.xxhash64(ref(text_col)).alias("__simhash_th"))
    same = F.col("__simhash_id").eqNullSafe(F.col("__id")) & (F.col("__simhash_th") == F.col("__th"))
    chosen = rows.join(first, same, "left_semi")
    order = Window.partitionBy("__simhash_id", "__simhash_th").orderBy(F.lit(0))
    return (chosen.withColumn("__simhash_n", F.row_number().over(order)).where("__simhash_n = 1")
            .select(*[ref(c) for c in docs.columns]))
