"""Training-order materialisation: fixed-stride shards in a keyed pseudo-random order.

Documents become token ids (16 bits each) with an end id after each; every task cuts
its ids into sequences of `length`, the last one padded with the end id, and stores them, compressed,
in the checkpoint folder. Their counts by task number every sequence 0..N-1, so texts are tokenised
once and a lost executor changes nothing in the numbers.
A keyed Feistel permutation with cycle-walking maps the number to a global slot: no
table, no sort of random keys, and the same key gives the same order.

Slots are dealt by range: one task holds `TASK_SHARDS` whole shards of `shard_rows` consecutive slots,
sorts them and writes each as one file of fixed stride, `length` * 2 bytes a slot. Slot s
starts at byte (s % shard_rows) * stride of shard s // shard_rows, so a reader can start
or resume anywhere with one seek. A shard is written under a name of its own and then
moved, so a task that runs again after a lost executor replaces it whole.

Defined cases: a null or empty text is the end id alone; repeated rows are written each;
an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, stored
from .text import bounded, ref, texts
from .tokens import byte_bpe, vocabulary

LENGTH = 2048
SHARD_ROWS = 2048
TASK_SHARDS = 4
ROUNDS = 6
SCHEMA = "slot long, number long, shard long, byte_offset long, n_tokens long, crc32 long"


def _round_keys(key: str) -> np.ndarray:
    digest = hashlib.sha512(key.encode("utf-8")).digest()
    return np.frombuffer(digest, "<u8")[:ROUNDS]


def permuted(numbers: np.ndarray, n: int, key: str) -> np.ndarray:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next even
    number of bits, walked along its cycle until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = _round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return left << np.uint64(half) | right

    out = once(np.asarray(numbers, np.uint64))
    while (far := out >= n).any():  # at most 4 values a valid one: the domain is below 4n
        out[far] = once(out[far])
    return out.astype(np.int64)


def _sequences(batches, path: str, length: int):
    """(ids of `length`, number of ids that are not padding) for one task's rows."""
    bpe = byte_bpe(path)
    end = np.array([bpe.size], np.uint32)
    rest = np.zeros(0, np.uint32)
    for whole in batches:
        for part in bounded(whole, "text"):
            ids, counts = bpe.encode([t.decode("utf-8") for t in texts(part.column("text"))])
            ids = np.insert(ids, np.cumsum(counts), end[0])
            rest = np.concatenate((rest, ids))
            n = len(rest) // length
            for row in rest[:n * length].reshape(n, length):
                yield row, length
            rest = rest[n * length:]
    if len(rest):
        yield np.concatenate((rest, np.repeat(end, length - len(rest)))), len(rest)


# a block of a task's consecutive sequences: the place of the first, and all their ids, compressed together
_BLOCKS = "part long, place long, n_tokens array<long>, ids binary"
BLOCK_ROWS = 500
_LEVEL = 6


def _cut(path: str, length: int):
    """A task's sequences, in order, block by block."""
    def run(batches):
        pack, part, done = zstandard.ZstdCompressor(level=_LEVEL), TaskContext.get().partitionId(), 0
        rows, sizes = [], []

        def block():
            raw = pack.compress(np.stack(rows).astype("<u2").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([done - len(rows)]), pa.array([sizes], pa.list_(pa.int64())), pa.array([raw])],
                ["part", "place", "n_tokens", "ids"])
        for row, n in _sequences(batches, path, length):
            rows.append(row)
            sizes.append(n)
            done += 1
            if len(rows) == BLOCK_ROWS:
                yield block()
                rows, sizes = [], []
        if rows:
            yield block()
    return run


def _numbered(length: int, shard_rows: int, key: str, firsts, total: int):
    """Blocks to sequences, each compressed, with their slots."""
    def run(batches):
        pack, unpack = zstandard.ZstdCompressor(level=_LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            for part, place, sizes, raw in zip(*[batch.column(c).to_pylist() for c in ("part", "place", "n_tokens", "ids")]):
                ids = np.frombuffer(unpack.decompress(raw), "<u2").reshape(-1, length)
                number = firsts.value[part] + place + np.arange(len(ids))
                slots = permuted(number, total, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(number), pa.array(slots // shard_rows), pa.array(sizes, pa.int64()),
                     pa.array([pack.compress(row.tobytes()) for row in ids], pa.binary())],
                    ["slot", "number", "shard", "n_tokens", "ids"])
    return run


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """For `file:/...`, `hdfs://...`, `s3://...` or a plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(uri: str, stride: int, shard_rows: int):
    def run(batches):
        store, root = filesystem(uri)
        store.create_dir(root, recursive=True)
        name, out, unpack = None, None, zstandard.ZstdDecompressor()

        def finish():
            if out is not None:
                out.close()
                store.move(f"{root}/{name}.{mark}", f"{root}/{name}")
        mark = uuid.uuid4().hex
        for batch in batches:
            crc = []
            for shard, slot, raw in zip(*[batch.column(c).to_pylist() for c in ("shard", "slot", "ids")]):
                if name != shard_name(shard):
                    finish()
                    name = shard_name(shard)
                    out = store.open_output_stream(f"{root}/{name}.{mark}")
                raw = unpack.decompress(raw)
                out.write(raw)
                crc.append(zlib.crc32(raw))
            slot = batch.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("number"), batch.column("shard"),
                 pa.array(slot % shard_rows * stride), batch.column("n_tokens"), pa.array(crc, pa.int64())],
                ["slot", "number", "shard", "byte_offset", "n_tokens", "crc32"])
        finish()
    return run


def write_in_order(docs: DataFrame, uri: str, key: str = "0", text_col: str = "text", path: str | None = None,
                   length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Stores the sequences, and writes the shards under `uri` when run; one row per sequence (SCHEMA)."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    if byte_bpe(path).size > 0xFFFF:
        raise ValueError("ids and the end id have to fit 16 bits")
    sequences = stored(docs.select(ref(text_col).alias("text")).mapInArrow(_cut(path, length), _BLOCKS))
    # one row a task reaches the driver
    counts = sorted((r.part, r.n) for r in sequences.groupBy("part").agg(F.sum(F.size("n_tokens")).alias("n")).collect())
    ends = np.cumsum([n for _, n in counts])
    total = int(ends[-1]) if counts else 0
    firsts = spark.sparkContext.broadcast({p: int(e - n) for (p, n), e in zip(counts, ends)})
    numbered = sequences.mapInArrow(_numbered(length, shard_rows, key, firsts, total),
                                    "slot long, number long, shard long, n_tokens long, ids binary")
    shards = -(-total // shard_rows)
    tasks = max(1, -(-shards // TASK_SHARDS))
    ranges = numbered.withColumn("range", (F.col("shard") * tasks / max(1, shards)).cast("int"))
    dealt = ranges.repartitionById(tasks, "range").drop("range").sortWithinPartitions("slot")
    return dealt.mapInArrow(_write(uri, 2 * length, shard_rows), SCHEMA)


def read_slots(uri: str, start: int, count: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS):
    """The ids of `count` slots from `start` on, shard after shard, one seek each."""
    store, root = filesystem(uri)
    while count > 0:
        shard, at = divmod(start, shard_rows)
        n = min(count, shard_rows - at)
        with store.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(at * 2 * length)
            raw = f.read(n * 2 * length)
        yield from np.frombuffer(raw, "<u2").reshape(-1, length)
        start, count = start + n, count - n


def order_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/order-{uuid.uuid4().hex}"
