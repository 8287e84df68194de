"""Nearest neighbours, tokenizer alignment and conversation repair against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualis.llm import align, neighbours, repair

EMPTY = hashlib.sha256(b"").hexdigest()


# --- op12 -------------------------------------------------------------------------------------

TEXTS = ["", None, "a", " ", "  a  b ", "x\n\ny \n z\t", "a▁b", "<s> </s> <|endoftext|> hi", "\x00a b", "é" * 50,
         "日本語 テスト 🎉", "\n", "a ", "Hello\r\nworld  \n", "<0x41> ok", "the cat sat. The cat sat.", "the cat sat. The cat sat.",
         "word " * 3000, "déjà vu " * 700, " ".join(f"w{i}" for i in range(900))]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer
    a_path, b_path = align._paths(None, None)
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path), align.json_byte_bpe(a_path).pieces


def brute_alignment(text, tokenizers):
    """(A ids, B ids, groups, links) from the tokenizers' own whole encodings."""
    a, b, a_bytes = tokenizers
    if not text:
        return [], [], "", []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xa = [a_bytes[i] for i in ia]
    xb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
        return [], [], "", []
    ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
    groups, i, j = [], 0, 0
    for c in sorted(set(ea) & set(eb)):
        p, q = ea.index(c) + 1, eb.index(c) + 1
        groups.append(",".join(map(str, ia[i:p])) + "|" + ",".join(map(str, ib[j:q])))
        i, j = p, q
    spans_b = list(zip([0, *eb], eb))
    links = []
    for n, (s, e) in enumerate(zip([0, *ea], ea)):
        links += [(n, m) for m, (s2, e2) in enumerate(spans_b) if s2 < e and s < e2]
    return ia, ib, ";".join(groups), links


def test_alignment(spark, tokenizers):
    docs = spark.createDataFrame([(i if i != 3 else None, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, slice int")
    expected = [brute_alignment(t, tokenizers) for t in TEXTS]
    found = align.aligned(docs).collect()
    by_id = {(r.doc_id if r.doc_id is not None else 3): r for r in found}
    counts = collections.Counter((e[0][i], e[1][j]) for e in expected for i, j in e[3])
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for n, (a, b, groups, links) in enumerate(expected):
        r = by_id[n]
        assert (r.a_ids, r.b_ids) == (a, b)
        assert list(zip(r.links_a, r.links_b)) == links
        assert len(r.a_cuts) == len(r.b_cuts) == (groups.count(";") + 1 if groups else 0)
    report = {(r.doc_id if r.doc_id is not None else 3): r for r in align.alignment_counts(docs).collect()}
    for n, (a, b, groups, links) in enumerate(expected):
        pairs = [(a[i], b[j]) for i, j in links]
        assert tuple(report[n])[1:] == (
            len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(counts[p] == best[p[1]] for p in pairs),
            sum(counts[p] for p in pairs), hashlib.sha256(groups.encode()).hexdigest() if groups else ""), TEXTS[n]


def test_alignment_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.alignment_counts(docs).collect() == [] and align.aligned(docs).collect() == []


def test_alignment_over_slices(spark, monkeypatch):
    """A text longer than a slice, and many slices, give what one slice gives."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (4000, 5, 0, 900, 900, 30)]
    a_path, b_path = align._paths(None, None)
    whole = align.align_texts([t.encode() for t in texts], a_path, b_path)
    one = [align.align_texts([t.encode()], a_path, b_path) for t in texts]
    sizes = (align.json_byte_bpe(a_path).size, align.piece_bpe(b_path).size)
    assert align.group_texts(whole, *sizes) == [g for x in one for g in align.group_texts(x, *sizes)]
    assert len(whole.link_a) == sum(len(x.link_a) for x in one)
    monkeypatch.setattr(align, "LANE", 1 << 40)
    undivided = align.align_texts([t.encode() for t in texts], a_path, b_path)
    assert (undivided.a_cut == whole.a_cut).all() and (undivided.b_cut == whole.b_cut).all()
    assert sorted(zip(undivided.link_a, undivided.link_b)) == sorted(zip(whole.link_a, whole.link_b))


# --- op13 -------------------------------------------------------------------------------------

_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute_repair(rows):
    """Whole strings kept per state, row after row: faults, illegal pairs, cost, audit and the repaired turns."""
    seen, faults = set(), []
    for r, t in rows:
        body = t.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (r, t) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, t))

    def closed(best):
        best = dict(best)
        for _ in range(3):
            for p, (c, a, o) in list(best.items()):
                for r, q in _NEXT[p].items():
                    if r != "s":
                        best[q] = min(best.get(q, (1 << 60, "", ())), (c + 5, a + "I", (*o, (r, ""))), key=lambda x: x[:2])
        return best
    best = {0: (0, "", ())}
    for (r, t), f in zip(rows, faults):
        new = {}

        def put(q, way):
            new[q] = min(new.get(q, way), way, key=lambda x: x[:2])
        for p, (c, a, o) in closed(best).items():
            put(p, (c + 2, a + "D", o))
            if f in ("", "truncated"):
                more = 5 * (f == "truncated")
                if r[:1] in _NEXT[p]:
                    put(_NEXT[p][r[:1]], (c + more, a + "K", (*o, (r, t))))
                for q0, q in _NEXT[p].items():
                    if q0 != "s":
                        put(q, (c + more + 1, a + "R", (*o, (q0, t))))
        best = new
    cost, audit, made = min(way for q, way in closed(best).items() if q in (0, 3))
    names = {"u": "user", "a": "assistant"}
    illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (*counts, illegal, cost, audit), [(names.get(r, r), t) for r, t in made]


def test_divide_and_conquer_core():
    rng = random.Random(5)
    for n in [*range(9)] * 60 + [60] * 10:
        rows = [(rng.choice(["system", "user", "assistant", "tool", "u", "a"]), f"{i}{rng.choice(['.', '', '!'])}") for i in range(n)]
        codes = bytes(2 * ("sua?".index(r[0]) if r[0] in "sua" else 3) + (t[-1] not in ".!?") for r, t in rows)
        cuts = [0, *sorted(rng.randint(0, n) for _ in range(rng.randint(0, 4))), n]
        blocks = [codes[i:j] for i, j in zip(cuts, cuts[1:])]
        ends, tail, cost = repair.crossings([repair.matrix(b) for b in blocks])
        audit, state = "", 0
        for block, end in zip(blocks, ends):
            audit += "".join(repair._MOVES[m] for m in repair.moves(block, state, end)[0])
            state = end
        assert (cost, audit + "I" * tail) == brute_repair(rows)[0][4:]


def _conversations():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "maybe", "", " \n", "ok?", "ok? \t", "…", "fine. "]
    rows = []
    for conv in [*range(40), None, 1000]:
        for n in range(rng.randint(0, 9) if conv != 1000 else 300):
            turn = rng.choice([n, n, n, n + 1, None]) if conv != 1000 else n
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "", "tool", None, "usr"]),
                         rng.choice([*texts, None, f"text {n}."])))
    rows += [(7, 1, "user", "Yes.")] * 3
    rows += [(2000, 3, "user", "same.")] * 500 + [(2001, 0, None, None)]
    return rows


def _expected(rows):
    order = {}
    for c, t, r, x in rows:
        order.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return order


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_repair(spark, partitions):
    """Also with conversations that lie in several blocks; rows of one turn are ordered by role and hash,
    so only conversations without such ties are compared row by row."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = _conversations()
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
        found = {r.conv_id: r for r in repair.repair_report(df).collect()}
        turns = collections.defaultdict(list)
        for r in repair.repair(df).turns().orderBy("pos", "n").collect():
            turns[r.conv_id].append((r.role, r.text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for conv, own in _expected(rows).items():
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        assert found[conv].gaps == gaps
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        if any(x[:2] == y[:2] and x != y for x, y in zip(own, own[1:])):
            continue
        counts, made = brute_repair([x[1:] for x in own])
        r = found[conv]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == counts, conv
        assert turns[conv] == made
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _ in made))
    assert len(found) == len(_expected(rows))


def test_repair_keeps_conversations_without_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x."), (2, 0, "user", "y."), (None, None, None, None)],
                                 "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in repair.repair_report(rows.where("conv_id = 1"), rows).collect()}
    assert tuple(found[2])[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY) and tuple(found[None])[1:] == tuple(found[2])[1:]
    assert (found[1].audit, found[1].cost) == ("D", 2)
    none = rows.where("false")
    assert repair.repair_report(none).collect() == [] and repair.repair(none).turns().collect() == []


def test_first_places_by_broadcast_and_by_join(spark, monkeypatch):
    rows = [(1, n, "user" if n % 2 == 0 else "assistant", "same." if n % 3 else f"{n // 6}.") for n in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = brute_repair([r[2:] for r in rows])[0]
    for share in (1, 10 ** 9):
        monkeypatch.setattr(repair, "HOT_SHARE", share)
        r = repair.repair_report(df).first()
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == expected


def test_damage(spark):
    import zlib
    rows = [(c, t, "assistant", "A. b! c? d") for c in range(60) for t in (0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if fault:
            expected.append((c, t, "user" if fault == 4 else r, {1: "", 2: "A b c d"}.get(fault, x), 2 if fault == 3 else 1))
    key = lambda r: (r[0], r[1] is None)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=key) == sorted(expected, key=key)


# --- op11 -------------------------------------------------------------------------------------

def _exact(rows, k, is_query):
    """(query row number) to its (id, distance) list by brute force over equal rows taken once."""
    rows = list(dict.fromkeys(rows))
    out = {}
    for n, (i, x) in enumerate(rows):
        if i is not None and is_query(i):
            d = [(float(np.sqrt(((np.array(y) - np.array(x)) ** 2).sum())), j is None, j) for m, (j, y) in enumerate(rows) if m != n]
            out.setdefault(i, []).append([(s, j) for s, _, j in sorted(d, key=lambda t: (t[0], t[1], t[2] or 0))[:k]])
    return out


def test_neighbours_exact_where_all_is_probed(spark):
    rng = np.random.default_rng(1)
    base = [tuple(rng.integers(-3, 4, 5).astype(float).tolist()) for _ in range(150)]
    rows = [(n, base[n % 130]) for n in range(260)] + [(None, base[5]), (100, base[9]), (100, base[9])]
    rows += [(1000 + n, base[0]) for n in range(60)]  # copies of one vector, beyond k + 1
    rows = [(i, v) for i, v in rows if any(v)]
    odd = [(300, None), (400, ()), (500, (0.0,) * 5), (600, (1.0, None, 1.0, 1.0, 1.0)), (700, (1.0, float("nan"), 1.0, 1.0, 1.0)),
           (800, (float("inf"), 0.0, 0.0, 0.0, 0.0)), (900, (1.0, 2.0))]
    table = spark.createDataFrame([(i, None if v is None else list(v), 1) for i, v in rows + odd],
                                  "vec_id long, embedding array<double>, rank int").repartition(7)
    for tile_bytes, chunk in ((1 << 20, 1 << 18), (40 * 8, 3)):
        found = {}
        got = neighbours.nearest_neighbours(table, F.col("id") % 50 == 0, k=10, partitions=1, tile_bytes=tile_bytes, chunk=chunk)
        for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
            found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        expected = _exact(rows, 10, lambda i: i % 50 == 0)
        assert set(found) == set(expected)
        for q, lists in expected.items():
            assert sorted(found[q], key=str) == sorted((x for one in lists for x in one), key=str), q
            if len(lists) == 1:
                assert found[q] == lists[0]


def test_neighbours_recall(spark):
    """Clusters and noise; every part of the vectors is probed only in part."""
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((60, 16))
    x = np.concatenate((centers[rng.integers(0, 60, 4000)] + 0.2 * rng.standard_normal((4000, 16)), rng.standard_normal((1000, 16))))
    table = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    router = neighbours.fit(x[rng.permutation(len(x))])
    assert router.partitions == 16 and router.probes < 16
    found = {}
    for r in neighbours.nearest_neighbours(table, F.col("id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & found[q])
    assert hit >= 0.9 * 10 * len(found)


def test_partitions_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.05 * rng.standard_normal((64, 4)) for c in 10 * rng.standard_normal((8, 4))])
    near = neighbours.nearest(x, x, 5, np.arange(len(x)))
    label = neighbours.balanced_partitions(near, 3)
    assert np.bincount(label).tolist() == [64] * 8
    assert (label[near] == label[:, None]).mean() > 0.9


def test_neighbours_of_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(empty, F.col("id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(one, F.col("id") % 100 == 0).collect() == []


def test_huge_components(spark):
    """Squares that overflow: compared by differences, in double precision."""
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 1.0]), (3, [1e200, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(table, F.col("id") == 0, k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (3, 3.0)]


# --- op3 --------------------------------------------------------------------------------------

def test_training_order_by_brute_force(spark, tmp_path):
    """One task: ids of all texts in a row, cut, permuted by a table of the Feistel network's values."""
    from qualis.llm import order
    texts = [None, "", "a b c", "the cat " * 200, "x\ny", "the cat " * 200, "é" * 90] * 5
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, slot int").coalesce(1)
    uri = str(tmp_path / "order")
    rows = {r.slot: r for r in order.write_in_order(docs, uri, key="k", length=32, shard_rows=4).collect()}
    encoding = order.byte_bpe(order.vocabulary("byte_bpe_50k.tiktoken")).encoding
    end = order.byte_bpe(order.vocabulary("byte_bpe_50k.tiktoken")).size
    ids = [i for t in texts for i in (*encoding.encode_ordinary(t or ""), end)]
    n = -(-len(ids) // 32)
    cut = [(ids[i * 32:i * 32 + 32] + [end] * 32)[:32] for i in range(n)]

    def network(x, half):  # one value at a time, in whole numbers
        keys = [int.from_bytes(hashlib.sha512(b"k").digest()[8 * i:8 * i + 8], "little") for i in range(order.ROUNDS)]
        left, right = x >> half, x & ((1 << half) - 1)
        for k in keys:
            f = (right + k) * 0x9E3779B97F4A7C15 % 2 ** 64
            f ^= f >> 29
            f = f * 0xBF58476D1CE4E5B9 % 2 ** 64
            f ^= f >> 32
            left, right = right, left ^ (f & ((1 << half) - 1))
        return left << half | right
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    slots = []
    for i in range(n):
        x = network(i, half)
        while x >= n:
            x = network(x, half)
        slots.append(x)
    assert sorted(slots) == list(range(n)) == sorted(rows)
    read = [x.tolist() for x in order.read_slots(uri, 0, n, length=32, shard_rows=4)]
    for i, s in enumerate(slots):
        assert rows[s].number == i and read[s] == cut[i]
        assert rows[s].n_tokens == (32 if i < n - 1 else len(ids) - 32 * (n - 1))
        assert (rows[s].shard, rows[s].byte_offset) == (s // 4, s % 4 * 64)


def test_ids_over_16_bits_are_refused(spark, tmp_path, monkeypatch):
    from qualis.llm import order
    monkeypatch.setattr(order.byte_bpe(order.vocabulary("byte_bpe_50k.tiktoken")), "size", 70000)
    with pytest.raises(ValueError, match="16 bits"):
        order.write_in_order(spark.createDataFrame([("a",)], "text string"), str(tmp_path / "x"))
