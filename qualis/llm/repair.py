"""Conversation structure repair: the cheapest edits that make the roles `(s?(ua)+)?`.

Edits of a row are Keep (0; 5 for a truncated row), Rerole to user or assistant (1; 6 for a
truncated row) and Delete (2; needed for blank and duplicate rows); an empty user or assistant
turn can be Inserted anywhere (5). The roles are read by an automaton of four states: at the
start, after a system turn, after a user turn, after an assistant turn; the first and the last
are accepted. Of all cheapest edits those whose initials, in order, are the least string count.

Hirschberg divide and conquer: a forward vector (from the left end's state) and a backward
vector (from the right end's state) of four costs meet in the middle of a piece, after a row's
own edit; of the states with the least sum the one is chosen whose edits so far are the
least string, and both halves are solved alike, without a table of all rows by states. To
compare these strings, the forward vector carries the rank of each state's string: two of them
never begin one another (both end with an edit of the same row), so later edits do not change
their order. Rows that have to be deleted do not move the state; an insertion beside them comes
after them (D is before I).

Long conversations: rows are ranged by (conversation, order), so a conversation of any length
lies in as many blocks as it takes. A block is solved for each of the four states it may be
entered in (a 4 x 4 cost matrix with ranks), the crossing states at block ends are chosen by the
same divide and conquer over the blocks' matrices, and then every block is repaired on its
own. Equal rows (conversation, turn, role and text) are one row with a number of copies.

Order of a conversation's rows: turn (nulls first), then role, then a hash of the text.

Defined cases: a null turn, role or text counts as one blank; null conversation ids are one
conversation; an empty role cannot be kept; a table without rows gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored

FAR = 1 << 40  # no way
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
STARTS = (0, FAR, FAR, FAR)
_AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_REROLED = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after the only role that may come: also an insertion
_CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}  # insertions needed after the last row
_MOVES = ("D", "IIK", "IIR", "IK", "IR", "K", "R")  # in string order
_CLASSES = ("s", "u", "a", "?")
HOT_SHARE = 1000  # keys with over 1 / HOT_SHARE of the rows are joined by broadcast

SPACE = " \t\n\x0b\f\r"


@cache
def _table(code: int) -> tuple:
    """(state before, state after, cost, number in _MOVES) of a live row: the best move of each pair."""
    role, truncated = _CLASSES[code >> 1], code & 1
    best: dict = {}
    for p in range(4):
        q = p
        best[p, p] = (DELETE, 0)
        for inserted in range(3):
            marks, cost = "I" * inserted, INSERT * inserted + TRUNCATED * truncated
            ways = [(q_, cost, marks + "K") for r, q_ in _AFTER[q].items() if r == role]
            for after, c, edits in (*ways, (_REROLED[q], cost + REROLE, marks + "R")):
                best[p, after] = min(best.get((p, after), (FAR, 0)), (c, _MOVES.index(edits)))
            q = _REROLED[q]
    return tuple((p, q, c, m) for (p, q), (c, m) in sorted(best.items()))


def _normal(costs, ranks):
    low = min(costs)
    return low, (tuple(c - low if c < FAR else FAR for c in costs), tuple(ranks))


def _joined(vector, ways):
    """The vector after one of `ways` (before, after, cost, rank among equal befores)."""
    costs, ranks = vector
    best = [(FAR, 9, 0)] * 4
    for p, q, c, m in ways:
        if costs[p] < FAR:
            best[q] = min(best[q], (costs[p] + c, ranks[p], m))
    order = sorted(range(4), key=lambda q: best[q][1:])
    return _normal([b[0] for b in best], [order.index(q) for q in range(4)])


@cache
def _forward(vector, code: int):
    """The next (least cost, vector less it) of costs and ranks; there are few vectors."""
    return _joined(vector, _table(code))


@cache
def _backward(costs, code: int):
    best = [FAR] * 4
    for p, q, c, _ in _table(code):
        if costs[q] < FAR:
            best[p] = min(best[p], costs[q] + c)
    low = min(best)
    return tuple(b - low if b < FAR else FAR for b in best)


def _unit(state: int) -> tuple:
    return tuple(0 if q == state else FAR for q in range(4))


def _crossing(vector, costs) -> int:
    """The state with the least sum; of equal ones the one of the least string."""
    return min(range(4), key=lambda q: (vector[0][q] + costs[q], vector[1][q]))


def matrix(codes: bytes) -> tuple[list[int], list[int]]:
    """Costs and ranks [from state, to state] of a block's live rows."""
    costs, ranks = [], []
    for p in range(4):
        total, vector = 0, (_unit(p), (0, 0, 0, 0))
        for code in codes:
            low, vector = _forward(vector, code)
            total += low
        costs += [c + total if c < FAR else FAR for c in vector[0]]
        ranks += vector[1]
    return costs, ranks


def moves(codes: bytes, first: int, last: int) -> tuple[bytes, list[int]]:
    """The edits (numbers in _MOVES) of live rows from one state to another, and the state before each row."""
    out, states = bytearray(len(codes)), [0] * len(codes)
    pieces = [(0, len(codes), first, last)]
    while pieces:
        lo, hi, p, q = pieces.pop()
        if hi - lo <= 1:
            if hi > lo:
                out[lo] = next(m for a, b, _, m in _table(codes[lo]) if (a, b) == (p, q))
                states[lo] = p
            continue
        mid = (lo + hi) // 2
        vector = (_unit(p), (0, 0, 0, 0))
        for code in codes[lo:mid]:
            vector = _forward(vector, code)[1]
        costs = _unit(q)
        for code in codes[mid:hi][::-1]:
            costs = _backward(costs, code)
        at = _crossing(vector, costs)
        pieces += [(lo, mid, p, at), (mid, hi, at, q)]
    return bytes(out), states


def _through(blocks, vector):
    total = 0
    for costs, ranks in blocks:
        low, vector = _joined(vector, [(p, q, costs[4 * p + q], ranks[4 * p + q]) for p in range(4)
                                       for q in range(4) if costs[4 * p + q] < FAR])
        total += low
    return total, vector


def crossings(blocks: list) -> tuple[list[int], int, int]:
    """From the matrices of a conversation's blocks: the state at each block's end, the insertions after the
    last row and the cost."""
    total, vector = _through(blocks, (STARTS, (0, 0, 0, 0)))
    last = min(range(4), key=lambda q: (vector[0][q] + INSERT * _CLOSING[q], vector[1][q]))
    cost = total + vector[0][last] + INSERT * _CLOSING[last]
    ends, pieces = [last] * len(blocks), [(0, len(blocks), 0, last)]
    while pieces:
        lo, hi, p, q = pieces.pop()
        if hi - lo <= 1:
            continue
        mid = (lo + hi) // 2
        _, left = _through(blocks[lo:mid], (_unit(p), (0, 0, 0, 0)))
        costs = _unit(q)
        for matrix_, _ in reversed(blocks[mid:hi]):
            costs = tuple(min(min(matrix_[4 * a + b] + costs[b] for b in range(4)), FAR) for a in range(4))
        ends[mid - 1] = at = _crossing(left, costs)
        pieces += [(lo, mid, p, at), (mid, hi, at, q)]
    return ends, _CLOSING[last], cost


# --- on Spark ---------------------------------------------------------------------------------

def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows changed by crc32('conv_id:turn') % 20 (a null is one
    blank): 0 drops the row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes its role user."""
    key = F.concat(_blank(F.col("conv_id").cast("string")), F.lit(":"), _blank(F.col("turn").cast("string")))
    fault = F.crc32(key.cast("binary")) % 20
    text = _blank(F.col("text"))
    return rows.withColumn("fault", fault).where("fault <> 0").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(F.col("fault") == 4, "user").otherwise(_blank(F.col("role"))).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text)
        .alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


_ROW, _SAID = ("k1", "k2"), ("s1", "s2")


def _hashed(rows: DataFrame) -> DataFrame:
    """Adds 128-bit hashes of (conversation, turn, role, text) and of (conversation, role, text)."""
    conv, turn = ("conv_id", F.col("conv_id").isNull()), ("turn", F.col("turn").isNull())
    out = rows
    for names, parts in ((_ROW, (*conv, *turn, "role", "text")), (_SAID, (*conv, "role", "text"))):
        for seed, name in enumerate(names):
            out = out.withColumn(name, F.xxhash64(F.lit(seed), *parts))
    return out


def _skeleton(rows: DataFrame) -> DataFrame:
    """One row per different row, without its text: conv_id, turn, the initial of its role, hashes, copies, pos
    (its place in the table's order) and part (a range of places)."""
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    first = F.left(F.col("role"), F.lit(1))
    keyed = _hashed(rows).select(*_ROW, "conv_id", "turn", "role", *_SAID, "copies", (end == "").alias("is_blank"),
                                 (~end.isin(".", "!", "?")).alias("open"))
    others = [c for c in keyed.columns if c not in (*_ROW, "copies")]
    same = keyed.groupBy(*_ROW).agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in others])
    order = ["conv_id", "turn", "role", *_ROW]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = same.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("initial", F.when(first == "", "?").otherwise(first)).drop("role")
                  .withColumn("pos", F.monotonically_increasing_id())
                  .withColumn("part", F.shiftright("pos", 33)))


def _with_live(skeleton: DataFrame) -> DataFrame:
    """Adds `live`: neither blank nor said before (same role and text at an earlier place); only the first of a
    row's copies is. The first places of what is said at several places are joined: those of over
    1 / HOT_SHARE of the rows (at most so many) by broadcast, the others by a shuffle."""
    again = stored(skeleton.groupBy(*_SAID).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = skeleton.count()
    hot = again.where(F.col("n") * HOT_SHARE > total).select(*_SAID, F.col("first").alias("hot_first"))
    rest = again.where(F.col("n") * HOT_SHARE <= total).select(*_SAID, "first")
    found = skeleton.join(F.broadcast(hot), list(_SAID), "left")
    out = (found.where("hot_first IS NOT NULL").withColumn("first", F.col("hot_first"))
           .unionByName(found.where("hot_first IS NULL").join(rest, list(_SAID), "left")))
    live = ~F.col("is_blank") & (F.coalesce("first", "pos") == F.col("pos"))
    return out.withColumn("live", live).drop("hot_first", "first", *_SAID)


_BLOCK = ("conv_id long, part long, codes binary, places binary, costs array<long>, ranks array<long>, illegal long, "
          "left string, right string, last_pos long")
_BLOCK_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                pa.int64(), pa.string(), pa.string(), pa.int64()]
_LEGAL = ("su", "ua", "au")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(rows: list, types: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _names(schema))


def _pack(batches):
    """Rows sorted by (conv_id, part, pos) to one row per block: its live rows (classes and places) and its matrix."""
    key, held, done = None, [], []

    def block():
        codes, places, initials = (b"".join(h[0] for h in held), b"".join(h[1] for h in held),
                                   "".join(h[2] for h in held))
        illegal = sum(h[3] for h in held) - 1 - sum(map(initials.count, _LEGAL))
        return (*key, codes, places, *matrix(codes), illegal, initials[0], initials[-1], held[-1][4])

    for batch in batches:
        keys = list(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist()))
        initial = batch.column("initial").to_pylist()
        copies, pos = batch.column("copies").to_numpy(), batch.column("pos").to_numpy()
        live = batch.column("live").to_numpy(zero_copy_only=False)
        code = batch.column("code").to_numpy().astype(np.uint8)
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for i, j in zip(cuts, [*cuts[1:], len(keys)]):
            if held and keys[i] != key:
                done.append(block())
                held = []
            key, on = keys[i], live[i:j]
            held.append((code[i:j][on].tobytes(), pos[i:j][on].tobytes(), "".join(initial[i:j]),
                         int(copies[i:j].sum()), int(pos[j - 1])))
        if len(done) >= 1000:
            yield _batch(done, _BLOCK_TYPES, _BLOCK)
            done = []
    if held:
        done.append(block())
    if done:
        yield _batch(done, _BLOCK_TYPES, _BLOCK)


_ENDS = "conv_id long, part long, enter long, leave long, tail long, cost long, illegal long"


def _ends(batches):
    """Blocks sorted by (conv_id, part), without their rows, to the states at their ends. A conversation has at most
    as many blocks as the table has parts."""
    key, held, done = None, [], []

    def conversation():
        ends, tail, cost = crossings([(h[1], h[2]) for h in held])
        for n, (part, _, _, illegal, left, right) in enumerate(held):
            at_end = n == len(held) - 1
            between = not at_end and right + held[n + 1][4] not in _LEGAL
            yield (key, part, ends[n - 1] if n else 0, ends[n], tail if at_end else 0, cost if at_end else 0,
                   illegal + between)

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != key:
                done += conversation()
                held = []
            key = row["conv_id"]
            held.append((row["part"], row["costs"], row["ranks"], row["illegal"], row["left"], row["right"]))
        if len(done) >= 1000:
            yield _batch(done, [pa.int64()] * 7, _ENDS)
            done = []
    if held:
        done += conversation()
    if done:
        yield _batch(done, [pa.int64()] * 7, _ENDS)


_EDITS = "pos long, edits string, made string, tail long"
_NEW = {2: "u", 3: "a"}


def _made(edits: str, state: int) -> tuple[str, int]:
    """The turns that edits make: k (the row's own), U or A (its role changed), u or a (inserted)."""
    out = ""
    for e in edits:
        after = _REROLED[state]
        if e == "K":
            out += "k"
        elif e == "I":
            out, state = out + _NEW[after], after
        elif e == "R":
            out, state = out + _NEW[after].upper(), after
    return out, state


@cache
def _made_by(move: int, state: int) -> str:
    return _made(_MOVES[move], state)[0]


def _solve(batch_rows: int):
    def run(batches):
        types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                places = np.frombuffer(row["places"], np.int64).tolist()
                found, states = moves(row["codes"], row["enter"], row["leave"])
                out += [(p, _MOVES[m], _made_by(m, s), 0) for p, m, s in zip(places, found, states)]
                if row["tail"]:
                    new = _made("I" * row["tail"], row["leave"])[0]
                    if out and out[-1][0] == row["last_pos"]:
                        p, edits, made, _ = out.pop()
                        out.append((p, edits, made + new, row["tail"]))
                    else:
                        out.append((row["last_pos"], "", new, row["tail"]))
                while len(out) >= batch_rows:
                    yield _batch(out[:batch_rows], types, _EDITS)
                    out = out[batch_rows:]
            if out:
                yield _batch(out, types, _EDITS)
    return run


class Repair:
    """The repair of turn rows (conv_id, turn, role, text, copies), stored step by step:

    `skeleton`: one row per different row: pos, conv_id, turn, copies, live, is_blank, open;
    `ends`: one row per block: tail (insertions at the conversation's end), cost (of its live
    rows' edits, in its last block), illegal; `edits`: pos, the edits of the row and the turns they make."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        code = 2 * F.coalesce(F.array_position(F.array(*map(F.lit, _CLASSES)), F.col("initial")).cast("int"),
                              F.lit(0)) - 2
        code = F.when(code < 0, 6).otherwise(code) + F.col("open").cast("int")
        self.skeleton = stored(_with_live(_skeleton(rows)).withColumn("code", code.cast("int")))
        by_place = self.skeleton.select("conv_id", "part", "pos", "initial", "copies", "live", "code")
        blocks = stored(by_place.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
                        .mapInArrow(_pack, _BLOCK))
        matrices = blocks.select("conv_id", "part", "costs", "ranks", "illegal", "left", "right")
        self.ends = stored(matrices.repartition("conv_id").sortWithinPartitions("conv_id", "part")
                           .mapInArrow(_ends, _ENDS))
        # the first place of a block names it: part, and the conversation
        e = self.ends.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "enter", "leave", "tail")
        solved = blocks.join(e, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
        edits = solved.select("codes", "places", "last_pos", "enter", "leave", "tail").mapInArrow(_solve(10000), _EDITS)
        left = self.skeleton.select("pos", "conv_id", *_ROW, "copies", "live")
        deleted = F.repeat(F.lit("D"), (F.col("copies") - F.col("live").cast("long")).cast("int"))
        self.edits = left.join(edits, "pos", "left").select(
            "pos", "conv_id", *_ROW, F.coalesce("made", F.lit("")).alias("made"),
            F.concat(F.coalesce("edits", F.lit("")), deleted,
                     F.repeat(F.lit("I"), F.coalesce("tail", F.lit(0)).cast("int"))).alias("edits"))

    def with_texts(self) -> DataFrame:
        """`edits` with the role and text of each row. Copies of a text are one row before the shuffle."""
        once = _hashed(self.rows).groupBy(*_ROW).agg(F.first("role").alias("role"), F.first("text").alias("text"))
        return self.edits.join(once, list(_ROW)).drop(*_ROW)

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, pos, n (among the turns of one place, from 0), edit (K, R or I), role, text."""
        made = self.with_texts().select("conv_id", "pos", "role", "text",
                                        F.posexplode(F.split("made", "")).alias("n", "m")).where("m <> ''")
        m = F.col("m")
        return made.select(
            "conv_id", "pos", "n", F.when(m == "k", "K").when(m.isin("U", "A"), "R").otherwise("I").alias("edit"),
            F.when(m == "k", F.col("role")).when(F.lower(m) == "u", "user").otherwise("assistant").alias("role"),
            F.when(m.isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def _digest(batches):
    """Rows sorted by (conv_id, pos): the edits and the hash of the repaired turns of each conversation. A hash is
    serial, so a conversation's turns pass through one task, row by row."""
    key, audit, sha, any_turn = None, None, None, False
    done = []
    for batch in batches:
        for conv, edits, made, role, text in zip(*[batch.column(c).to_pylist()
                                                   for c in ("conv_id", "edits", "made", "role", "text")]):
            if audit is None or conv != key:
                if audit is not None:
                    done.append((key, "".join(audit), sha.hexdigest()))
                key, audit, sha, any_turn = conv, [], hashlib.sha256(), False
            audit.append(edits)
            for m in made:
                turn = f"{role if m == 'k' else 'user' if m in 'uU' else 'assistant'}:{'' if m in 'ua' else text}"
                sha.update(((chr(10) if any_turn else "") + turn).encode("utf-8"))
                any_turn = True
        if len(done) >= 1000:
            yield _batch(done, [pa.int64(), pa.string(), pa.string()], "conv_id long, audit string, sha string")
            done = []
    if audit is not None:
        done.append((key, "".join(audit), sha.hexdigest()))
        yield _batch(done, [pa.int64(), pa.string(), pa.string()], "conv_id long, audit string, sha string")


def repair(rows: DataFrame) -> Repair:
    """The repair of rows with columns conv_id, turn, role, text (and copies, else 1)."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    return Repair(rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _blank(F.col("role")).alias("role"), _blank(F.col("text")).alias("text"), copies.alias("copies")))


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation of `conversations` (else of the rows): gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256 (of `role:text`, joined by line feeds)."""
    fixed = repair(rows)
    s = fixed.skeleton
    extra = F.col("copies") - F.col("live").cast("long")
    by_turn = s.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("is_blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("is_blank"), 0).otherwise(extra)).alias("duplicate"),
        F.sum((F.col("live") & F.col("open")).cast("long")).alias("truncated"), F.sum(extra * DELETE).alias("cost"))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = by_turn.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *[
        F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")])
    ends = fixed.ends.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    told = (fixed.with_texts().repartition("conv_id").sortWithinPartitions("conv_id", "pos")
            .select("conv_id", "edits", "made", "role", "text")
            .mapInArrow(_digest, "conv_id long, audit string, sha string"))
    all_ids = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long").alias("conv_id"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = [all_ids.distinct(), counts, ends, told]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy("conv_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
