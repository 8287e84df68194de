"""Names that clash, repeated encodings, JSON with repeated names, dates, hot copies, first-seen values, stream windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qualis.functions.dates import parse_date_mixed
from qualis.operators import audit, clean, detect, fill, profile, summary
from qualis.streaming import missing_by_window, open_windows


CLASHING = ["_qblk", "_qo", "_qt", "_qpos", "_qh1", "_qs0", "_ql0", "_qc", "_qk", "_qr", "c1", "n", "m"]


def _clashing(spark):
    rows = [(i, float(i % 7) if i % 3 else None, i % 2) for i in range(30)] + [(30, 1.0, 1)]
    df = spark.createDataFrame(rows, "rid long, v double, w int")
    return df, df.select("*", *[F.col("w").alias(n) for n in CLASHING])


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_fills_keep_columns_of_any_name(spark, block):
    df, wide = _clashing(spark)
    for fn in (fill.forward_fill, fill.backward_fill, fill.interpolate):
        a = fn(df, ["v"], "rid", block).orderBy("rid").collect()
        b = fn(wide, ["v"], "rid", block).orderBy("rid").collect()
        assert [(r.rid, r.v) for r in a] == [(r.rid, r.v) for r in b]
        assert all(r[n] == r.w for r in b for n in CLASHING)


def test_one_block_and_many_give_the_same(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, rng.randint(0, 40)]), rng.choice([None, rng.random()]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v double, i int").repartition(3)
    for fn in (fill.forward_fill, fill.backward_fill, fill.interpolate):
        one, many = ({r.i: r.v for r in fn(df, ["v"], "k", n).collect()} for n in (1 << 20, 7))
        assert one == pytest.approx(many)


def test_dedup_missing_and_map_with_clashing_names(spark):
    _, wide = _clashing(spark)
    twice = wide.unionByName(wide)
    assert twice.columns == wide.columns
    for keep in ("first", "last"):
        out = fill.drop_duplicate_rows(twice, "rid", keep, ["v", "w"])
        assert out.columns == wide.columns and out.count() == wide.select("v", "w").distinct().count()
    missing = {r["column"]: r.n_missing for r in detect.missing_by_column(wide).collect()}
    assert missing["v"] == 10 and missing["n"] == 0 and len(missing) == len(wide.columns)
    assert summary.missing_map(wide, "rid", 10).where("column = 'v'").agg(F.sum("n_missing")).first()[0] == 10


def test_hot_copies_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 == 0 else f"v{i % 50}") for i in range(900)] + [(0, "hot"), (899, "v49"), (None, "hot"), (None, "only")] * 2
    df = spark.createDataFrame(rows, "rid long, s string").repartition(5)
    want = {}
    for keep in ("first", "last"):
        want[keep] = sorted(map(tuple, fill.drop_duplicate_rows(df, "rid", keep).collect()), key=str)
    monkeypatch.setattr(fill, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(fill, "HOT_GROUPS", 2)
    for keep in ("first", "last"):
        out = fill.drop_duplicate_rows(df, "rid", keep)
        assert sorted(map(tuple, out.collect()), key=str) == want[keep]
        assert len(want[keep]) == len({s for _, s in rows})


def test_frequency_encoding_twice(spark):
    df = spark.createDataFrame([("a", 9.0, 1), ("a", 9.0, 2), ("b", 9.0, 3), (None, 9.0, 4)], "c string, c_freq_enc double, _qs int")
    once = clean.frequency_encoding(df, ["c"])
    again = clean.frequency_encoding(once, ["c", "c"])
    for out in (once, again):
        assert out.columns == ["c", "_qs", "c_freq_enc"]
        assert {(r.c, r["_qs"], r.c_freq_enc and round(r.c_freq_enc, 9)) for r in out.collect()} == {
            ("a", 1, 0.666666667), ("a", 2, 0.666666667), ("b", 3, 0.333333333), (None, 4, None)}
    both = clean.frequency_encoding(once, ["c_freq_enc"])
    assert both.columns == ["c", "_qs", "c_freq_enc", "c_freq_enc_freq_enc"]


def test_json_with_repeated_names(spark):
    texts = ['{"a":1,"a":2}', '```json\n{"a":{"b":1,"b":[2]},"c":"é"}\n```', '{"a":1', "{'a':1}", '{"a":NaN,"a":1}', '{"a":1,"a":2}}', "[1]", None, "", '"\t"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cleaned long, r string")
    got = audit.parse_json_responses(df.withColumnRenamed("cleaned", "i"), "r", ["i"]).select(
        "i", "is_valid", F.to_json("parsed").alias("j")).orderBy("i").collect()
    assert [(bool(r.is_valid), r.j) for r in got] == [
        (True, '{"a":2}'), (True, '{"a":{"b":[2]},"c":"é"}'), (False, None), (False, None), (False, None), (False, None),
        (True, "[1]"), (False, None), (False, None), (False, None)]


@pytest.mark.parametrize("text,expected", [
    ("Jan 2024", "2024-01-01 00:00"), ("January 2024", "2024-01-01 00:00"), ("2024-01", "2024-01-01 00:00"), ("5-Jan-24", "2024-01-05 00:00"),
    ("1/5/24", "2024-01-05 00:00"), ("5th Jan 2024", "2024-01-05 00:00"), ("2024 Jan 5", "2024-01-05 00:00"),
    ("Fri, 05 Jan 2024", "2024-01-05 00:00"), ("2024-01-05 10:00:00 UTC", "2024-01-05 10:00"), ("jan 5, 2024", "2024-01-05 00:00"),
    ("MARCH 3 2023", "2023-03-03 00:00"), ("2024-01-05T10:00:00Z", "2024-01-05 10:00"), ("hello", None), ("12-3456", None), ("May be", None)])
def test_dates(spark, text, expected):
    got = spark.range(1).select(F.date_format(parse_date_mixed(F.lit(text)), "yyyy-MM-dd HH:mm")).first()[0]
    assert got == expected


def test_time_of_day_is_a_date(spark):
    assert spark.range(1).select(parse_date_mixed(F.lit("10:30")).isNotNull()).first()[0]


def test_first_seen_values(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, rng.randint(0, 3000)]), rng.choice(["x", "y"]) if i > 700 else "x", None if rng.random() < 0.9 else i % 40, float(i % 3), "z" * 50)
            for i in range(900)]
    df = spark.createDataFrame(rows, "rid int, late string, sparse int, d double, long string").repartition(4)
    cols = ["late", "sparse", "d", "long"]

    def brute(k):
        out = {}
        for j, c in enumerate(cols, 1):
            first = {}
            for r in rows:
                if r[j] is not None:
                    key = (r[0] is not None, r[0] or 0)
                    v = str(r[j])
                    first[v] = min(first.get(v, key), key)
            out[c] = [v for v, _ in sorted(first.items(), key=lambda x: (x[1], x[0]))][:k]
        return out
    for prefix in (1, 20, 10000):
        monkeypatch.setattr(profile, "PREFIX_ROWS", prefix)
        got = {r["column"]: r.samples for r in profile.profile_samples(df, order_by="rid", k=4).collect()}
        assert got == brute(4), prefix
    none = {r["column"]: r.samples for r in profile.profile_samples(df.limit(0), order_by="rid").collect()}
    assert none == {c: [] for c in cols}


def test_open_windows_complete_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", None if (h + m) % 4 else 1) for h in range(10) for m in (0, 20, 40)]
    df = spark.createDataFrame(rows, "t string, n int").select(F.to_timestamp("t").alias("t"), "n")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = missing_by_window(stream, "t", "1 hour", "1 hour", ["n"])
    q = (out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    closed = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    assert 0 < closed.count() < 10
    whole = closed.unionByName(open_windows(closed, df, "t", "1 hour", ["n"])).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n_rows) for r in whole] == [(h, 3) for h in range(10)]
    nothing = closed.limit(0)
    assert open_windows(nothing, df, "t", "1 hour", ["n"]).count() == 10


def test_dashboard_chooses_columns_by_class(spark):
    df = spark.createDataFrame([(i, f"u{i}", i % 5, i % 7 * 0.5, "a" if i % 3 else "b", f"2024-01-{1 + i % 28:02d}") for i in range(60)],
                               "cust_id long, code string, qty int, price double, kind string, day string")
    d = summary.dashboard(df)
    assert (d.numerical, d.categorical) == (["qty", "price"], ["kind"])
    assert {r["column"] for r in d.box.collect()} == {"qty", "price"} and d.correlation.count() == 4
    assert [(r.value, r["count"]) for r in d.categories.collect()] == [("a", 40), ("b", 20)] and d.histogram.count() == 30
    text = summary.dashboard(df.select("kind"))
    assert text.numerical == [] and text.box is None and text.correlation is None and text.histogram is None
    assert summary.dashboard(df.select("cust_id", "day")).categories is None
