import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from qualis.operators import clean, fill

from .conftest import rows_of

GAPPY = [None, 1.0, None, None, 4.0, None]


def _series(spark, values, rid_step=1):
    return spark.createDataFrame([(i * rid_step, v) for i, v in enumerate(values)], "rid long, x double")


def _col(df, name="x"):
    return [r[0] for r in df.orderBy("rid").select(name).collect()]


def _same(a, b):
    return all((x is None and (y is None or (isinstance(y, float) and math.isnan(y))))
               or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-12))
               for x, y in zip(a, b)) and len(a) == len(b)


@pytest.mark.parametrize("block", [1, 2, 4, 1 << 20])
def test_fills_hand_table(spark, block):
    df = _series(spark, GAPPY, rid_step=3)
    assert _col(fill.forward_fill(df, ["x"], "rid", block)) == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert _col(fill.backward_fill(df, ["x"], "rid", block)) == [1.0, 1.0, 4.0, 4.0, 4.0, None]
    assert _col(fill.interpolate(df, ["x"], "rid", block)) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_fills_match_pandas_across_blocks(spark):
    rng = np.random.default_rng(7)
    n = 2000
    vals = rng.normal(size=n)
    vals[rng.random(n) < 0.5] = np.nan
    vals[300:900] = np.nan  # a null run spanning several blocks
    rids = np.sort(rng.choice(50_000, n, replace=False))
    pdf = pd.DataFrame({"rid": rids, "x": vals})
    df = spark.createDataFrame(pdf)
    for block in (64, 500):
        assert _same(_col(fill.forward_fill(df, ["x"], "rid", block)), list(pdf.x.ffill()))
        assert _same(_col(fill.backward_fill(df, ["x"], "rid", block)), list(pdf.x.bfill()))
        want = list(pdf.x.interpolate(method="linear", limit_direction="both"))
        assert _same(_col(fill.interpolate(df, ["x"], "rid", block)), want)


def test_fill_text_column_forward(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "rid int, s string")
    assert _col(clean.forward_fill(df, ["s"], order_by="rid"), "s") == ["a", "a", "b", "b"]
    with pytest.raises(ValueError):
        clean.forward_fill(df, ["s"])


def test_median_mean_mode(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, None), (6, float("nan"))],
                               "rid int, x double")
    assert _col(clean.fill_median(df, ["x"])) == [1.0, 2.0, 3.0, 4.0, 2.5, 2.5]
    assert _col(clean.fill_mean(df, ["x"])) == [1.0, 2.0, 3.0, 4.0, 2.5, 2.5]
    ints = spark.createDataFrame([(1, 1), (2, None), (3, 4)], "rid int, x int")
    out = clean.fill_median(ints, ["x"])
    assert dict(out.dtypes)["x"] == "double" and _col(out) == [1.0, 2.5, 4.0]
    s = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "rid int, x string")
    assert _col(clean.fill_mode(s, ["x"])) == ["b", "a", "b", "a", "a"]
    empty = spark.createDataFrame([(1, None), (2, None)], "rid int, x string")
    assert _col(clean.fill_mode(empty, ["x"])) == [None, None]
    text = spark.createDataFrame([(1, "t")], "rid int, x string")
    assert _col(clean.fill_median(text, ["x"])) == ["t"]  # non-numeric left as is


def test_text_steps_keep_nulls(spark):
    df = spark.createDataFrame([(1, "  New   york "), (2, None), (3, "o'neil 3rd")], "rid int, x string")
    assert _col(clean.trim_spaces(df, ["x"])) == ["New york", None, "o'neil 3rd"]
    assert _col(clean.lower_case(df, ["x"])) == ["  new   york ", None, "o'neil 3rd"]
    assert _col(clean.upper_case(df, ["x"])) == ["  NEW   YORK ", None, "O'NEIL 3RD"]
    assert _col(clean.title_case(df, ["x"])) == ["New   York", None, "O'Neil 3Rd"]
    assert _col(clean.remove_all_whitespace(df, ["x"])) == ["Newyork", None, "o'neil3rd"]


def test_type_conversions(spark):
    df = spark.createDataFrame([(1, " 12 "), (2, "abc"), (3, None), (4, "1e5")], "rid int, x string")
    out = clean.convert_to_numeric(df, ["x"])
    assert dict(out.dtypes)["x"] == "double" and _col(out) == [12.0, None, None, 100000.0]
    nums = spark.createDataFrame([(1, 1.5), (2, None)], "rid int, x double")
    assert _col(clean.convert_to_string(nums, ["x"])) == ["1.5", None]
    assert _col(clean.convert_to_string(nums, ["x"], null_text="nan")) == ["1.5", "nan"]


def test_frequency_encoding_shares_of_non_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "rid int, x string")
    out = clean.frequency_encoding(df, ["x"])
    assert out.columns == ["rid", "x", "x_freq_enc"]
    got = _col(out, "x_freq_enc")
    assert got[:3] == [2 / 3, 2 / 3, 1 / 3] and got[3] is None


def test_drop_steps(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", None), (4, "a", 1.0)],
                               "rid int, s string, x double")
    assert rows_of(clean.drop_rows(df, ["x"]), "rid") == [(1, "a", 1.0), (2, "a", 1.0), (4, "a", 1.0)]
    assert clean.drop_columns(df, ["x", "missing"]).columns == ["rid", "s"]
    first = clean.drop_duplicate_rows(df, [], order_by="rid")
    last = clean.drop_duplicate_rows_keep_last(df, [], order_by="rid")
    assert rows_of(first, "rid") == [(1, "a", 1.0), (3, "b", None)]
    assert rows_of(last, "rid") == [(3, "b", None), (4, "a", 1.0)]
    # idempotent
    assert rows_of(clean.drop_duplicate_rows(first, [], order_by="rid"), "rid") == rows_of(first, "rid")
    assert clean.drop_duplicate_rows(df.drop("rid"), []).count() == 2


def test_unknown_and_unregistered_methods(spark):
    df = spark.createDataFrame([(1,)], "a int")
    for name in ("rename_and_keep", "target_encoding", "nope"):
        with pytest.raises(KeyError):
            clean.apply_method(df, name, ["a"])
    assert clean.apply_method(df, "keep_as_identifier", ["a"]).collect() == df.collect()
    assert clean.apply_method(df, "review_manually", ["a"]).collect() == df.collect()


def test_wide_dedup_prescreen_matches_grouping(spark):
    from pyspark.sql import functions as F
    base = spark.range(3000).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("a"),  # hot copy group
        F.lit("x").alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5)).alias("c"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("d"),
        F.lit(None).cast("string").alias("e"),
        F.when(F.col("id") % 3 == 0, F.lit(2)).otherwise(F.col("id")).alias("f"))
    keys = ["a", "b", "c", "d", "e", "f"]
    for keep, pick in (("first", F.min), ("last", F.max)):
        got = fill.drop_duplicate_rows(base, "rid", keep)
        want = base.groupBy(*keys).agg(pick("rid").alias("rid")).select(*base.columns)
        assert repr(rows_of(got, "rid")) == repr(rows_of(want, "rid"))  # NaN-safe
    # no copies at all: the table comes back as it is
    uniq = base.where(F.col("id") % 3 != 0)
    assert repr(rows_of(fill.drop_duplicate_rows(uniq, "rid"), "rid")) == repr(rows_of(uniq, "rid"))


def test_frequency_encoding_split_path_matches(spark, monkeypatch):
    from pyspark.sql import functions as F
    df = spark.range(5000).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("v"), (F.col("id") % 900).cast("string"))).alias("x"))
    small = rows_of(clean.frequency_encoding(df, ["x"]), "rid")
    monkeypatch.setattr(clean, "BROADCAST_DISTINCT", 0)  # force the hot / cold split
    split = rows_of(clean.frequency_encoding(df, ["x"]), "rid")
    assert split == small
    # 1667 rows hold "hot"; 476 rows are null (multiples of 7 not of 3), so 4524 count
    assert [r for r in split if r[1] == "hot"][0][2] == 1667 / 4524


def test_fills_ordered_by_timestamp(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=7 * i), v) for i, v in enumerate(GAPPY)]
    for kind in ("timestamp", "timestamp_ntz", "date"):
        df = spark.createDataFrame(rows, "t timestamp, x double").selectExpr(f"cast(t as {kind}) t", "x")
        if kind == "date":  # one row per day
            df = spark.createDataFrame([(t0.date() + dt.timedelta(days=i), v) for i, v in enumerate(GAPPY)],
                                       "t date, x double")
        got = [r[0] for r in fill.forward_fill(df, ["x"], "t", 2).orderBy("t").select("x").collect()]
        assert got == [None, 1.0, 1.0, 1.0, 4.0, 4.0], kind
        got = [r[0] for r in fill.interpolate(df, ["x"], "t", 2).orderBy("t").select("x").collect()]
        assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0], kind


def _by_order(df, key):
    """The rows in the order of the fills: key (nulls first), then the tie hash."""
    from qualis.operators.stats import row_hashes
    return df.select("*", row_hashes(df, df.columns)[0].alias("_h")).orderBy(key, "_h").toPandas()


def test_fills_with_skewed_tied_and_null_keys(spark):
    rng = np.random.default_rng(11)
    n = 3000
    key = np.where(np.arange(n) % 3 == 0, 5, np.arange(n) // 4)          # a third of the rows on one key
    key = np.where(np.arange(n) % 10 == 1, key + 10 ** 12, key)          # and a far-off cluster
    rows = [(i, None if i % 17 == 0 else int(key[i]), None if rng.random() < 0.6 else float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, k long, x double")
    pdf = _by_order(df, "k")
    for block in (100, 700):
        blocks = [r["n"] for r in fill._ordered(df, "k", block).groupBy("_qblk").agg(
            F.count(F.lit(1)).alias("n")).collect()]
        assert max(blocks) <= 2 * block and sum(blocks) == n
        for got, want in ((fill.forward_fill(df, ["x"], "k", block), pdf.x.ffill()),
                          (fill.backward_fill(df, ["x"], "k", block), pdf.x.bfill()),
                          (fill.interpolate(df, ["x"], "k", block),
                           pdf.x.interpolate(method="linear", limit_direction="both"))):
            found = {r["id"]: r["x"] for r in got.collect()}
            np.testing.assert_allclose([found[i] if found[i] is not None else np.nan for i in pdf.id],
                                       list(want), rtol=1e-9)


def test_blocks_of_a_partition_id_key(spark):
    df = spark.range(20_000, numPartitions=2).select(F.monotonically_increasing_id().alias("k"),
                                                     F.lit(1.0).alias("x"))
    sizes = [r["n"] for r in fill._ordered(df, "k", 500).groupBy("_qblk").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 1000


def test_fills_of_tied_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, None), (3, 4.0)], "k int, x double")
    want = list(_by_order(df, "k").x.interpolate(method="linear", limit_direction="both"))
    for block in (1, 2, 10):
        assert sorted(r["x"] for r in fill.interpolate(df, ["x"], "k", block).collect()) == pytest.approx(sorted(want))


def test_dedup_keeps_one_of_tied_copies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (3, "c")], "k int, s string")
    for keep, a in (("first", 1), ("last", 2)):
        got = sorted(map(tuple, fill.drop_duplicate_rows(df, "k", keep).collect()), key=repr)
        assert got == sorted([(a, "a"), (3, "c"), (None, "b")], key=repr)
