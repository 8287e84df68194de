import os
import tempfile

import pytest

from qualis.operators import audit
from qualis.sources.csv import DataLoadError, clean_names, load_csv, sniff
from qualis.streaming import audit_stream, clean_stream, missing_by_window


def test_audit_values_counts(spark):
    df = spark.createDataFrame([("a@b.co", "x#"), ("bad", "ok"), (None, None)], "e string, t string")
    got = {(r["column"], r["rule"]): (r["n_non_null"], r["n_valid"], r["n_invalid"])
           for r in audit.audit_values(df, {"e": "email", "t": ["special_chars"]}).collect()}
    assert got == {("e", "email"): (2, 1, 1), ("t", "special_chars"): (2, 1, 1)}
    with pytest.raises(KeyError):
        audit.audit_values(df, {"e": "nope"})


def test_boolean_like(spark):
    df = spark.createDataFrame([("Yes", "t", "M"), ("no ", "F", "x"), (" YES", None, "y"), ("", "f", "z"),
                                ("No", "T", "w")], "a string, b string, c string")
    got = {r["column"]: (r["boolean_like"], r["values"]) for r in audit.boolean_like_columns(df).collect()}
    assert got["a"] == (True, ["no", "yes"])
    assert got["b"] == (True, ["f", "t"])
    assert got["c"][0] is False


@pytest.mark.parametrize("text,ok", [
    ('{"a": 1}', True), ("```json\n{\"a\": 1}\n```", True), ("```\n[1, 2]\n```", True),
    ('  "x" ', True), ('{"a": 1}}', False), ("Sure! {}", False), ("", False), ("1, 2", False),
    ("null", True), ("```JSON {\"k\": true}```", True)])
def test_json_replies(spark, text, ok):
    df = spark.createDataFrame([(text,)], "r string")
    assert audit.parse_json_responses(df, "r").first()["is_valid"] is ok


def _write(text: str, encoding="utf-8") -> str:
    folder = tempfile.mkdtemp(prefix="qualis-csv-")
    path = os.path.join(folder, "data.csv")
    with open(path, "w", encoding=encoding, newline="") as fh:
        fh.write(text)
    return path


def test_csv_fallbacks(spark):
    text = ("﻿name ;age;;city\n"
            "Alice;30;;Pune\n"
            "Bob;NA;;Delhi\n"
            "Carl;41;;Agra;extra\n"      # too many fields: skipped
            "Dan;22\n"                    # too few: padded
            "Eve;n/a;;\n")
    df = load_csv(spark, _write(text))
    assert df.columns == ["name", "age", "city"]
    assert dict(df.dtypes)["age"] == "bigint"
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("Alice", 30, "Pune"), ("Bob", None, "Delhi"), ("Dan", 22, None), ("Eve", None, None)]


def test_csv_types_and_latin1(spark):
    text = "a,b,c,d\n1,1.5,True,caf\xe9\n2,x,False,na\xefve\n"
    df = load_csv(spark, _write(text, encoding="latin-1"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "boolean", "d": "string"}
    assert sorted(r["d"] for r in df.collect()) == ["café", "naïve"]


def test_sniff_and_names():
    assert sniff(["a|b|c", "1|2|3"])[0] == "|"
    assert sniff(["a,b;c"])[0] == ","  # tie goes to list order
    assert clean_names([" x ", "", "x", "x"]) == ["x", "Unnamed: 1", "x.1", "x.2"]
    with pytest.raises(DataLoadError):
        sniff([])


def test_streaming_steps_and_metrics(spark):
    src = tempfile.mkdtemp(prefix="qualis-stream-src-")
    data = spark.createDataFrame(
        [(1, "2024-01-01 00:10:00", "  a  b ", "x@y.co"), (2, "2024-01-01 00:20:00", None, "bad"),
         (3, "2024-01-01 01:30:00", "c", None)], "id int, ts string, s string, e string"
    ).selectExpr("id", "cast(ts as timestamp) ts", "s", "e")
    data.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(data.schema).parquet(src)
    with pytest.raises(ValueError):
        clean_stream(stream, [("fill_median", ["id"])])
    cleaned = clean_stream(stream, [("trim_spaces", ["s"]), ("upper_case", ["s"])])
    q1 = cleaned.writeStream.format("memory").queryName("qualis_clean").trigger(availableNow=True).start()
    q1.awaitTermination()
    assert sorted((r["id"], r["s"]) for r in spark.table("qualis_clean").collect()) == [
        (1, "A B"), (2, None), (3, "C")]
    q2 = (audit_stream(stream, {"e": "email"}).writeStream.outputMode("complete").format("memory")
          .queryName("qualis_audit").trigger(availableNow=True).start())
    q2.awaitTermination()
    r = spark.table("qualis_audit").first()
    assert (r["n_non_null"], r["n_valid"], r["n_invalid"]) == (2, 1, 1)
    q3 = (missing_by_window(stream, "ts", "1 hour", "0 seconds", ["s", "e"]).writeStream
          .outputMode("append").format("memory").queryName("qualis_missing")
          .trigger(availableNow=True).start())
    q3.awaitTermination()
    got = {(str(r["window_start"]), r["column"]): (r["n_rows"], r["n_missing"])
           for r in spark.table("qualis_missing").collect()}
    assert got[("2024-01-01 00:00:00", "s")] == (2, 1)
    assert got[("2024-01-01 00:00:00", "e")] == (2, 0)


def test_csv_windows_1252_when_asked(spark):
    folder = tempfile.mkdtemp(prefix="qualis-csv-")
    path = os.path.join(folder, "w.csv")
    with open(path, "wb") as fh:
        fh.write(b"item,price\nmug,\x805\n")
    df = load_csv(spark, path, encoding="cp1252")
    assert df.first()["price"] == "€5"


def test_csv_encoding_is_decided_over_the_whole_file(spark):
    text = "a,b\n" + "1,plain\n" * 300 + "2,caf\xe9\n"
    df = load_csv(spark, _write(text, encoding="latin-1"))
    assert df.where("a = 2").first()["b"] == "café"


def test_csv_whole_numbers_over_63_bits(spark):
    df = load_csv(spark, _write(f"a,b,c\n12345678901234567890,{'9' * 40},1\n1,2,\n"))
    assert dict(df.dtypes) == {"a": "decimal(38,0)", "b": "double", "c": "bigint"}
    rows = df.orderBy("a").collect()
    assert [int(r["a"]) for r in rows] == [1, 12345678901234567890]
    assert [r["b"] for r in rows] == [2.0, 1e40] and [r["c"] for r in rows] == [None, 1]
