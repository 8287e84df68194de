"""Row numbers by path and place, however files are split."""

from __future__ import annotations

import pytest

from qualis.sources import rowid


@pytest.fixture
def pieces(spark):
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


@pytest.mark.parametrize("bound", [0, 10 ** 6])
def test_lines(spark, tmp_path, pieces, monkeypatch, bound):
    monkeypatch.setattr(rowid, "BROADCAST_FILES", bound)
    folder = tmp_path / "lines"
    folder.mkdir()
    want = []
    for f in range(4):
        lines = [f"{f}-{i}" + "x" * (i * 7 % 31) for i in range(8 * f)]
        (folder / f"p{3 - f}.txt").write_text("".join(x + "\n" for x in lines))
    for f in (3, 2, 1, 0):
        want += [f"{f}-{i}" + "x" * (i * 7 % 31) for i in range(8 * f)]
    for size in (90, 1 << 20):
        pieces(size)
        rows = rowid.read_lines_ordered(spark, str(folder)).orderBy("_rid").collect()
        assert [r["_rid"] for r in rows] == list(range(len(want))) and [r.value for r in rows] == want


@pytest.mark.parametrize("bound", [0, 10 ** 6])
def test_parquet(spark, tmp_path, pieces, monkeypatch, bound):
    monkeypatch.setattr(rowid, "BROADCAST_FILES", bound)
    folder = str(tmp_path / "t")
    spark.range(0, 5000).selectExpr("id", "id % 3 AS path", "id AS p1", "id AS before").repartition(5).write.parquet(folder)
    pieces(20000)
    a = rowid.read_parquet_ordered(spark, folder, "n")
    assert a.columns == ["id", "path", "p1", "before", "n"]
    first = {r.id: r.n for r in a.collect()}
    pieces(1 << 30)
    again = {r.id: r.n for r in rowid.read_parquet_ordered(spark, folder, "n").collect()}
    assert first == again and sorted(first.values()) == list(range(5000))
    files = sorted(p.name for p in (tmp_path / "t").glob("part-*"))
    rows = [r.id for f in files for r in spark.read.parquet(f"{folder}/{f}").collect()]
    assert [i for i, _ in sorted(first.items(), key=lambda x: x[1])] == rows


def test_no_rows(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    assert rowid.read_parquet_ordered(spark, str(tmp_path / "none")).collect() == []
