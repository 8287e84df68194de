"""CSV records that go over line feeds: against a plain reader of whole files, with splits of a few bytes."""

from __future__ import annotations

import csv
import io
import os
import random
from urllib.parse import urlparse

import pytest

from qualis.queries import load_csv_multiline_q
from qualis.session import ensure_checkpoint_dir
from qualis.sources import load_csv, records
from qualis.sources.csv import DataLoadError


@pytest.fixture
def small_splits(spark):
    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def _rows(text, sep=","):
    """Python's own reader of the whole text, blank lines and rows with too many fields left out."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    return [tuple([x or None for x in r] + [None] * (len(rows[0]) - len(r))) for r in rows[1:] if len(r) <= len(rows[0])]


def _load(spark, tmp_path, text, name="t.csv", **kw):
    (tmp_path / name).write_bytes(text.encode(kw.get("encoding", "utf-8")))
    df = load_csv(spark, str(tmp_path / name), na_tokens=(), infer=False, **kw)
    return [tuple(x or None for x in r) for r in df.collect()]


def _field(rng, sep):
    kind = rng.randrange(7)
    if kind == 0:
        return ""
    if kind < 3:
        return "".join(rng.choice("abc 1é") for _ in range(rng.randint(1, 6)))
    body = "".join(rng.choice(["a", "b", "\n", "\n", sep, '""', "é", " "]) for _ in range(rng.randint(0, 12)))
    return f'"{body}"'


@pytest.mark.parametrize("seed", range(3))
def test_records_over_lines(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    sep = rng.choice(",;|")
    lines = [sep.join(["a", '"b\nc"' if seed % 2 else "b", "d"])]
    for i in range(30):
        fields = [_field(rng, sep) for _ in range(rng.choice([2, 2, 2, 2, 1, 3]))]
        lines.append(sep.join([str(i), *fields[:2], *("x" for _ in fields[2:])]))
        if rng.random() < 0.1:
            lines.append("")
    text = "\n".join(lines) + ("\n" if seed % 3 else "")
    for size in (150, 1 << 20):
        small_splits(size)
        got = _load(spark, tmp_path, text, sep=sep)
        assert sorted(got, key=str) == sorted(_rows(text, sep), key=str), size


def test_states_dealt_out_by_split(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(records, "KEPT_SPLITS", 0)
    small_splits(100)
    text = "a,b\n" + "".join(f'{i},"x\n{i}\n\n""y"""\n' for i in range(20))
    assert sorted(_load(spark, tmp_path, text)) == sorted(_rows(text))


def test_many_files_and_line_ends(spark, tmp_path, small_splits):
    small_splits(150)
    folder = tmp_path / "many"
    folder.mkdir()
    expected = []
    for f in range(3):
        text = "a,b\r\n" + "".join(f'{f * 100 + i},"v\r\n{i}"\r\n' if i % 3 == 0 else f"{f * 100 + i},w{i}\r\n" for i in range(12))
        (folder / f"p{f}.csv").write_bytes(text.encode())
        expected += _rows(text)
    df = load_csv(spark, str(folder))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string"}
    assert sorted((str(a), b) for a, b in df.collect()) == sorted(expected)


def test_quotes_that_open_nothing(spark, tmp_path, small_splits):
    """A quote inside a field is text and opens no record; one line after another is cut right."""
    small_splits(30)
    text = 'a,b\n1,5" pipe\n2,x"y"z"\n3,"two\nlines"\n4,6" and 7"\n5,"q""\n"\n'
    assert sorted(_load(spark, tmp_path, text)) == sorted(_rows(text))


def test_latin1_records(spark, tmp_path, small_splits):
    small_splits(90)
    text = "name,note\n" + "".join(f'Zoë{i},"é\nü{i}"\n' for i in range(20))
    (tmp_path / "l.csv").write_bytes(text.encode("latin-1"))
    for encoding in (None, "latin-1"):
        got = load_csv(spark, str(tmp_path / "l.csv"), encoding=encoding).collect()
        assert sorted(map(tuple, got)) == sorted(_rows(text))


def test_unclosed_quote_is_an_error(spark, tmp_path):
    with pytest.raises(DataLoadError, match="inside a quoted field"):
        _load(spark, tmp_path, 'a,b\n1,"x\n2,y\n')


def test_plain_lines_are_left_to_the_reader(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b\n1,"x, y"\n2,"say ""hi"""\n')
    assert records.records_over_lines(spark, str(tmp_path / "p.csv"), "UTF-8", ",") is None


def test_export_grows_in_files(spark, tmp_path, small_splits):
    """Four times the documents are exported to more files, not to larger ones, also when ids repeat or are null."""
    root = urlparse(ensure_checkpoint_dir(spark)).path
    rng = random.Random(5)
    small_splits(6000)
    largest, splits_crossed = {}, 0
    for parts in (12, 48):
        rows = [(None if i % 3 else 7, "web", "t" + "".join(rng.choice('abcdefgh\n ",') for _ in range(200)) + str(i), i) for i in range(parts * 25)]
        folder = tmp_path / str(parts)
        spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long") \
            .repartition(parts).write.parquet(str(folder / "documents.parquet"))
        before = set(os.listdir(root))
        got = load_csv_multiline_q(spark, str(folder)).collect()
        assert sorted(map(tuple, got), key=lambda r: r[3]) == rows
        export, = (d for d in set(os.listdir(root)) - before if d.startswith("csv-"))
        sizes = [os.path.getsize(os.path.join(root, export, f)) for f in os.listdir(os.path.join(root, export)) if f.endswith(".csv")]
        largest[parts] = max(sizes)
        splits_crossed += max(sizes) > 6000
    assert largest[48] < 2 * largest[12]
    assert splits_crossed == 2  # the files still have several splits
