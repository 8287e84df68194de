"""CSV source with the interactive tool's fallbacks, as one Spark read.

* separator: the candidate (`, ; tab |`) that splits the header into the most
  fields, ties in that order; encoding: UTF-8 unless any line of the files holds
  bytes that are not UTF-8 (one aggregate over all lines), then ISO-8859-1
  (which decodes any byte); windows-1252 when asked for;
* records that go over line feeds (in quoted fields) are cut by a scan of the
  quotes (`records`), not by reading a file in one task; where every line is a
  record, Spark's reader takes the lines. A file that ends inside a quoted field
  is an error;
* every field is read as text. Empty fields are kept as '' (not null), so a row
  with more fields than the header is recognised exactly by a filled `_extra`
  column and skipped; short rows are padded with nulls;
* missing-value tokens (NA, n/a, NULL, '', ...) become null before types are
  inferred, so "NA" in a number column does not turn it into text;
* column types (bigint, double, boolean, else string) come from one aggregate
  over the whole file set; whole numbers over 63 bits make a column
  decimal(38,0), or double when they have over 38 digits;
* names are stripped, blank ones become `Unnamed: i`, repeated ones get `.1`,
  `.2`; all-null `Unnamed*` columns are dropped.

Only the first lines, for the header, reach the driver.
"""

from __future__ import annotations

import codecs
import csv as _csv
import io

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import col_ref
from ..config import CSV_SEPARATORS, NA_TOKENS
from .records import UnclosedQuote, records_over_lines


class DataLoadError(Exception):
    """The file cannot be read as a table."""


_SENTINEL = "\u0000\u0001null\u0001\u0000"  # never matches: empty fields stay ''
_INT = r"^[+-]?\d+$"
_FLOAT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
_BOOL = ("True", "False", "TRUE", "FALSE", "true", "false")
HEADER_LINES = 200
# windows-1252 is ISO-8859-1 but for bytes 80-9F
_C1 = [(chr(b), bytes([b]).decode("windows-1252", "ignore")) for b in range(0x80, 0xA0)]


def _header_lines(lines: DataFrame, encoding: str) -> list[str]:
    rows = lines.select(F.col("value").cast("binary")).limit(HEADER_LINES).collect()
    return [bytes(r["value"]).decode(encoding, "replace") for r in rows]


def file_encoding(lines: DataFrame) -> str:
    """UTF-8 when every line decodes, else ISO-8859-1."""
    return "UTF-8" if lines.agg(F.bool_and(F.is_valid_utf8("value"))).first()[0] in (True, None) else "ISO-8859-1"


def _charset(name: str) -> str:
    """An encoding's name as Spark spells it."""
    plain = codecs.lookup(name).name
    return {"utf-8": "UTF-8", "iso8859-1": "ISO-8859-1", "ascii": "US-ASCII"}.get(plain, plain)


def sniff(lines: list[str]) -> tuple[str, list[str]]:
    """(separator, header fields) from the first lines."""
    if not lines:
        raise DataLoadError("empty file")
    header = next((ln for ln in lines if ln.strip()), None)
    if header is None:
        raise DataLoadError("no header line")
    header = "\n".join([header, *lines[lines.index(header) + 1:]])  # a name may go over lines
    header = header.lstrip("\ufeff")
    best = max(CSV_SEPARATORS, key=lambda sep: len(header_fields(header, sep)))  # the first of equal ones
    return best, header_fields(header, best)


def header_fields(text: str, sep: str) -> list[str]:
    return next(_csv.reader(io.StringIO(text, newline=""), delimiter=sep))


def clean_names(fields: list[str]) -> list[str]:
    out, seen = [], {}
    for i, f in enumerate(fields):
        name = f.strip() or f"Unnamed: {i}"
        base, k = name, seen.get(name, 0)
        while name in seen:
            k += 1
            name = f"{base}.{k}"
        seen[base] = k
        seen.setdefault(name, 0)
        out.append(name)
    return out


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to bigint / double / boolean when every non-null value
    fits; decided by one aggregate."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        v = col_ref(c)
        aggs += [F.coalesce(F.bool_and(F.when(v.isNotNull(), v.rlike(_INT))), F.lit(True)).alias(f"i{i}"),
                 F.coalesce(F.bool_and(F.when(v.isNotNull(), v.rlike(_FLOAT))), F.lit(True)).alias(f"f{i}"),
                 F.coalesce(F.bool_and(F.when(v.isNotNull(), v.isin(*_BOOL))), F.lit(True)).alias(f"b{i}"),
                 F.count(v).alias(f"n{i}"),
                 F.count_if(v.rlike(_INT) & v.try_cast("bigint").isNull()).alias(f"w{i}"),
                 F.count_if(v.rlike(_INT) & v.try_cast("decimal(38,0)").isNull()).alias(f"x{i}")]
    row = df.agg(*aggs).first()
    new = {}
    for i, c in enumerate(cols):
        if row[f"n{i}"] == 0:
            new[c] = col_ref(c).cast("double")
        elif row[f"i{i}"]:
            new[c] = col_ref(c).try_cast("bigint" if not row[f"w{i}"] else "decimal(38,0)" if not row[f"x{i}"] else "double")
        elif row[f"f{i}"]:
            new[c] = col_ref(c).try_cast("double")
        elif row[f"b{i}"]:
            new[c] = F.lower(col_ref(c)) == "true"
    return df.select(*[new[c].alias(c) if c in new else col_ref(c) for c in df.columns])


def post_process(df: DataFrame) -> DataFrame:
    """Drop `Unnamed*` columns that hold no value (one aggregate)."""
    unnamed = [c for c in df.columns if c.lower().startswith("unnamed")]
    if not unnamed:
        return df
    row = df.agg(*[F.count(col_ref(c)).alias(f"n{i}") for i, c in enumerate(unnamed)]).first()
    empty = [c for i, c in enumerate(unnamed) if row[f"n{i}"] == 0]
    return df.drop(*empty)


def load_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
             na_tokens=NA_TOKENS, infer: bool = True) -> DataFrame:
    """Read CSV file(s) at `path` into a typed DataFrame (see module notes)."""
    try:
        text = spark.read.text(path)
        encoding = _charset(encoding) if encoding else file_encoding(text)
        windows = encoding.lower().replace("-", "") in ("cp1252", "windows1252")
        lines = _header_lines(text, "windows-1252" if windows else encoding)
    except Exception as exc:  # missing path, unreadable file
        raise DataLoadError(f"Could not read CSV: {exc}") from exc
    found_sep, fields = sniff(lines)
    sep = sep or found_sep
    if windows:  # no charset of Spark's reader: read as ISO-8859-1, then mapped per field
        encoding = "ISO-8859-1"
    if sep != found_sep:
        fields = header_fields("\n".join(lines).lstrip("\ufeff"), sep)
    names = clean_names(fields)
    raw = [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(r, T.StringType()) for r in raw]
                          + [T.StructField("_extra", T.StringType())])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": _SENTINEL, "emptyValue": ""}
    try:
        records = records_over_lines(spark, path, encoding, sep)
    except UnclosedQuote as exc:
        raise DataLoadError(f"Could not read CSV: {exc}") from exc
    if records is None:
        df = spark.read.schema(schema).options(header=True, encoding=encoding, enforceSchema=True, **options).csv(path)
    else:
        fields_of = F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "), options)
        df = records.select(fields_of.alias("r")).select("r.*")
    if windows:
        defined = [(a, b) for a, b in _C1 if b]
        df = df.select(*[F.translate(r, "".join(a for a, _ in defined), "".join(b for _, b in defined)).alias(r)
                         for r in df.columns])
    na = list(na_tokens)
    df = df.where(F.col("_extra").isNull()).select(*[
        F.when(F.col(r).isin(*na), F.lit(None).cast("string")).otherwise(F.col(r)).alias(n)
        for r, n in zip(raw, names)])
    if infer:
        df = infer_types(df)
    return post_process(df)
