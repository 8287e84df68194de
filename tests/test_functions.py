from pyspark.sql import functions as F

from qualis.functions import text as tx
from qualis.functions import validators as V
from qualis.functions.dates import parse_date_mixed
from qualis.functions.numeric import to_double


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_title_case_letter_runs(spark):
    got = _eval(spark, ["o'neil 3rd foo-bar", "  MUMBAI  ", "new york", "émile zola"], tx.title_case)
    assert got == ["O'Neil 3Rd Foo-Bar", "Mumbai", "New York", "Émile Zola"]


def test_trim_spaces_unicode_and_inner_runs(spark):
    got = _eval(spark, ["  a  b ", "a\tb", "a \t b", " x ", "plain"], tx.trim_spaces)
    assert got == ["a b", "a\tb", "a b", "x", "plain"]


def test_whitespace_issue_flags(spark):
    got = _eval(spark, [" a", "a ", "a  b", "a b", " a", "ab"], tx.has_whitespace_issue)
    assert got == [True, True, True, False, True, False]


def test_numeric_like(spark):
    got = _eval(spark, ["12", "-3.5", "1e5", "+5", "12.", "abc", " 7"], tx.is_numeric_like)
    assert got == [True, True, False, False, False, False, False]


def test_to_double_grammar(spark):
    vals = [" 12 ", "12d", "1e5", "1_000", "0x1A", "+5", "12.", "abc", "-inf", ".5"]
    got = _eval(spark, vals, to_double)
    assert got == [12.0, None, 100000.0, None, None, 5.0, 12.0, None, float("-inf"), 0.5]


def test_dates_month_first_and_year(spark):
    got = _eval(spark, ["03/02/2024", "13/02/2024", "2024", "12", "12345", "2024-01-10",
                        "Jan 5 2024", "n/a"], lambda c: F.date_format(parse_date_mixed(c), "yyyy-MM-dd"))
    assert got == ["2024-03-02", "2024-02-13", "2024-01-01", None, None, "2024-01-10",
                   "2024-01-05", None]


def test_date_layouts(spark):
    vals = ["1/5/2024", "2024-1-5", "2024-01-05T10:00:00Z", "01/05/2024 10:00 AM", "Jan 5, 2024 10:00:00",
            "2024-01-05 10:00:00.123456", "5 January 2024", "5-Jan-2024", "2024/1/5 9:30", "20240105", "2024-13-45",
            "hello", "12-34"]
    got = _eval(spark, vals, lambda c: F.date_format(parse_date_mixed(c), "yyyy-MM-dd"))
    assert got == ["2024-01-05"] * 10 + [None] * 3


def test_phone_needs_text_or_whole_numbers(spark):
    df = spark.createDataFrame([("98765 43210", 9876543210, 98765.4321), (None, None, None)],
                               "t string, n long, x double")
    got = df.select(*[V.rule_check("phone", f.name, f.dataType) for f in df.schema.fields]).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (None, None, None)]


def test_email_phone_url_rules(spark):
    assert _eval(spark, ["a@b.co", " a@b.co ", "a.b.co", "a@b", "", None], V.email) == \
        [True, True, False, False, False, None]
    assert _eval(spark, ["+91 98765-43210", "123", "1234567", "12345678901234567"], V.phone) == \
        [True, False, True, False]
    assert _eval(spark, ["https://www.example.com/a?b=1", "example.org", "http://x", "ftp://a.com"],
                 V.url) == [True, True, False, False]


def test_pincode_and_special_chars(spark):
    assert _eval(spark, ["560001", "060001", "12345"], V.pincode) == [True, False, False]
    assert _eval(spark, ["12345", "12345-6789", "1234"], lambda c: V.pincode(c, "US")) == [True, True, False]
    assert _eval(spark, ["SW1A 1AA", "ab", "A-12345678"], lambda c: V.pincode(c, "UK")) == [True, False, True]
    assert _eval(spark, ["plain text, ok.", "hash#tag", "a_b-c@d"], V.no_special_chars) == [True, False, True]
