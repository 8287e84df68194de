"""Value rules as native Spark predicates (no per-row Python).

Each rule maps a column to a boolean Column: true = valid, false = invalid,
null = the value is null (not counted).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, functions as F, types as T

from ..config import BOOLEAN_VOCABULARIES
from .columns import col_ref
from .text import strip
from .types import is_integral, is_string

# --- Fixed values: patterns that must equal the reference's for equal results. ---
EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL = "(?U)" + r"^(https?:\/\/)?(www\.)?[a-zA-Z0-9-]+(\.[a-zA-Z]{2,})+([\/\w\-.~:?#@!$&'()*+,;=%]*)?$"
PINCODE_IN = r"^[1-9][0-9]{5}$"
ZIPCODE_US = r"(?U)^\d{5}(-\d{4})?$"
POSTCODE_OTHER = r"^[A-Za-z0-9\- ]{4,10}$"
SPECIAL_CHAR = r"(?U)[^a-zA-Z0-9\s.,\-_@]"
PHONE_MIN_DIGITS, PHONE_MAX_DIGITS = 7, 15
# --- End of fixed values. ---


def _text(c: Column) -> Column:
    return c.cast("string")


def _not_blank(s: Column) -> Column:
    return strip(s) != ""


def email(c: Column) -> Column:
    s = _text(c)
    return F.when(s.isNull(), None).otherwise(_not_blank(s) & strip(s).rlike(EMAIL))


def phone(c: Column) -> Column:
    """For text and whole numbers; `rule_check` gives false for other types."""
    s = _text(c)
    n = F.length(F.regexp_replace(s, r"(?U)\D", ""))
    return F.when(s.isNull(), None).otherwise(
        _not_blank(s) & n.between(PHONE_MIN_DIGITS, PHONE_MAX_DIGITS))


def url(c: Column) -> Column:
    s = _text(c)
    return F.when(s.isNull(), None).otherwise(_not_blank(s) & strip(s).rlike(URL))


def pincode(c: Column, country: str = "IN") -> Column:
    s = _text(c)
    pattern = {"IN": PINCODE_IN, "US": ZIPCODE_US}.get(country, POSTCODE_OTHER)
    return F.when(s.isNull(), None).otherwise(_not_blank(s) & strip(s).rlike(pattern))


def no_special_chars(c: Column) -> Column:
    """Valid when the value holds no character outside letters, digits,
    whitespace and `. , - _ @`."""
    s = _text(c)
    return F.when(s.isNull(), None).otherwise(~s.rlike(SPECIAL_CHAR))


RULES: dict[str, Callable[[Column], Column]] = {
    "email": email,
    "phone": phone,
    "url": url,
    "pincode": pincode,
    "pincode_us": lambda c: pincode(c, "US"),
    "postcode": lambda c: pincode(c, "other"),
    "special_chars": no_special_chars,
}


def rule_check(rule: str, name: str, dt: T.DataType) -> Column:
    """The rule over a column of type `dt`. Only text and whole numbers can be phones."""
    if rule == "phone" and not (is_string(dt) or is_integral(dt)):
        return F.when(col_ref(name).isNotNull(), F.lit(False))
    return RULES[rule](col_ref(name))


def boolean_words() -> list[str]:
    return sorted({w for pair in BOOLEAN_VOCABULARIES for w in pair})
