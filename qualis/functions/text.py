"""String expressions used by detectors and cleaning steps.

All are JVM regex expressions. `(?U)` makes `\\s`, `\\d` and `\\w` Unicode-aware,
so a no-break space counts as whitespace as it does in Python's `re`.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- Fixed values: patterns that must equal the reference's for equal results. ---
WHITESPACE_ISSUE = r"(?U)^\s+|\s+$|\s{2,}"
NUMERIC_LIKE = r"(?U)^-?\d+(\.\d+)?$"
# --- End of fixed values. ---

# Linear: a run of whitespace is tried from its first character only.
_EDGE_SPACE = r"(?U)^\s++|(?<!\s)\s++$"
_SPACE_RUN = r"(?U)\s{2,}"
_ANY_SPACE = r"(?U)\s+"
# A run of cased letters, or a run of anything else (title-casing unit).
_CASED_RUN = r"(?U)([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (not only ' ')."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def has_whitespace_issue(c: Column) -> Column:
    return c.rlike(WHITESPACE_ISSUE)


def is_numeric_like(c: Column) -> Column:
    return c.rlike(NUMERIC_LIKE)


def trim_spaces(c: Column) -> Column:
    """Strip, then collapse every run of 2+ whitespace characters to one space."""
    return F.regexp_replace(strip(c), _SPACE_RUN, " ")


def remove_all_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, _ANY_SPACE, "")


def title_case(c: Column) -> Column:
    """Strip, then upper-case the first letter of each cased-letter run and
    lower-case the rest: "o'neil 3rd" -> "O'Neil 3Rd" (unlike `initcap`)."""
    parts = F.regexp_extract_all(strip(c), F.lit(_CASED_RUN), 1)
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)),
                                              F.lower(F.substring(p, 2, 1 << 30)))),
        "",
    )
