"""Column expressions: missing values, text, numbers, dates and value rules."""

from .missing import is_missing, normalized
from .numeric import to_double
from .text import (has_whitespace_issue, is_numeric_like, remove_all_whitespace, strip,
                   title_case, trim_spaces)
from .dates import parse_date_mixed
from . import types, validators

__all__ = [
    "is_missing", "normalized", "to_double", "has_whitespace_issue",
    "is_numeric_like", "remove_all_whitespace", "strip", "title_case", "trim_spaces",
    "parse_date_mixed", "types", "validators",
]
