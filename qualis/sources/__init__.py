"""Sources: CSV with fallbacks, parquet tables, row ids."""

from .csv import DataLoadError, load_csv
from .rowid import read_lines_ordered, read_parquet_ordered, with_row_id

__all__ = ["DataLoadError", "load_csv", "read_lines_ordered", "read_parquet_ordered", "with_row_id"]
