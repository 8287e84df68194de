import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from qualis.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", app="qualis-tests", **{"spark.sql.shuffle.partitions": "8",
                                                 "spark.driver.memory": "4g"})
    yield s


def rows_of(df, order=None):
    """Rows as tuples, sorted by `order` (a column name) or fully."""
    out = [tuple(r) for r in (df.orderBy(order).collect() if order else df.collect())]
    return out if order else sorted(out, key=repr)
