"""Print the physical plans of the main operators (formatted explain).

    python tools/explain_plans.py [sf_dir] > /tmp/plans.txt
"""

from __future__ import annotations

import os
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

from pyspark.sql import functions as F  # noqa: E402

from qualis import fixtures  # noqa: E402
from qualis.operators import clean, fill, stats, summary, vf  # noqa: E402
from qualis.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    li = fixtures.table(spark, sf_dir, "dirty_lineitem")
    ev = fixtures.table(spark, sf_dir, "dirty_events")
    cols = [c for c in li.columns if c != "rid"]
    st = stats.TableStats(li, order_by="rid")
    plans = {
        "value summary (native-type VF + case collisions)":
            vf.column_value_summary(li, cols, case_of_text=True),
        "forward fill (blocked windows + carry)": fill.forward_fill(li, ["l_quantity"], "rid"),
        "interpolate": fill.interpolate(li, ["l_quantity"], "rid"),
        "keep-first dedup (hash prescreen)": fill.drop_duplicate_rows(ev, "rid", "first"),
        "frequency encoding (size-checked broadcast)": clean.frequency_encoding(ev, ["event_type"]),
        "correlation (one aggregate)": summary.correlation_matrix(li, ["l_quantity", "l_tax", "l_discount"]),
        "top categories (per-task top-k)": summary.top_categories(li, "l_returnflag"),
    }
    for name, df in plans.items():
        print("=" * 100)
        print(name)
        print("=" * 100)
        df.explain(mode="formatted")
    print("=" * 100)
    print("metrics scan (one wide aggregate)")
    print("=" * 100)
    li.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).explain(mode="formatted")
    _ = st


if __name__ == "__main__":
    main()
