"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion (a no-op write forces every row and column of
the result, after any jobs the query runs to build its plan), after one untimed
warm-up pass of all of them on the smallest tables. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from qualis.queries import queries  # noqa: E402
from qualis.session import local_session  # noqa: E402

HEADLINE = [
    "dataset_meta_lineitem",
    "all_issues_lineitem",
    "quality_score",
    "forward_fill_lineitem",
    "interpolate",
    "cleaning_plan_lineitem",
    "cleaning_plan",
    "frequency_encoding",
    "box_stats",
    "profile_samples",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="qualis-bench", **{
        "spark.sql.shuffle.partitions": str(max(8, 2 * int(cpus))),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
    })
    qs = queries()
    # warm-up, not timed: JIT and generated code depend on the plan shape, not on
    # the data size, so each headline query runs once on the smallest tables
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    for name in HEADLINE:
        try:
            qs[name](spark, warm_dir if os.path.isdir(warm_dir) else sf_dir) \
                .write.format("noop").mode("overwrite").save()
        except Exception:
            pass
    times, failed = {}, {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # keep timing the rest; report the failure
            failed[name] = str(exc)[:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
