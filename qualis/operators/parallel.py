"""Submit independent Spark jobs together.

Each per-column statistic is its own small job; run one after another they
leave most task slots idle. Jobs submitted from several driver threads run at
the same time and share the cluster.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterable, TypeVar

T = TypeVar("T")
R = TypeVar("R")
MAX_CONCURRENT_JOBS = 8


def map_jobs(fn: Callable[[T], R], items: Iterable[T]) -> list[R]:
    items = list(items)
    if len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(MAX_CONCURRENT_JOBS, len(items))) as pool:
        return list(pool.map(fn, items))
