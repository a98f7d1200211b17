"""Concurrent Spark jobs from driver threads.

Independent fits (voting members, grid candidates × folds, CV folds) are
separate Spark jobs; submitting them from a small thread pool lets the
scheduler overlap them on the cluster instead of running one at a time.
Results come back in submission order and the first error is re-raised.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

MAX_WORKERS = int(os.environ.get("REGCAST_PARALLEL_JOBS", "4"))


def run_all(tasks: list[Callable[[], object]], max_workers: int | None = None) -> list:
    workers = max(1, min(max_workers or MAX_WORKERS, len(tasks)))
    if workers == 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(max_workers=workers) as pool:
        futures = [pool.submit(t) for t in tasks]
        return [f.result() for f in futures]
