"""Jobs that go on where they stopped: each batch and the cursor behind it are one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.records import after_cursor
from tracklake.sources.tables import Change, TableLog
from tracklake.storage import checkpointed


def failed_items(log: TableLog, job: str, items: DataFrame, key: str) -> DataFrame:
    """``items`` without those that the job has failed on before."""
    if "job_items" not in log.version().tables:
        return items
    bad = log.read("job_items").filter((F.col("job_id") == job) & (F.col("state") == "failed")).select(F.col("item_id").alias("_bad")).distinct()
    return items.join(bad, F.col(key).cast("string") == F.col("_bad"), "left_anti")


def run_job(log: TableLog, job: str, items: DataFrame, key: str, size: int, process: Callable[[DataFrame], dict[str, DataFrame]], stop: Callable[[], bool] = lambda: False) -> dict:
    """Processes ``items`` in the order of ``key`` (unique), ``size`` at a time, and returns the job's state: batch, cursor, done and state.

    ``process`` gives the rows that a batch adds, by table; failed items are rows of job_items (job_id, item_id, state,
    error), and a resumed job skips them.  A batch's rows and the cursor behind it become visible together, so a job that
    is stopped anywhere goes on after its last whole batch, and no row is there twice.  ``stop`` is asked before every
    batch; a job that it stops is paused.  Batches are the unit of repeated work: choose them large.
    """
    while True:
        now = log.version().cursors.get(job, {"batch": -1, "cursor": None, "done": 0, "state": "running"})
        if now["state"] == "done":
            return now
        if stop():
            return now | {"state": "paused"}
        page = checkpointed(after_cursor(items, key, now["cursor"]).orderBy(key).limit(size))
        n, last = page.agg(F.count("*"), F.max(key)).first()
        if n == 0:
            now = now | {"batch": now["batch"] + 1, "state": "done"}
            log.commit([], cursor=(job, now))
            return now
        found = process(failed_items(log, job, page, key))
        log.commit([Change(t, rows) for t, rows in sorted(found.items())], cursor=(job, {"batch": now["batch"] + 1, "cursor": last, "done": now["done"] + n, "state": "running"}))
