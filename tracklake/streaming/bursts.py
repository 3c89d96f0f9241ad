"""Bursts and clock merges over streams; equal to the batch operators once all rows have come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.changes import folded_by_clock, newest_by_clock
from tracklake.sources.tables import Change, TableLog


def streamed_bursts(frames: DataFrame, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """station_id, started_at, ended_at, frames of every burst; frames later than ``late`` behind the newest are dropped."""
    timed = frames.withColumn("captured_at", F.col("captured_at").cast("timestamp")).withWatermark("captured_at", late)
    session = F.session_window("captured_at", f"{gap_seconds} seconds")
    grouped = timed.groupBy("station_id", session).agg(F.min("captured_at").alias("started_at"), F.max("captured_at").alias("ended_at"), F.count("*").alias("frames"))
    return grouped.select("station_id", "started_at", "ended_at", "frames")


BUCKETS = 64


class ClockTable:
    """A table of versions under last-writer-wins, merged when it is read.

    A batch adds one version a key to the buckets of its keys, and reads nothing, so it costs what the batch costs.
    ``rows`` folds every key's versions in the order of their batches.  ``compact`` folds the buckets that have many parts
    and replaces these alone.  Rows have the key, other columns, lamport, origin and row_hash.
    """

    def __init__(self, log: TableLog, name: str, key: list[str], buckets: int = BUCKETS):
        self.log, self.name, self.key, self.buckets = log, name, key, buckets

    def _versions(self, rows: DataFrame, number: int) -> DataFrame:
        one = newest_by_clock(rows, self.key)
        return one.withColumns({"_batch": F.lit(number).cast("long"), "_bucket": F.pmod(F.xxhash64(*self.key), F.lit(self.buckets))})

    def merge(self, batch: DataFrame, number: int) -> None:
        """Adds a micro-batch of remote rows; a number that was merged before changes nothing.  A ``foreachBatch`` function."""
        if not batch.isEmpty():
            self.log.commit([Change(self.name, self._versions(batch, number), "_bucket")], cursor=(f"merge:{self.name}", {"batch": number}))

    def rows(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """One row a key, as of a commit."""
        return folded_by_clock(self.log.read(self.name, number, buckets).drop("_bucket"), self.key, "_batch")

    def compact(self, most_parts: int = 8) -> list[int]:
        """Folds the buckets of more than ``most_parts`` parts, and says which they were."""
        version = self.log.version()
        parts: dict[str, list[str]] = {}
        for p in version.tables[self.name]["parts"]:
            parts.setdefault(p["value"], []).append(p["path"])
        full = {int(v): paths for v, paths in parts.items() if len(paths) > most_parts}
        if full:
            # A folded key counts as of before all batches: later ones are compared with it in their order.  Parts that
            # came meanwhile stay, as only those that were folded are replaced.
            folded = self._versions(self.rows(version.number, list(full)), -1)
            self.log.commit([Change(self.name, folded, "_bucket", "paths", frozenset(p for paths in full.values() for p in paths))])
        return sorted(full)
