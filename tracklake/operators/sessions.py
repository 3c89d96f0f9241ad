"""Bursts, timestamps and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.text import short_id
from tracklake.operators.segments import along, earlier, in_blocks, inside, joined, numbered


def burst_sessions(frames: DataFrame, gap_seconds: float, station: str = "station_id", time: str = "captured_at", image: str = "image_id") -> DataFrame:
    """``frames`` with event_no: a new burst starts where the previous frame of the station is more than the gap away.

    Frames without time belong to no burst and are left out.  Bursts are counted inside blocks of a station and carried
    over their edges, so a station with very many frames is many tasks.
    """
    gap = int(gap_seconds * 1e6)
    rows = in_blocks(frames.filter(F.col(time).isNotNull()), station, [time, image])
    at, order = F.unix_micros(F.col(time).cast("timestamp")), inside(station, [time, image])
    # A block's first row counts as no start here; whether it is one depends on the block before.
    rows = rows.withColumn("_apart", at - F.lag(at).over(order)).withColumn("_no", F.sum(F.when(F.col("_apart") > gap, 1).otherwise(0)).over(order))
    ends = rows.groupBy(station, "_block").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.max("_no").alias("_more"))
    starts = F.when(F.col("_first") - F.lag("_last").over(along(station)) <= gap, 0).otherwise(1)
    before = ends.withColumn("_start", starts).select(station, "_block", (F.sum(F.col("_start") + F.col("_more")).over(along(station)) - F.col("_more")).alias("_before"))
    return joined(rows, before, station).select(*frames.columns, (F.col("_before") + F.col("_no")).alias("event_no"))


def burst_events(frames: DataFrame, gap_seconds: float, station: str = "station_id", time: str = "captured_at", image: str = "image_id") -> DataFrame:
    """station, event_id, started_at, ended_at, frames and image ids in order, of every burst."""
    marked = burst_sessions(frames, gap_seconds, station, time, image)
    members = F.transform(F.array_sort(F.collect_list(F.struct(time, image))), lambda m: m[image])
    events = marked.groupBy(station, "event_no").agg(F.min(time).alias("started_at"), F.max(time).alias("ended_at"), F.count("*").alias("frames"), members.alias("images"))
    key = short_id(F.col(station), F.array_join(F.col("images").cast("array<string>"), "|"), prefix="ev_")
    return events.withColumn("event_id", key)


def filled_timestamps(frames: DataFrame, group: str, order: str, time: str, anchor: Column | None = None) -> DataFrame:
    """``frames`` with filled_at, source and confidence for frames without time.

    Between two known frames the time is interpolated by place; after the last known one it is that one's, before the
    first known one that one's; in groups without any it is the anchor's.  Places and known times are carried over the
    edges of blocks, so a group with very many frames is many tasks.
    """
    rows = numbered(frames, group, [order])
    known = F.when(F.col(time).isNotNull(), F.struct(F.col("_i").alias("i"), F.unix_micros(F.col(time).cast("timestamp")).alias("t")))
    rows = rows.withColumn("_known", known)
    ends = rows.groupBy(group, "_block").agg(F.min("_known").alias("_low"), F.max("_known").alias("_high"))
    ends = ends.select(
        group,
        "_block",
        F.last("_high", ignorenulls=True).over(earlier(along(group))).alias("_prev_end"),
        F.last("_low", ignorenulls=True).over(earlier(along(group, backwards=True))).alias("_next_end"),
    )
    # What follows is looked up backwards: a frame that only shrinks is computed anew for every row.
    before, after = (earlier(inside(group, [c])) for c in (F.col("_i"), F.col("_i").desc()))
    df = joined(rows, ends, group)
    df = df.withColumn("_prev", F.coalesce(F.last("_known", ignorenulls=True).over(before), "_prev_end")).withColumn("_next", F.coalesce(F.last("_known", ignorenulls=True).over(after), "_next_end"))
    share = (F.col("_i") - F.col("_prev.i")) / (F.col("_next.i") - F.col("_prev.i"))
    between = F.col("_prev.t") + F.floor((F.col("_next.t") - F.col("_prev.t")) * share).cast("long")
    own = F.unix_micros(F.col(time).cast("timestamp"))
    start = F.unix_micros(anchor.cast("timestamp")) if anchor is not None else F.lit(None).cast("long")
    value = F.coalesce(own, between, F.col("_prev.t"), F.col("_next.t"), start)
    first = F.col("_i") == 1
    source = (
        F.when(own.isNotNull(), "known")
        .when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(), "interpolated")
        .when(F.col("_prev").isNotNull(), "propagated")
        .when(F.col("_next").isNotNull(), F.when(first, "propagated").otherwise("interpolated"))
        .when(start.isNotNull(), F.when(first, "anchored").otherwise("propagated"))
        .otherwise("unknown")
    )
    confidence = F.when(source == "known", 1.0).when(source == "interpolated", 0.5).when(source == "propagated", 0.4).when(source == "anchored", 0.3).otherwise(0.0)
    return df.select(*frames.columns, F.timestamp_micros(value).alias("filled_at"), source.alias("fill_source"), confidence.alias("fill_confidence"))


def clock_drift(frames: DataFrame, folder: str, time: str, plausible: Column, start: Column) -> DataFrame:
    """``frames`` with repaired_at: implausible times of a folder moved so that its earliest implausible one is the station's start."""
    lowest = F.min(F.when(~plausible, F.col(time))).over(Window.partitionBy(folder))
    moved = F.timestamp_micros(F.unix_micros(F.col(time)) + F.unix_micros(start) - F.unix_micros(lowest))
    return frames.withColumn("repaired_at", F.when(plausible, F.col(time)).otherwise(moved))


def resolved_timestamps(frames: DataFrame, now: Column) -> DataFrame:
    """``frames`` (folder, name, exif_at, station_start) with captured_at, time_source and time_confidence.

    A plausible camera time wins, with less trust where the file name says something over 30 days away; then the file
    name; then a camera time repaired by the folder's drift; then filling from the neighbours in the order of names.
    """
    from tracklake.functions.text import filename_timestamp, plausible

    df = frames.withColumn("_named", filename_timestamp(F.col("name"))).withColumn("_ok", plausible(F.col("exif_at"), now))
    df = df.withColumn("_named", F.when(plausible(F.col("_named"), now), F.col("_named")))
    conflict = F.abs(F.unix_timestamp("exif_at") - F.unix_timestamp("_named")) > 30 * 86400
    df = clock_drift(df, "folder", "exif_at", F.col("_ok"), F.col("station_start"))
    first = F.when(F.col("_ok"), F.col("exif_at")).otherwise(F.coalesce("_named", "repaired_at"))
    source = (
        F.when(F.col("_ok"), F.when(F.coalesce(conflict, F.lit(False)), "conflict").otherwise("exif"))
        .when(F.col("_named").isNotNull(), "filename")
        .when(F.col("repaired_at").isNotNull(), "drift_corrected")
    )
    trust = F.when(source == "exif", 1.0).when(source == "conflict", 0.6).when(source == "filename", 0.85).when(source == "drift_corrected", 0.7)
    df = df.withColumn("_first", first).withColumn("_source", source).withColumn("_trust", trust)
    filled = filled_timestamps(df, "folder", "name", "_first", F.col("station_start"))
    return filled.select(
        *frames.columns, F.col("filled_at").alias("captured_at"), F.coalesce("_source", F.when(F.col("fill_source") == "unknown", "unknown").otherwise("inferred")).alias("time_source"), F.coalesce("_trust", "fill_confidence").alias("time_confidence")
    )


def cycle_periods(runs: DataFrame, default_days: float, group: str = "reserve_id") -> DataFrame:
    """run_id, period_start, period_end: from a run's start to the next one's; the last lasts as long as the one before, or the default."""
    order = Window.partitionBy(group).orderBy("started_at", "run_id")
    start = F.unix_micros(F.col("started_at").cast("timestamp"))
    previous, following = F.lag(start).over(order), F.lead(start).over(order)
    length = F.coalesce(F.when(start > previous, start - previous), F.lit(int(default_days * 86_400_000_000)))
    return runs.select(group, "run_id", F.timestamp_micros(start).alias("period_start"), F.timestamp_micros(F.coalesce(following, start + length)).alias("period_end"))
