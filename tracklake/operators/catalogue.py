"""Counts and lists over captures, individuals, stations and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.text import json_list
from tracklake.operators.segments import numbered


def live(assignments: DataFrame) -> DataFrame:
    """Assignments that no later one supersedes."""
    return assignments.filter(F.col("superseded_by").isNull())


# Statuses and stages that a run's counts name.
STATUSES, STAGES = ("blank", "person", "vehicle", "corrupt", "quarantined"), ("A", "B")


def run_counts(images: DataFrame, run: str, status: str, animal: Column, statuses: tuple[str, ...] = STATUSES, stage: str | None = None) -> DataFrame:
    """Conditional counts by run; statuses are compared as they are written.

    ``animal`` says which images have an animal detection; with a column of triage stages those are counted too.
    """
    count = lambda column, value, name: F.count_if(F.coalesce(F.col(column) == value, F.lit(False))).alias(f"n_{name}")
    stages = [count(stage, x, f"stage_{x.lower()}") for x in STAGES] if stage else []
    return images.groupBy(run).agg(F.count("*").alias("n_images"), *[count(status, v, v) for v in statuses], *stages, F.countDistinct(F.when(animal, F.col("image_id"))).alias("n_animal"))


def counted(df: DataFrame, column: str) -> DataFrame:
    """Values of a column and how often they occur."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def flag_counts(images: DataFrame, flags: str) -> DataFrame:
    """How often each flag of a JSON list occurs; malformed lists count as empty."""
    return images.select(F.explode(json_list(F.col(flags))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def station_image_counts(stations: DataFrame, images: DataFrame) -> DataFrame:
    counts = images.groupBy("station_id").agg(F.count("*").alias("n_images"))
    return stations.select("station_id").join(counts, "station_id", "left").na.fill(0, ["n_images"])


def individuals_summary(captures: DataFrame) -> DataFrame:
    """Crops, stations, sides in order and mean confidence of each individual."""
    sides = F.array_join(F.sort_array(F.collect_set("side")), ",")
    return captures.groupBy("ind_id").agg(
        F.count("*").alias("crop_count"), F.countDistinct("station_id").alias("station_count"), sides.alias("sides"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen")
    )


def entities(captures: DataFrame) -> DataFrame:
    """One entity for each individual and side that was seen."""
    seen = captures.filter(F.col("side").isin("L", "R")).groupBy("ind_id", "side").agg(F.count("*").alias("crop_count"), F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"))
    return seen.withColumn("entity_id", F.concat_ws("-", F.col("ind_id").cast("string"), "side"))


def single_flank(found: DataFrame) -> DataFrame:
    """Individuals with one entity, and its side."""
    return found.groupBy("ind_id").agg(F.count("*").alias("n"), F.min("side").alias("side")).filter("n = 1").select("ind_id", "side")


def catalogue_health(individuals: DataFrame, found: DataFrame, assignments: DataFrame) -> DataFrame:
    """Sides, crops, automatic decisions and mean confidence of every individual, and its bucket by sides (0, 1, 2)."""
    sides = found.groupBy("ind_id").agg(F.countDistinct("side").alias("sides"), F.sum("crop_count").alias("crops"))
    decided = assignments.groupBy("ind_id").agg(F.count_if(F.col("decision") == "auto").alias("auto_count"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))
    joined = individuals.select("ind_id").join(sides, "ind_id", "left").join(decided, "ind_id", "left")
    return joined.na.fill(0, ["sides", "crops", "auto_count"])


def occupancy_inputs(captures: DataFrame) -> DataFrame:
    """Events, frames and times of each individual at each station; frames outside a burst are events of their own."""
    event = F.coalesce(F.col("event_id"), F.col("image_id").cast("string"))
    return captures.filter(F.col("station_id").isNotNull()).groupBy("ind_id", "station_id").agg(F.countDistinct(event).alias("event_count"), F.count("*").alias("frame_count"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))


def map_events(captures: DataFrame) -> DataFrame:
    """One row for each burst (or frame outside one) and individual; undated ones last."""
    event = F.coalesce(F.col("event_id"), F.col("image_id").cast("string")).alias("event_key")
    return captures.groupBy(event, "ind_id").agg(F.min("station_id").alias("station_id"), F.min("captured_at").alias("started_at"), F.count("*").alias("frames")).orderBy(F.col("started_at").asc_nulls_last(), "event_key", "ind_id")


def stations_with_state(stations: DataFrame, captures: DataFrame, activity: DataFrame, days: DataFrame, start: Column, end: Column) -> DataFrame:
    """Images in all and in a window, last capture, first start, days of effort, flags and the state of every station.

    Offline: was active before the window and has no effort in it, or under four fifths of it; new: installed in it;
    idle: no image at all.
    """
    inside = (F.col("captured_at") >= start) & (F.col("captured_at") < end)
    images = captures.groupBy("station_id").agg(F.count("*").alias("n_images"), F.max("captured_at").alias("last_capture"), F.count_if(inside).alias("n_in_window"))
    spans = activity.groupBy("station_id").agg(F.min("start_date").alias("first_start"), F.max(F.coalesce("end_date", F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00")))).alias("last_end"))
    joined = stations.select("station_id").join(images, "station_id", "left").join(spans, "station_id", "left").join(days, "station_id", "left")
    filled = joined.na.fill(0, ["n_images", "n_in_window"]).na.fill(0.0, ["days"])
    window = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000.0
    before = F.coalesce(F.col("first_start") < start, F.lit(False))
    flagged = filled.withColumns({"installed": F.coalesce(F.col("first_start") >= start, F.lit(False)), "active_before": before, "ended_early": before & (window > 0) & (F.col("days") < 0.8 * window)})
    return flagged.withColumn("state", station_state(F.col("days"), F.col("active_before"), F.col("ended_early"), F.col("installed"), F.col("n_images")))


def station_state(days: Column, before: Column, ended_early: Column, installed: Column, n_images: Column) -> Column:
    """The first state that holds: offline, new, idle, active."""
    return F.when((days == 0) & before, "offline").when(ended_early, "offline").when(installed, "new").when(F.coalesce(n_images, F.lit(0)) == 0, "idle").otherwise("active")


def drift(runs: DataFrame, images: DataFrame, assignments: DataFrame, queue: DataFrame, run: str, newest: int = 10) -> DataFrame:
    """Images and blanks (in quarantine) of the newest runs, each with the mean confidence of live automatic assignments and the open review items, of all runs."""
    counts = images.groupBy(run).agg(F.count("*").alias("n_images"), F.count_if(F.col("status") == "quarantined").alias("n_blank"))
    mean = live(assignments).filter("decision = 'auto'").agg(F.round(F.avg("confidence"), 3).alias("mean_auto_conf"))
    open_ = queue.agg(F.count_if(F.col("state") == "open").alias("review_open"))
    latest = runs.orderBy(F.col("started_at").desc(), run).limit(newest)
    return latest.join(counts, run, "left").na.fill(0, ["n_images", "n_blank"]).join(F.broadcast(mean), F.lit(True)).join(F.broadcast(open_), F.lit(True))


def pending_sync(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table that were changed and not yet sent."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count_if(F.col("lamport").isNotNull() & F.col("synced_at").isNull()).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def mixed_cameras(files: DataFrame) -> DataFrame:
    """Folders with more than one camera body; unreadable files and bodies without any name are skipped."""
    named = F.concat_ws("", "make", "model", "serial")
    bodies = files.filter(~F.coalesce(F.col("corrupt"), F.lit(False)) & (F.trim(named) != "")).groupBy("folder").agg(F.countDistinct(F.struct("make", "model", "serial")).alias("bodies"))
    return bodies.filter("bodies > 1")


def quarantine_savings(rows: DataFrame, seconds_each: float) -> DataFrame:
    """Frames in quarantine, hours of review and MB that they save; the bytes of restored ones count too."""
    n, restored = F.count("*"), F.count_if(F.col("restored_at").isNotNull())
    held = n - restored
    return rows.agg(n.alias("n"), restored.alias("restored"), F.round(held * seconds_each / 3600, 1).alias("hours"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1048576, 1).alias("mb"))


def first_starts(activity: DataFrame) -> DataFrame:
    return activity.groupBy("station_id").agg(F.min("start_date").alias("first_start"))


def largest_or(df: DataFrame, column: str, default: int) -> DataFrame:
    return df.agg(F.coalesce(F.max(column), F.lit(default)).alias("value"))


def without_partner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def with_partner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def page(df: DataFrame, order: list, offset: int, limit: int, most: int = 500) -> DataFrame:
    """A page in a total order; the limit is held between 1 and ``most``."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(most, limit)))


def keyset_page(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    return df.filter(F.col(key) > F.lit(cursor)).orderBy(key).limit(limit)


def severity_order(severity: Column) -> Column:
    return F.when(severity == "act", 0).when(severity == "watch", 1).otherwise(2)


def searched(log: DataFrame, text: str, columns: list[str], prefix: bool = False, **equal) -> DataFrame:
    """Rows in which a column holds (or starts with) the text, whatever its case, and others are equal to a value; nulls do not match."""
    hit = F.lit(False)
    for c in columns:
        value = F.lower(F.col(c).cast("string"))
        hit = hit | F.coalesce(F.startswith(value, F.lit(text.lower())) if prefix else F.contains(value, F.lit(text.lower())), F.lit(False))
    for c, wanted in sorted(equal.items()):
        hit = hit & F.coalesce(F.col(c) == wanted, F.lit(False))
    return log.filter(hit)


def evenly_spaced(frames: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Of each group, all rows or ``most`` ones at even distances from the first to the last.  Rows are numbered by blocks, so a large group is many tasks."""
    rows = numbered(frames, group, [order]).withColumn("_i", F.col("_i") - 1)
    # Row i is taken if some j in 0..most-1 has j * (n - 1) div (most - 1) = i; the least j that can is tried.
    j = F.expr(f"(_i * {most - 1} + greatest(_n - 2, 0)) div greatest(_n - 1, 1)")
    taken = (F.col("_n") <= most) | (F.expr(f"(_j * (_n - 1)) div {most - 1}") == F.col("_i"))
    return rows.withColumn("_j", j).filter(taken).select(*frames.columns)


def open_until(rows: DataFrame, column: str, until: Column) -> DataFrame:
    """Rows whose time is not after ``until``; those without a time count as before it."""
    return rows.filter(F.col(column).isNull() | (F.col(column) <= until))


def eligible_or_seen(eligible: DataFrame, seen: DataFrame, key: str = "ind_id") -> DataFrame:
    """The individuals of either table, each once."""
    return eligible.select(key).union(seen.select(key)).distinct()


def latest_of(rows: DataFrame, key: str, time: str, first: str) -> DataFrame:
    """key, ``first`` and ``time`` of each key's newest row, of equal times the greatest ``first``."""
    return rows.groupBy(key).agg(F.max_by(first, F.struct(time, first)).alias(first), F.max(time).alias(time))


def prior_centroids(runs: DataFrame, occupancy: DataFrame) -> DataFrame:
    """run_id, ind_id, prior_lat, prior_lon: the centroids of the run of the same reserve that started before, where there is one."""
    order = Window.partitionBy("reserve_id").orderBy("started_at", "run_id")
    prior = runs.select("run_id", F.lag("run_id").over(order).alias("_prior"))
    known = occupancy.filter("centroid_lat is not null and centroid_lon is not null")
    return prior.join(known.select(F.col("run_id").alias("_prior"), "ind_id", F.col("centroid_lat").alias("prior_lat"), F.col("centroid_lon").alias("prior_lon")), "_prior").drop("_prior")


def station_activity(activity: DataFrame, stations: DataFrame) -> DataFrame:
    """Intervals of activity with their station's name and place, by name and start."""
    return activity.join(stations.select("station_id", "name", "lat", "lon"), "station_id").orderBy("name", "start_date", "activity_id")


def run_dashboard(run_id, images: DataFrame, animal: Column, alerts: DataFrame, time_source: str = "time_source", flags: str = "flags") -> dict[str, DataFrame]:
    """What a run's first screen tells: its counts, where its times come from, its flags and its alerts, each a small table."""
    from tracklake.operators.review import alert_counts

    own = images.filter(F.col("run_id") == F.lit(run_id))
    return {
        "counts": run_counts(own, "run_id", "status", animal),
        "timestamp_sources": counted(own, time_source).orderBy(F.col("n").desc(), time_source),
        "flags": flag_counts(own, flags).orderBy(F.col("n").desc(), "flag"),
        "alerts": alert_counts(alerts.filter(F.col("run_id") == F.lit(run_id))),
    }
