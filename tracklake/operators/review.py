"""The capture spine, the review queue and run dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import geo
from tracklake.operators import identity


def spine(images: DataFrame, detections: DataFrame, crops: DataFrame, assignments: DataFrame, live_only: bool = True) -> DataFrame:
    """images, detections, crops and assignments joined along their keys; by default without superseded assignments."""
    kept = assignments.filter("superseded_by is null") if live_only else assignments
    return images.join(detections, "image_id").join(crops, "det_id").join(kept, "crop_id")


def detections_of_runs(images: DataFrame, detections: DataFrame, events: DataFrame, crops: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every detection, with burst, crop and live assignment where there are some; several crops or bursts give several rows."""
    current = assignments.filter("superseded_by is null").select("crop_id", "ind_id")
    return images.join(detections, "image_id").join(events, "image_id", "left").join(crops, "det_id", "left").join(current, "crop_id", "left")


def review_page(queue: DataFrame, user: str, offset: int, limit: int) -> DataFrame:
    """Open items and the user's own claims, by priority, then id; 200 a page at most."""
    visible = (F.col("state") == "open") | ((F.col("state") == "claimed") & F.coalesce(F.col("claimed_by") == user, F.lit(False)))
    return queue.filter(visible).orderBy(F.col("priority").desc(), "queue_id").offset(max(0, offset)).limit(max(1, min(200, limit)))


def queue_counts(queue: DataFrame, user: str) -> DataFrame:
    """Items in all, open, and held by the user."""
    held = (F.col("state") == "claimed") & F.coalesce(F.col("claimed_by") == user, F.lit(False))
    return queue.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "open").alias("open"), F.count_if(held).alias("held"))


def candidate_list(scores: DataFrame, k: int) -> DataFrame:
    """query_id, candidates (JSON, best first, scores to 4 places) and priority (best score or 0)."""
    ranked = scores.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ind_id"))).filter(F.col("_r") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_r", "ind_id", F.round("score", 4).alias("score"))))
    return ranked.groupBy("query_id").agg(F.to_json(F.transform(listed, lambda c: F.struct(c["ind_id"].alias("ind_id"), c["score"].alias("score")))).alias("candidates"), F.coalesce(F.max("score"), F.lit(0.0)).alias("priority"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(~F.col("suppressed")).alias("shown"), F.count_if(F.col("suppressed")).alias("held_back"), F.count_if((F.col("severity") == "act") & ~F.col("suppressed")).alias("act"))


def alerts_by_type(alerts: DataFrame) -> DataFrame:
    """Alerts by type; suppressed ones under the type's name with a suffix."""
    name = F.when(F.col("suppressed"), F.concat("type", F.lit("_suppressed"))).otherwise(F.col("type"))
    return alerts.groupBy(name.alias("kind")).agg(F.count("*").alias("n"))


def outcome_counts(rows: DataFrame, outcome: str, order: str, error: str) -> DataFrame:
    """Rows by outcome and the first error of each."""
    return rows.groupBy(outcome).agg(F.count("*").alias("n"), F.min_by(error, F.when(F.col(error).isNotNull(), F.col(order))).alias("first_error"))


def signal_ranges(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("high"))


def dominant_zone(rows: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    """buffer where over half of a row's stations lie there, else core."""
    share = F.avg((F.col("zone") == "buffer").cast("int"))
    return rows.join(stations.select("station_id", "zone"), "station_id").groupBy(*keys).agg(F.when(share > 0.5, "buffer").otherwise("core").alias("zone"))


def station_changes(sets: DataFrame, key: str, order: str, stations: str) -> DataFrame:
    """For every row of an individual: stations new against all earlier rows, and those used again."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.array_distinct(F.flatten(F.collect_list(stations).over(past)))
    df = sets.withColumn("_seen", seen)
    return df.select(key, order, F.sort_array(F.array_except(stations, "_seen")).alias("fresh"), F.sort_array(F.array_intersect(stations, "_seen")).alias("again"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit perceptual hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def generalised_for_role(rows: DataFrame, role: str, roles: tuple[str, ...] = ("analyst",), cell_km: float = 2.0) -> DataFrame:
    """Positions on a grid, and no hull, for roles that may not see points."""
    if role not in roles:
        return rows
    out = rows.withColumn("lat", geo.generalised(F.col("lat"), cell_km)).withColumn("lon", geo.generalised(F.col("lon"), cell_km))
    return out.withColumn("hull_wkt", F.lit(None).cast("string")) if "hull_wkt" in rows.columns else out


#: Fixed value: what a match by the folder's name alone is worth.
FUZZY_SCORE = 0.65


def best_station_match(folders: DataFrame, stations: DataFrame, score: Column, accept: float = 0.75, most_edits: int = 2) -> DataFrame:
    """folder, station_id, score, signal: the best station of each distinct folder from ``accept`` on (``signals``), else the one that is called like the folder (``folder_fuzzy``).

    On ties the first by ``place`` counts.  A stated set of distinct folders meets the stations of its own reserve: both
    carry reserve_id, which is the join key.
    """
    pairs = folders.join(stations, "reserve_id").withColumn("score", score)
    best = pairs.groupBy("reserve_id", "folder").agg(F.max_by("station_id", F.struct("score", -F.col("place"))).alias("station_id"), F.max("score").alias("score"))
    sure = best.filter(F.col("score") >= accept).withColumn("signal", F.lit("signals"))
    rest = folders.select("reserve_id", F.col("folder").alias("name")).distinct().join(sure.select("reserve_id", F.col("folder").alias("name")), ["reserve_id", "name"], "left_anti")
    called = identity.fuzzy_station(rest, stations, most_edits, "reserve_id", "place")
    return sure.unionByName(called.select("reserve_id", F.col("name").alias("folder"), "station_id", F.lit(FUZZY_SCORE).alias("score"), F.lit("folder_fuzzy").alias("signal"))).drop("reserve_id")


def individual_events(events: DataFrame, members: DataFrame, images: DataFrame, detections: DataFrame, crops: DataFrame, assignments: DataFrame) -> DataFrame:
    """The bursts (event_id, station_id, started_at, ended_at) in which an individual was caught: one row an individual and burst, by individual and start.

    ``members``: image_id, event_id.  Superseded assignments count too, as a burst's history is what is asked for.
    """
    caught = spine(images.select("image_id"), detections.select("det_id", "image_id"), crops.select("crop_id", "det_id"), assignments, live_only=False).select("image_id", "ind_id")
    each = caught.join(members.select("image_id", "event_id"), "image_id").select("ind_id", "event_id").distinct()
    return each.join(events.select("event_id", "station_id", "started_at", "ended_at"), "event_id").orderBy("ind_id", "started_at", "event_id")


def mean_confidences(images: DataFrame, detections: DataFrame, crops: DataFrame, assignments: DataFrame) -> DataFrame:
    """run_id, ind_id and the mean confidence of the live assignments, to 3 places."""
    rows = spine(images.select("image_id", "run_id"), detections.select("det_id", "image_id"), crops.select("crop_id", "det_id"), assignments)
    return rows.groupBy("run_id", "ind_id").agg(F.round(F.avg("confidence"), 3).alias("mean_confidence"))
