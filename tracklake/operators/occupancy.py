"""Home ranges: centroids, hulls and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.config import SETTINGS
from tracklake.functions import geo


def centroids(inputs: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid of an individual's stations, weighted by events."""
    placed = inputs.join(stations.select("station_id", "lat", "lon"), "station_id")
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("event_count")) / F.sum("event_count"), 5)
    return placed.groupBy(*keys).agg(weighted("lat").alias("centroid_lat"), weighted("lon").alias("centroid_lon"), F.sum("event_count").alias("event_count"))


def occupancy(inputs: DataFrame, stations: DataFrame, days: DataFrame, eligible: DataFrame, epsg: int = SETTINGS.utm_epsg) -> DataFrame:
    """One row for each run and individual of ``eligible`` or ``inputs`` (run_id, ind_id, station_id, event_count).

    Individuals without captures in a run get a row with no events and a reason.  Under three stations, or stations in a
    line, there is no hull, and the reason says so.  An individual's stations are as many as the reserve has, so they
    are gathered; its captures never are.
    """
    keys = ["run_id", "ind_id"]
    east, north = geo.utm(F.col("lat"), F.col("lon"), epsg)  # once a station, not once a corner of every hull
    spots = stations.select("station_id", "lat", "lon", east.alias("x"), north.alias("y"))
    placed = inputs.join(spots, "station_id").join(days, ["station_id", "run_id"], "left")
    grouped = placed.groupBy(*keys).agg(
        F.sort_array(F.collect_set("station_id")).alias("station_set"),
        F.sort_array(F.collect_list(F.struct("lat", "lon", "x", "y"))).alias("points"),
        F.round(F.sum(F.col("lat") * F.col("event_count")) / F.sum("event_count"), 5).alias("centroid_lat"),
        F.round(F.sum(F.col("lon") * F.col("event_count")) / F.sum("event_count"), 5).alias("centroid_lon"),
        F.sum("event_count").alias("event_count"),
        F.round(F.sum(F.coalesce("days", F.lit(0.0))), 2).alias("effort_days"),
    )
    hulled = grouped.withColumn("hull", F.when(F.size("station_set") >= SETTINGS.min_stations_for_hull, geo.convex_hull(F.col("points"))))
    shaped = hulled.withColumn("area_km2", geo.ring_area_km2(F.col("hull")))
    everyone = eligible.select(*keys).union(inputs.select(*keys)).distinct()
    joined = everyone.join(shaped, keys, "left")
    reason = (
        F.when(F.col("event_count").isNull(), "no captures this cycle")
        .when(F.size("station_set") < SETTINGS.min_stations_for_hull, F.concat(F.lit("only "), F.size("station_set").cast("string"), F.lit(" stations")))
        .when(F.col("area_km2").isNull(), "stations lie in a line")
    )
    return joined.select(
        *keys,
        F.coalesce("station_set", F.array().cast("array<bigint>")).alias("station_set"),
        geo.wkt(F.when(F.col("area_km2").isNotNull(), F.col("hull"))).alias("hull_wkt"),
        "area_km2",
        "centroid_lat",
        "centroid_lon",
        F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"),
        F.coalesce("effort_days", F.lit(0.0)).alias("effort_days"),
        reason.alias("insufficient_reason"),
    )
