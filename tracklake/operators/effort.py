"""Survey effort: interval joins on a station key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_reserves(df: DataFrame) -> DataFrame:
    """``df`` with a reserve_id; a table without one is about a single reserve."""
    return df if "reserve_id" in df.columns else df.withColumn("reserve_id", F.lit(""))


BUCKET = 32 * 86_400_000_000  # microseconds


def _bucketed(df: DataFrame, low: str, high: str) -> DataFrame:
    """One row for each bucket of time that [low, high) touches, cut to it."""
    buckets = F.sequence(F.floor(F.col(low) / BUCKET), F.floor((F.col(high) - 1) / BUCKET))
    each = df.filter(F.col(high) > F.col(low)).withColumn("bucket", F.explode(buckets))
    return each.withColumn(low, F.greatest(low, F.col("bucket") * BUCKET)).withColumn(high, F.least(high, (F.col("bucket") + 1) * BUCKET))


def station_days(activity: DataFrame, periods: DataFrame) -> DataFrame:
    """station_id, run_id, days: active days of a station in each period (run_id, period_start, period_end), rounded to 2 places.

    Overlapping intervals count twice; an open end lasts on.  Intervals and periods meet by buckets of time, in which
    the overlaps are exact and add up, so no station is paired with periods that it has nothing to do with.  Where both
    tables have a reserve_id, stations meet the periods of their own reserve alone.
    """
    if not {"reserve_id"} <= set(activity.columns) & set(periods.columns):
        activity, periods = activity.withColumn("reserve_id", F.lit("")), periods.withColumn("reserve_id", F.lit(""))
    ends = periods.agg(F.unix_micros(F.max("period_end").cast("timestamp")).alias("last")).first()["last"] or 0
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    active = activity.select("station_id", "reserve_id", micros("start_date").alias("a_low"), F.least(F.coalesce(micros("end_date"), F.lit(ends)), F.lit(ends)).alias("a_high"))
    spans = periods.select("run_id", "reserve_id", micros("period_start").alias("p_low"), micros("period_end").alias("p_high"))
    met = _bucketed(active, "a_low", "a_high").join(_bucketed(spans, "p_low", "p_high"), ["reserve_id", "bucket"])
    shared = F.least("a_high", "p_high") - F.greatest("a_low", "p_low")
    return met.filter(shared > 0).groupBy("station_id", "run_id").agg(F.round(F.sum(shared) / 86_400_000_000.0, 2).alias("days"))


def coverage(history: DataFrame, days: DataFrame, periods: DataFrame) -> DataFrame:
    """run_id, ind_id, coverage: effort of the run's period over the individual's earlier stations, against the mean of the earlier periods.

    ``history`` has (run_id, ind_id, station_id): stations used before each run.  Null where nothing was active before.
    Periods with a reserve_id are compared within their reserve.
    """
    order = in_reserves(periods).select(F.col("run_id").alias("p_run"), "period_start", "reserve_id")
    each = history.join(days.withColumnRenamed("run_id", "d_run"), "station_id")
    totals = each.groupBy("run_id", "ind_id", "d_run").agg(F.round(F.sum("days"), 2).alias("total"))
    dated = totals.join(order.withColumnsRenamed({"period_start": "own_start", "reserve_id": "own_reserve"}), F.col("run_id") == F.col("p_run")).drop("p_run")
    dated = dated.join(order.withColumnRenamed("period_start", "d_start"), (F.col("d_run") == F.col("p_run")) & F.col("reserve_id").eqNullSafe(F.col("own_reserve"))).drop("p_run")
    earlier = Window.partitionBy("reserve_id").orderBy("period_start").rowsBetween(Window.unboundedPreceding, -1)
    n_before = order.select(F.col("p_run").alias("n_run"), F.count("*").over(earlier).alias("n_before"))
    summed = dated.groupBy("run_id", "ind_id").agg(F.sum(F.when(F.col("d_run") == F.col("run_id"), F.col("total"))).alias("now"), F.sum(F.when(F.col("d_start") < F.col("own_start"), F.col("total"))).alias("before"))
    joined = summed.join(n_before, F.col("run_id") == F.col("n_run")).drop("n_run")
    baseline = F.col("before") / F.col("n_before")
    return joined.select("run_id", "ind_id", F.when(baseline > 0, F.round(F.coalesce("now", F.lit(0.0)) / baseline, 3)).alias("coverage"))


def deployment_of(captures: DataFrame, activity: DataFrame) -> DataFrame:
    """``captures`` with activity_id: the first interval of the station, by start, that holds the time (both ends included); else the station's earliest; else null."""
    order = F.struct("start_date", "activity_id")
    first = activity.groupBy("station_id").agg(F.min(order)["activity_id"].alias("_earliest"), F.sort_array(F.collect_list(F.struct("start_date", "activity_id", "end_date"))).alias("_intervals"))
    # A station has few intervals: they come as one list, and its captures meet them where they are.
    holds = lambda i: (i["start_date"] <= F.col("captured_at")) & (i["end_date"].isNull() | (F.col("captured_at") <= i["end_date"]))
    own = F.try_element_at(F.filter("_intervals", holds), F.lit(1))["activity_id"]
    joined = captures.join(first, "station_id", "left")
    return joined.select(*captures.columns, F.coalesce(own, "_earliest").alias("activity_id"))
