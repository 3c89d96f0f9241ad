"""Survey tables derived from the driver's tables, in Spark and in SQL with the same arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators.segments import numbered

BURST_SECONDS = 6 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str, station: Column | None = None, individual: Column | None = None) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("image_id"),
        (F.col("user_id") % 36 if station is None else station).alias("station_id"),
        (F.col("user_id") % 13 if individual is None else individual).alias("ind_id"),
        F.col("ts").alias("captured_at"),
        F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")).alias("run_id"),
        F.col("event_type").alias("status"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        k.alias("k"),
        F.when(k % 2 == 0, "L").otherwise("R").alias("side"),
    )


#: Individuals of ``visits``.
N_INDIVIDUALS = 1009


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captures dealt to many individuals, each of which comes to some stations only."""
    user = F.col("user_id")
    return captures(spark, sf_dir, (user + F.get_json_object("props", "$.k").cast("int")) % 36, user % N_INDIVIDUALS)


def stations(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    s = F.col("station_id")
    zone = F.when(s % 6 <= 3, "core").when(s % 6 == 4, "corridor").otherwise("buffer")
    return spark.range(36).select(F.col("id").alias("station_id")).select(
        s, F.concat(F.lit("STN_"), s.cast("string")).alias("name"), (21.5 + F.floor(s / 6) * 0.02).alias("lat"), (79.2 + (s % 6) * 0.02).alias("lon"), zone.alias("zone"), (0.5 + s % 7).alias("village_dist_km")
    )


def activity(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    s = F.col("station_id")
    day = lambda first, n: F.dateadd(F.to_date(F.lit(first)), n.cast("int")).cast("timestamp_ntz")
    return spark.range(36).select(F.col("id").alias("station_id")).select(
        s.alias("activity_id"), s, day("2024-01-01", s % 4).alias("start_date"), F.when(s % 5 != 0, day("2024-01-30", -(s % 6))).alias("end_date")
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station for every supplier."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    zone = F.when(n % 6 <= 3, "core").when(n % 6 == 4, "corridor").otherwise("buffer")
    return table(spark, sf_dir, "supplier").select(
        s.alias("station_id"), F.col("s_name").alias("name"), (21.5 + F.floor(s / 40) * 0.02).alias("lat"), (79.2 + (s % 40) * 0.02).alias("lon"), zone.alias("zone"), (0.5 + s % 7).alias("village_dist_km")
    )


def site_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two intervals for every site."""
    s = F.col("s_suppkey")
    day = lambda first, n: F.dateadd(F.to_date(F.lit(first)), n.cast("int")).cast("timestamp_ntz")
    own = table(spark, sf_dir, "supplier").select(s.alias("activity_id"), s.alias("station_id"), day("2024-01-01", s % 4).alias("start_date"), F.when(s % 5 != 0, day("2024-01-30", -(s % 6))).alias("end_date"))
    return own.unionByName(own.filter("station_id % 3 = 0").select((F.col("activity_id") + 1_000_000).alias("activity_id"), "station_id", (F.col("start_date") - F.expr("INTERVAL 9 DAYS")).alias("start_date"), F.col("start_date").alias("end_date")))


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every priority, as a reserve, and month of the orders."""
    month = F.date_format("o_orderdate", "yyyyMM").cast("int")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("reserve_id"), month.alias("run_id")).agg(F.min("o_orderdate").cast("timestamp_ntz").alias("started_at"))


def in_order(df: DataFrame) -> DataFrame:
    """A sorted table with each row's place, from 1."""
    rows = numbered(df.withColumns({"_all": F.lit(0), "_at": F.monotonically_increasing_id()}), "_all", ["_at"])
    return rows.select(*df.columns, F.col("_i").alias("place"))


def runs(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.range(3).select(F.col("id").cast("int").alias("run_id"), F.lit("R").alias("reserve_id"), F.dateadd(F.to_date(F.lit("2024-01-01")), (F.col("id") * 10).cast("int")).cast("timestamp_ntz").alias("started_at"))


SQL = """
captures AS (
  SELECT event_id AS image_id, user_id % 36 AS station_id, user_id % 13 AS ind_id, ts AS captured_at,
         CAST(least(2, (day(ts) - 1) // 10) AS INTEGER) AS run_id, event_type AS status, least(1.0, value / 100) AS confidence,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'L' ELSE 'R' END AS side
  FROM events),
visits AS (
  SELECT c.* REPLACE ((user_id + k) % 36 AS station_id, user_id % 1009 AS ind_id) FROM captures c JOIN events ON event_id = image_id),
stations AS (
  SELECT s AS station_id, 'STN_' || s AS name, 21.5 + (s // 6) * 0.02::DOUBLE AS lat, 79.2 + (s % 6) * 0.02::DOUBLE AS lon,
         CASE WHEN s % 6 <= 3 THEN 'core' WHEN s % 6 = 4 THEN 'corridor' ELSE 'buffer' END AS zone, 0.5::DOUBLE + s % 7 AS village_dist_km
  FROM range(36) t(s)),
activity AS (
  SELECT s AS activity_id, s AS station_id, TIMESTAMP '2024-01-01' + to_days(CAST(s % 4 AS INTEGER)) AS start_date,
         CASE WHEN s % 5 <> 0 THEN TIMESTAMP '2024-01-30' - to_days(CAST(s % 6 AS INTEGER)) END AS end_date
  FROM range(36) t(s)),
sites AS (
  SELECT s_suppkey AS station_id, s_name AS name, 21.5 + (s_suppkey // 40) * 0.02::DOUBLE AS lat, 79.2 + (s_suppkey % 40) * 0.02::DOUBLE AS lon,
         CASE WHEN s_nationkey % 6 <= 3 THEN 'core' WHEN s_nationkey % 6 = 4 THEN 'corridor' ELSE 'buffer' END AS zone, 0.5::DOUBLE + s_suppkey % 7 AS village_dist_km
  FROM supplier),
first_activity AS (
  SELECT s_suppkey AS activity_id, s_suppkey AS station_id, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 4 AS INTEGER)) AS start_date,
         CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2024-01-30' - to_days(CAST(s_suppkey % 6 AS INTEGER)) END AS end_date
  FROM supplier),
site_activity AS (
  FROM first_activity UNION ALL SELECT activity_id + 1000000, station_id, start_date - INTERVAL 9 DAY, start_date FROM first_activity WHERE station_id % 3 = 0),
order_runs AS (
  SELECT o_orderpriority AS reserve_id, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS run_id, CAST(min(o_orderdate) AS TIMESTAMP) AS started_at FROM orders GROUP BY 1, 2),
runs AS (SELECT CAST(c AS INTEGER) AS run_id, 'R' AS reserve_id, TIMESTAMP '2024-01-01' + to_days(CAST(10 * c AS INTEGER)) AS started_at FROM range(3) t(c)),
periods AS (
  SELECT run_id, started_at AS period_start,
         coalesce(lead(started_at) OVER (ORDER BY started_at), started_at + (started_at - lag(started_at) OVER (ORDER BY started_at))) AS period_end
  FROM runs),
bursts AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY station_id ORDER BY captured_at, image_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_no
  FROM (SELECT *, CASE WHEN captured_at - lag(captured_at) OVER (PARTITION BY station_id ORDER BY captured_at, image_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM captures)),
vbursts AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY station_id ORDER BY captured_at, image_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_no
  FROM (SELECT *, CASE WHEN captured_at - lag(captured_at) OVER (PARTITION BY station_id ORDER BY captured_at, image_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM visits)),
station_days AS (
  SELECT station_id, run_id, round(sum(epoch_us(least(coalesce(end_date, period_end), period_end)) - epoch_us(greatest(start_date, period_start))) / 86400000000.0, 2) AS days
  FROM activity, periods WHERE least(coalesce(end_date, period_end), period_end) > greatest(start_date, period_start) GROUP BY station_id, run_id)
"""


def sql(body: str) -> str:
    """``body`` over the derived tables; a body may start with more common table expressions."""
    more = body.startswith("-- more\n")
    return f"WITH {SQL.strip()}{',' if more else ''}\n{body.removeprefix('-- more')}"
