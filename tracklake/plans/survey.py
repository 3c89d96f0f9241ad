"""Queries over captures, stations and individuals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import geo
from tracklake.functions.text import filename_timestamp, levenshtein_ratio, normalised, short_id
from tracklake.operators import catalogue, effort, identity, sessions
from tracklake.plans import derived as d
from tracklake.plans.derived import BURST_SECONDS, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return register


def bursts(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.burst_sessions(d.captures(spark, sf), BURST_SECONDS)


def visit_bursts(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.burst_sessions(d.visits(spark, sf), BURST_SECONDS)


def periods(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.cycle_periods(d.runs(spark), 90)


@query(sql("SELECT station_id, event_no, min(captured_at) AS started_at, max(captured_at) AS ended_at, count(*) AS frames FROM bursts GROUP BY station_id, event_no"))
def burst_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return bursts(spark, sf).groupBy("station_id", "event_no").agg(F.min("captured_at").alias("started_at"), F.max("captured_at").alias("ended_at"), F.count("*").alias("frames"))


@query(sql("""SELECT station_id, 'ev_' || substr(sha256(station_id || '|' || string_agg(CAST(image_id AS VARCHAR), '|' ORDER BY captured_at, image_id)), 1, 16) AS event_id, count(*) AS frames
FROM bursts GROUP BY station_id, event_no"""))
def burst_event_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.burst_events(d.captures(spark, sf), BURST_SECONDS).select("station_id", "event_id", "frames")


@query(sql("SELECT ind_id, station_id, count(DISTINCT event_no) AS event_count, count(*) AS frame_count, min(captured_at) AS first_at, max(captured_at) AS last_at FROM bursts GROUP BY ind_id, station_id"))
def occupancy_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.occupancy_inputs(bursts(spark, sf).withColumn("event_id", F.concat_ws("-", F.col("station_id").cast("string"), F.col("event_no").cast("string"))))


@query(sql("""SELECT ind_id, round(sum(lat * n) / sum(n), 5) AS centroid_lat, round(sum(lon * n) / sum(n), 5) AS centroid_lon, CAST(sum(n) AS BIGINT) AS event_count
FROM (SELECT ind_id, station_id, count(DISTINCT event_no) AS n FROM bursts GROUP BY ind_id, station_id) JOIN stations USING (station_id) GROUP BY ind_id"""))
def weighted_centroid(spark: SparkSession, sf: str) -> DataFrame:
    from tracklake.operators.occupancy import centroids

    return centroids(occupancy_inputs(spark, sf), d.stations(spark), ["ind_id"])


#: Status and triage stage of a capture by its number k.
_STATUSES = ("blank", "person", "vehicle", "corrupt", "quarantined", "identified", "CORRUPT")
STATUS_SQL = f"{list(_STATUSES)!r}[k % 7 + 1] AS status, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS stage"


def with_statuses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    status = F.element_at(F.array(*[F.lit(x) for x in _STATUSES]), (k % 7 + 1).cast("int"))
    return d.captures(spark, sf).withColumn("status", status).withColumn("stage", F.when(k % 3 == 0, "A").when(k % 3 == 1, "B"))


@query(sql(f"""SELECT run_id, count(*) AS n_images, {", ".join(f"count(*) FILTER (status = '{x}') AS n_{x}" for x in _STATUSES[:5])},
count(*) FILTER (stage = 'A') AS n_stage_a, count(*) FILTER (stage = 'B') AS n_stage_b, count(DISTINCT image_id) FILTER (k >= 50) AS n_animal
FROM (SELECT image_id, run_id, k, {STATUS_SQL} FROM captures) GROUP BY run_id"""))
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.run_counts(with_statuses(spark, sf), "run_id", "status", F.col("k") >= 50, stage="stage")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.counted(d.captures(spark, sf), "status")


@query(sql("SELECT CASE WHEN k % 4 = 0 THEN 'exif' WHEN k % 4 = 1 THEN 'filename' WHEN k % 4 = 2 THEN 'inferred' END AS source, count(*) AS n FROM captures GROUP BY 1"))
def timestamp_sources(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("k") % 4 == 0, "exif").when(F.col("k") % 4 == 1, "filename").when(F.col("k") % 4 == 2, "inferred")
    return catalogue.counted(d.captures(spark, sf).withColumn("source", source), "source")


@query(sql("""SELECT flag, count(*) AS n FROM (SELECT unnest(CASE WHEN k % 10 = 0 THEN [] WHEN k % 2 = 0 THEN ['even', status] ELSE ['odd'] END) AS flag FROM captures) GROUP BY flag"""))
def flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    flags = F.when(k % 10 == 0, "{broken").when(k % 2 == 0, F.to_json(F.array(F.lit("even"), F.col("status")))).otherwise('["odd"]')
    return catalogue.flag_counts(d.captures(spark, sf).withColumn("flags", flags), "flags")


@query(sql("SELECT station_id, count(image_id) AS n_images FROM stations LEFT JOIN captures USING (station_id) GROUP BY station_id"))
def station_image_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.station_image_counts(d.stations(spark), d.captures(spark, sf))


@query(sql("""SELECT ind_id, count(*) AS crop_count, count(DISTINCT station_id) AS station_count, string_agg(DISTINCT side, ',' ORDER BY side) AS sides, round(avg(confidence), 4) AS mean_confidence,
min(captured_at) AS first_seen, max(captured_at) AS last_seen FROM captures GROUP BY ind_id"""))
def individuals_summary(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.individuals_summary(d.captures(spark, sf))


@query(sql("SELECT ind_id, side, ind_id || '-' || side AS entity_id, count(*) AS crop_count, min(captured_at) AS first_seen, max(captured_at) AS last_seen FROM captures GROUP BY ind_id, side"))
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.entities(d.captures(spark, sf))


@query(sql("SELECT image_id % 7919 AS ind_id, min(side) AS side FROM captures GROUP BY 1 HAVING count(DISTINCT side) = 1"))
def single_flank(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.single_flank(catalogue.entities(d.captures(spark, sf).withColumn("ind_id", F.col("image_id") % 7919)))


@query(sql("""SELECT i.ind_id, coalesce(e.sides, 0) AS sides, CAST(coalesce(e.crops, 0) AS BIGINT) AS crops, coalesce(a.n, 0) AS auto_count, a.m AS mean_confidence FROM (SELECT range AS ind_id FROM range(15)) i
LEFT JOIN (SELECT ind_id, count(DISTINCT side) AS sides, count(*) AS crops FROM captures GROUP BY ind_id) e USING (ind_id)
LEFT JOIN (SELECT ind_id, count(*) FILTER (confidence >= 0.95) AS n, round(avg(confidence), 3) AS m FROM captures GROUP BY ind_id) a USING (ind_id)"""))
def catalogue_health(spark: SparkSession, sf: str) -> DataFrame:
    all_ = d.captures(spark, sf)
    decided = all_.withColumn("decision", F.when(F.col("confidence") >= 0.95, "auto").otherwise("review"))
    return catalogue.catalogue_health(spark.range(15).withColumnRenamed("id", "ind_id"), catalogue.entities(all_), decided)


@query(sql("SELECT station_id || '-' || event_no AS event_key, ind_id, min(station_id) AS station_id, min(captured_at) AS started_at, count(*) AS frames FROM bursts GROUP BY 1, 2"))
def map_events(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.map_events(bursts(spark, sf).withColumn("event_id", F.concat_ws("-", F.col("station_id").cast("string"), F.col("event_no").cast("string"))))


@query(sql("""SELECT image_id, ind_id, station_id, name, zone, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY k, station_id, ind_id ORDER BY captured_at DESC, image_id DESC) AS r FROM captures) JOIN stations USING (station_id) WHERE r = 1"""))
def live_captures(spark: SparkSession, sf: str) -> DataFrame:
    """A capture supersedes earlier ones of its bucket; the live ones with their station."""
    later = F.lead("image_id").over(Window.partitionBy("k", "station_id", "ind_id").orderBy("captured_at", "image_id"))
    assigned = d.captures(spark, sf).withColumn("superseded_by", later)
    return catalogue.live(assigned).join(d.stations(spark), "station_id").select("image_id", "ind_id", "station_id", "name", "zone", "captured_at")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def pending_anti(spark: SparkSession, sf: str) -> DataFrame:
    large = d.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalogue.without_partner(d.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), large, "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)")
def partner_semi(spark: SparkSession, sf: str) -> DataFrame:
    open_ = d.table(spark, sf, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return catalogue.with_partner(d.table(spark, sf, "customer").select("c_custkey", "c_name"), open_, "c_custkey")


@query(sql("""SELECT station_id, run_id, round(sum(epoch_us(least(coalesce(end_date, period_end), period_end)) - epoch_us(greatest(start_date, period_start))) / 86400000000.0, 2) AS days
FROM site_activity, periods WHERE least(coalesce(end_date, period_end), period_end) > greatest(start_date, period_start) GROUP BY station_id, run_id"""))
def effort_days(spark: SparkSession, sf: str) -> DataFrame:
    return effort.station_days(d.site_activity(spark, sf), periods(spark, sf)).select("station_id", "run_id", "days")


def survey_days(spark: SparkSession, sf: str) -> DataFrame:
    return effort.station_days(d.activity(spark), periods(spark, sf))


@query(sql("""SELECT reserve_id, run_id, started_at AS period_start, coalesce(lead(started_at) OVER w, started_at + coalesce(started_at - lag(started_at) OVER w, INTERVAL 90 DAY)) AS period_end
FROM order_runs WINDOW w AS (PARTITION BY reserve_id ORDER BY started_at, run_id)"""))
def cycle_periods(spark: SparkSession, sf: str) -> DataFrame:
    out = sessions.cycle_periods(d.order_runs(spark, sf), 90)
    return out.select("reserve_id", "run_id", F.col("period_start").cast("timestamp_ntz").alias("period_start"), F.col("period_end").cast("timestamp_ntz").alias("period_end"))


def earlier_stations(spark: SparkSession, sf: str) -> DataFrame:
    used = d.visits(spark, sf).select("run_id", "ind_id", "station_id").distinct()
    return used.filter("run_id < 2").withColumn("run_id", F.explode(F.sequence(F.col("run_id") + 1, F.lit(2)))).distinct()


@query(sql("""-- more
hist AS (SELECT DISTINCT r.run_id, ind_id, station_id FROM visits c JOIN runs r ON c.run_id < r.run_id),
tot AS (SELECT h.run_id, h.ind_id, s.run_id AS d_run, round(sum(days), 2) AS total FROM hist h JOIN station_days s USING (station_id) GROUP BY 1, 2, 3)
SELECT run_id, ind_id, round(coalesce(sum(total) FILTER (d_run = run_id), 0) / (sum(total) FILTER (d_run < run_id) / run_id), 3) AS coverage FROM tot GROUP BY run_id, ind_id"""))
def effort_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return effort.coverage(earlier_stations(spark, sf), survey_days(spark, sf), periods(spark, sf))


@query(sql("""-- more
c AS (SELECT image_id, c.station_id, a.activity_id, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN start_date <= captured_at AND (end_date IS NULL OR captured_at <= end_date) THEN 0 ELSE 1 END, start_date, activity_id) AS r
FROM captures c LEFT JOIN (SELECT station_id, activity_id, start_date, end_date FROM activity UNION ALL SELECT station_id, 100 + activity_id, start_date + INTERVAL 40 DAY, NULL FROM activity) a ON a.station_id = c.station_id)
SELECT image_id, station_id, activity_id FROM c WHERE r = 1"""))
def deployment_for(spark: SparkSession, sf: str) -> DataFrame:
    own = d.activity(spark)
    later = own.select((F.col("activity_id") + 100).alias("activity_id"), "station_id", (F.col("start_date") + F.expr("INTERVAL 40 DAYS")).alias("start_date"), F.lit(None).cast("timestamp_ntz").alias("end_date"))
    return effort.deployment_of(d.captures(spark, sf), own.unionByName(later)).select("image_id", "station_id", "activity_id")


@query(sql("""-- more
t AS (SELECT *, epoch_us(captured_at) // 1000000 AS s FROM captures),
p AS (SELECT a.image_id, b.image_id AS neighbour_id, abs(a.s - b.s) AS apart FROM t a JOIN t b ON a.run_id = b.run_id AND a.station_id = b.station_id AND a.side <> b.side AND abs(a.s - b.s) <= 3600)
SELECT image_id, neighbour_id, apart FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY apart, neighbour_id) AS r FROM p) WHERE r = 1"""))
def nearest_opposite_side(spark: SparkSession, sf: str) -> DataFrame:
    return identity.nearest_opposite(d.captures(spark, sf), 3600, ["run_id", "station_id"])


@query(sql("""-- more
c AS (SELECT run_id, ind_id, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon FROM captures JOIN stations USING (station_id) GROUP BY 1, 2)
SELECT r.run_id, c.ind_id, c.lat AS prior_lat, c.lon AS prior_lon FROM (SELECT run_id, lag(run_id) OVER (ORDER BY started_at) AS prior FROM runs) r JOIN c ON c.run_id = r.prior"""))
def prior_centroids(spark: SparkSession, sf: str) -> DataFrame:
    placed = d.captures(spark, sf).join(d.stations(spark).select("station_id", "lat", "lon"), "station_id")
    centers = placed.groupBy("run_id", "ind_id").agg(F.round(F.avg("lat"), 5).alias("centroid_lat"), F.round(F.avg("lon"), 5).alias("centroid_lon"))
    return catalogue.prior_centroids(d.runs(spark), centers).select("run_id", "ind_id", "prior_lat", "prior_lon")


@query(sql("""-- more
x AS (SELECT station_id, image_id, CASE WHEN k % 3 = 0 THEN NULL ELSE epoch_us(captured_at) END AS t, row_number() OVER (PARTITION BY station_id ORDER BY image_id) AS i FROM captures),
y AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(t IGNORE NULLS) OVER p AS pt,
  first_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni, first_value(t IGNORE NULLS) OVER n AS nt FROM x
  WINDOW p AS (PARTITION BY station_id ORDER BY image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY station_id ORDER BY image_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT image_id, make_timestamp(coalesce(t, pt + CAST(floor((nt - pt) * ((i - pi) / (ni - pi)::DOUBLE)) AS BIGINT), pt, nt)) AS filled_at,
 CASE WHEN t IS NOT NULL THEN 'known' WHEN pt IS NOT NULL AND nt IS NOT NULL THEN 'interpolated' WHEN pt IS NOT NULL THEN 'propagated' WHEN i = 1 THEN 'propagated' ELSE 'interpolated' END AS fill_source FROM y"""))
def interpolate_ts(spark: SparkSession, sf: str) -> DataFrame:
    gaps = d.captures(spark, sf).withColumn("captured_at", F.when(F.col("k") % 3 != 0, F.col("captured_at")))
    return sessions.filled_timestamps(gaps, "station_id", "image_id", "captured_at").select("image_id", F.col("filled_at").cast("timestamp_ntz").alias("filled_at"), "fill_source")


_DIST = "sqrt(power((b_lat - a_lat) * 111.0, 2) + power((b_lon - a_lon) * 111.320 * cos(radians((a_lat + b_lat) / 2)), 2))"


@query(sql(f"""-- more
e AS (SELECT ind_id, station_id, event_no, min(captured_at) AS s, max(captured_at) AS e FROM bursts GROUP BY 1, 2, 3),
w AS (SELECT ind_id, station_id, event_no, s, lag(station_id) OVER o AS p, lag(e) OVER o AS pe FROM e WINDOW o AS (PARTITION BY ind_id ORDER BY s, station_id, event_no)),
g AS (SELECT w.*, a.lat AS a_lat, a.lon AS a_lon, b.lat AS b_lat, b.lon AS b_lon FROM w JOIN stations a ON a.station_id = p JOIN stations b ON b.station_id = w.station_id WHERE p <> w.station_id)
SELECT ind_id, station_id, event_no, p AS from_station, round({_DIST}, 4) AS km, round({_DIST} / greatest(0.01, (epoch_us(s) - epoch_us(pe)) / 3600000000.0), 4) AS kmh FROM g"""))
def travel_speed(spark: SparkSession, sf: str) -> DataFrame:
    from tracklake.operators.alerts import transits

    events = bursts(spark, sf).groupBy("ind_id", "station_id", "event_no").agg(F.min("captured_at").alias("started_at"), F.max("captured_at").alias("ended_at"))
    return transits(events, d.stations(spark), ["ind_id"]).select("ind_id", "station_id", "event_no", "from_station", F.round("km", 4).alias("km"), F.round("kmh", 4).alias("kmh"))


@query("""WITH n AS (SELECT DISTINCT substr(p_name, 1, length(p_name) - 1) || 'x' AS name FROM part UNION SELECT DISTINCT p_type || ' 7' FROM part UNION SELECT DISTINCT '#' || (p_partkey + 3) FROM part),
k AS (SELECT p_name AS station_name, min(p_type) AS folder_hint, min(p_partkey) AS station_id FROM part GROUP BY p_name),
s AS (SELECT DISTINCT station_id, regexp_replace(upper(m), '[^A-Z0-9]', '', 'g') AS m FROM (SELECT station_id, unnest([CAST(station_id AS VARCHAR), station_name, folder_hint]) AS m FROM k)),
p AS (SELECT name, station_id, levenshtein(regexp_replace(upper(name), '[^A-Z0-9]', '', 'g'), m) AS distance FROM n, s)
SELECT name, station_id, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, station_id) AS r FROM p WHERE distance <= 2) WHERE r = 1""")
def station_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    part = d.table(spark, sf, "part")
    names = part.select(F.concat(F.substr("p_name", F.lit(1), F.char_length("p_name") - 1), F.lit("x")).alias("name"))
    names = names.union(part.select(F.concat("p_type", F.lit(" 7")))).union(part.select(F.concat(F.lit("#"), (F.col("p_partkey") + 3).cast("string"))))
    known = part.groupBy(F.col("p_name").alias("station_name")).agg(F.min("p_type").alias("folder_hint"), F.min("p_partkey").alias("station_id"))
    return identity.fuzzy_station(names, known)


@query("""SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS norm, round(greatest(0, 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE), 6) AS ratio, substr(sha256(p_partkey || '|' || p_name), 1, 16) AS id FROM part""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "part").select("p_partkey", normalised(F.col("p_name")).alias("norm"), F.round(levenshtein_ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"), short_id(F.col("p_partkey"), F.col("p_name")).alias("id"))


@query("SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS named_at FROM orders")
def filename_times(spark: SparkSession, sf: str) -> DataFrame:
    time = (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).cast("timestamp")
    name = F.concat(F.lit("IMG_"), F.date_format(time, "yyyyMMdd_HHmmss"), F.lit(".JPG"))
    return d.table(spark, sf, "orders").select("o_orderkey", filename_timestamp(name).cast("timestamp_ntz").alias("named_at"))


@query(sql("SELECT station_id, round(round_even(lat / (2.0 / 111.0), 0) * (2.0 / 111.0), 6) AS lat, round(round_even(lon / (2.0 / 111.0), 0) * (2.0 / 111.0), 6) AS lon FROM sites"))
def generalise_grid(spark: SparkSession, sf: str) -> DataFrame:
    return d.sites(spark, sf).select("station_id", F.round(geo.generalised(F.col("lat"), 2.0), 6).alias("lat"), F.round(geo.generalised(F.col("lon"), 2.0), 6).alias("lon"))


@query(sql("""SELECT a.station_id AS a_id, b.station_id AS b_id, round(sqrt(power((b.lat - a.lat) * 111.0, 2) + power((b.lon - a.lon) * 111.320 * cos(radians((a.lat + b.lat) / 2)), 2)), 6) AS km,
round((degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 720) % 360, 6) AS bearing
FROM sites a JOIN sites b ON b.station_id = a.station_id + 1 + a.station_id % 3"""))
def distances_and_bearings(spark: SparkSession, sf: str) -> DataFrame:
    a = d.sites(spark, sf).select(F.col("station_id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = d.sites(spark, sf).select(F.col("station_id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    pairs = a.join(b, F.col("b_id") == F.col("a_id") + 1 + F.col("a_id") % 3)
    ends = [F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")]
    return pairs.select("a_id", "b_id", F.round(geo.distance_km(*ends), 6).alias("km"), F.round(geo.bearing(*ends), 6).alias("bearing"))


@query(sql("""-- more
w AS (SELECT TIMESTAMP '2024-01-03' AS a, TIMESTAMP '2024-01-21' AS b),
x AS (SELECT s.station_id, coalesce(n_images, 0) AS n_images, coalesce(n_in_window, 0) AS n_in_window, last_capture, first_start, last_end, coalesce(days, 0) AS days,
  coalesce(first_start >= a, FALSE) AS installed, coalesce(first_start < a, FALSE) AS active_before, coalesce(first_start < a, FALSE) AND coalesce(days, 0) < 0.8 * 18 AS ended_early
FROM w, stations s LEFT JOIN (SELECT station_id, count(*) AS n_images, max(captured_at) AS last_capture, count(*) FILTER (captured_at >= a AND captured_at < b) AS n_in_window FROM captures, w GROUP BY 1) USING (station_id)
LEFT JOIN (SELECT station_id, min(start_date) AS first_start, max(coalesce(end_date, TIMESTAMP '9999-12-31')) AS last_end FROM activity GROUP BY 1) USING (station_id)
LEFT JOIN (SELECT station_id, round(sum(epoch_us(least(coalesce(end_date, b), b)) - epoch_us(greatest(start_date, a))) / 86400000000.0, 2) AS days FROM activity, w WHERE least(coalesce(end_date, b), b) > greatest(start_date, a) GROUP BY 1) USING (station_id))
SELECT *, CASE WHEN days = 0 AND active_before OR ended_early THEN 'offline' WHEN installed THEN 'new' WHEN n_images = 0 THEN 'idle' ELSE 'active' END AS state FROM x"""))
def stations_with_state(spark: SparkSession, sf: str) -> DataFrame:
    start, end = (F.to_timestamp_ntz(F.lit(f"2024-01-{day} 00:00:00")) for day in ("03", "21"))
    window = spark.range(1).select(F.lit(0).alias("run_id"), start.alias("period_start"), end.alias("period_end"))
    days = effort.station_days(d.activity(spark), window).select("station_id", "days")
    return catalogue.stations_with_state(d.stations(spark), d.captures(spark, sf), d.activity(spark), days, start, end)


@query(sql(f"""SELECT run_id, reserve_id, started_at, n_images, n_blank, (SELECT round(avg(confidence), 3) FROM captures WHERE k % 4 = 1 AND k % 3 <> 0) AS mean_auto_conf, (SELECT count(*) FROM captures WHERE k % 6 = 0) AS review_open
FROM runs JOIN (SELECT run_id, count(*) AS n_images, count(*) FILTER (status = 'quarantined') AS n_blank FROM (SELECT run_id, {STATUS_SQL} FROM captures) GROUP BY 1) USING (run_id)"""))
def drift(spark: SparkSession, sf: str) -> DataFrame:
    c, k = d.captures(spark, sf), F.col("k")
    assignments = c.select("confidence", F.when(k % 4 == 1, "auto").otherwise("review").alias("decision"), F.when(k % 3 == 0, F.col("image_id")).alias("superseded_by"))
    queue = c.select(F.when(k % 6 == 0, "open").otherwise("done").alias("state"))
    return catalogue.drift(d.runs(spark), with_statuses(spark, sf), assignments, queue, "run_id")


@query("SELECT 'customer' AS table_name, count(*) FILTER (c_acctbal > 5000) AS n FROM customer UNION ALL SELECT 'orders', count(*) FILTER (o_orderstatus <> 'F') FROM orders")
def pending_sync(spark: SparkSession, sf: str) -> DataFrame:
    changed = d.table(spark, sf, "customer").select(F.when(F.col("c_acctbal") > 5000, F.col("c_custkey")).alias("lamport"), F.lit(None).alias("synced_at"))
    orders = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("lamport"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("synced_at"))
    return catalogue.pending_sync({"customer": changed, "orders": orders})


@query("SELECT p_type AS folder, count(DISTINCT (p_brand, p_size)) AS bodies FROM part WHERE p_size > 5 GROUP BY p_type HAVING count(DISTINCT (p_brand, p_size)) > 1")
def mixed_cameras(spark: SparkSession, sf: str) -> DataFrame:
    files = d.table(spark, sf, "part").select(F.col("p_type").alias("folder"), F.col("p_brand").alias("make"), F.col("p_size").cast("string").alias("model"), F.lit(None).cast("string").alias("serial"), (F.col("p_size") <= 5).alias("corrupt"))
    return catalogue.mixed_cameras(files)


@query("""SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS restored, round((count(*) - count(*) FILTER (l_returnflag = 'R')) * 4.0 / 3600, 1) AS hours, round(sum(CAST(l_quantity AS BIGINT) * 1000) / 1048576.0, 1) AS mb FROM lineitem""")
def quarantine_savings(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("restored_at"), (F.col("l_quantity").cast("long") * 1000).alias("bytes"))
    return catalogue.quarantine_savings(rows, 4.0)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.page(d.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 100, 50)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 200")
def keyset(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.keyset_page(d.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 700, 200)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 2 END AS rank FROM orders")
def severity_order(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "act").when(F.col("o_orderpriority") == "2-HIGH", "watch").otherwise("info")
    ranked = d.table(spark, sf, "orders").withColumn("rank", catalogue.severity_order(severity))
    return ranked.orderBy("rank", F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "rank")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%00012%' OR c_mktsegment ILIKE '%achin%'")
def searched(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.searched(d.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "achin", ["c_mktsegment"]).union(
        catalogue.searched(d.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "00012", ["c_name"])
    ).distinct()


@query(sql("""-- more
x AS (SELECT station_id, image_id, row_number() OVER (PARTITION BY station_id ORDER BY captured_at, image_id) - 1 AS i, count(*) OVER (PARTITION BY station_id) AS n FROM captures)
SELECT station_id, image_id FROM x WHERE n <= 60 OR list_contains(list_transform(range(60), lambda j: (j * (n - 1)) // 59), i)"""))
def evenly_spaced(spark: SparkSession, sf: str) -> DataFrame:
    frames = d.captures(spark, sf).withColumn("_at", F.struct("captured_at", "image_id"))
    return catalogue.evenly_spaced(frames, "station_id", "_at", 60).select("station_id", "image_id")


@query(sql("""SELECT image_id, captured_at, station_id FROM captures WHERE ind_id = 3 AND (captured_at IS NULL OR captured_at <= TIMESTAMP '2024-01-12')"""))
def individual_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Captures of one individual up to a time; undated ones count as before it."""
    until = F.lit("2024-01-12").cast("timestamp_ntz")
    return catalogue.open_until(d.captures(spark, sf).filter("ind_id = 3"), "captured_at", until).select("image_id", "captured_at", "station_id")


@query(sql("SELECT ind_id, arg_max(image_id, (captured_at, image_id)) AS image_id, max(captured_at) AS captured_at FROM captures GROUP BY ind_id"))
def latest_capture(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.latest_of(d.captures(spark, sf), "ind_id", "captured_at", "image_id")
