"""Queries of the spine, the review queue, dashboards and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import geo, vision
from tracklake.operators import catalogue, changes, identity, lists, records, review, sessions
from tracklake.plans import analytics, survey
from tracklake.plans import derived as d
from tracklake.plans.derived import sql
from tracklake.sources import exchange

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return register


def spine_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    c = d.captures(spark, sf)
    images = c.select("image_id", "run_id", "station_id", "captured_at", "status")
    detections = c.filter("k % 5 <> 0").select("image_id", (F.col("image_id") * 10).alias("det_id"), F.col("confidence").alias("conf"))
    crops = c.filter("k % 5 in (1, 2, 3)").select((F.col("image_id") * 10).alias("det_id"), (F.col("image_id") * 100).alias("crop_id"), "side")
    assignments = c.filter("k % 5 in (1, 2)").select((F.col("image_id") * 100).alias("crop_id"), "ind_id", F.when(F.col("k") % 10 == 1, F.col("image_id")).alias("superseded_by"))
    events = c.filter("k % 2 = 0").select("image_id", (F.col("image_id") % 997).alias("event_id"))
    return {"images": images, "detections": detections, "crops": crops, "assignments": assignments, "events": events}


@query(sql("SELECT run_id, ind_id, side, count(*) AS n FROM captures WHERE k % 5 IN (1, 2) AND k % 10 <> 1 GROUP BY 1, 2, 3"))
def spine_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = spine_tables(spark, sf)
    return review.spine(t["images"], t["detections"], t["crops"], t["assignments"]).groupBy("run_id", "ind_id", "side").agg(F.count("*").alias("n"))


@query(sql("""SELECT image_id * 10 AS det_id, image_id, CASE WHEN k % 2 = 0 THEN image_id % 997 END AS event_id, CASE WHEN k % 5 IN (1, 2, 3) THEN image_id * 100 END AS crop_id,
CASE WHEN k % 5 IN (1, 2) AND k % 10 <> 1 THEN ind_id END AS ind_id FROM captures WHERE k % 5 <> 0"""))
def detections_for_run(spark: SparkSession, sf: str) -> DataFrame:
    t = spine_tables(spark, sf)
    return review.detections_of_runs(t["images"], t["detections"], t["events"], t["crops"], t["assignments"]).select("det_id", "image_id", "event_id", "crop_id", "ind_id")


@query(sql("SELECT image_id * 10 AS det_id FROM captures WHERE k % 5 = 4"))
def detections_without_crop(spark: SparkSession, sf: str) -> DataFrame:
    t = spine_tables(spark, sf)
    return catalogue.without_partner(t["detections"], t["crops"], "det_id").select("det_id")


def queue(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k") % 4
    return d.captures(spark, sf).select(F.col("image_id").alias("queue_id"), F.when(k <= 1, "open").when(k == 2, "claimed").otherwise("done").alias("state"), F.when(k == 2, F.when(F.col("side") == "L", F.lit("me")).otherwise("other")).alias("claimed_by"), F.col("confidence").alias("priority"))


_QUEUE = """q AS (SELECT image_id AS queue_id, CASE WHEN k % 4 <= 1 THEN 'open' WHEN k % 4 = 2 THEN 'claimed' ELSE 'done' END AS state, CASE WHEN k % 4 = 2 THEN CASE WHEN side = 'L' THEN 'me' ELSE 'other' END END AS claimed_by, confidence AS priority FROM captures)"""


@query(sql(f"-- more\n{_QUEUE} SELECT queue_id, state, priority FROM q WHERE state = 'open' OR (state = 'claimed' AND claimed_by = 'me') ORDER BY priority DESC, queue_id LIMIT 200 OFFSET 40"))
def review_page(spark: SparkSession, sf: str) -> DataFrame:
    return review.review_page(queue(spark, sf), "me", 40, 999).select("queue_id", "state", "priority")


@query(sql(f"-- more\n{_QUEUE} SELECT count(*) AS total, count(*) FILTER (state = 'open') AS \"open\", count(*) FILTER (state = 'claimed' AND claimed_by = 'me') AS held FROM q"))
def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return review.queue_counts(queue(spark, sf), "me")


@query(f"""WITH {analytics._SCORES}, t AS (SELECT query_id, ind_id, max(score) AS score FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ind_id) AS r FROM t)
SELECT query_id, max(score) AS priority, count(*) AS n FROM r WHERE r <= 3 GROUP BY query_id""")
def candidate_lists(spark: SparkSession, sf: str) -> DataFrame:
    best = identity.matched_individuals(*analytics.sided_vectors(spark, sf), "side", 5, digits=4, skip_self=True)
    listed = review.candidate_list(best.select("query_id", "ind_id", "score"), 3)
    return listed.select("query_id", "priority", F.size(F.from_json("candidates", "array<struct<ind_id:long,score:double>>")).cast("long").alias("n"))


@query(sql("SELECT run_id, count(*) AS total, count(*) FILTER (k % 3 <> 0) AS shown, count(*) FILTER (k % 3 = 0) AS held_back, count(*) FILTER (status = 'error' AND k % 3 <> 0) AS act FROM captures GROUP BY run_id"))
def alert_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.captures(spark, sf).select("run_id", (F.col("k") % 3 == 0).alias("suppressed"), F.when(F.col("status") == "error", "act").otherwise("watch").alias("severity"))
    return review.alert_counts(rows)


@query(sql("SELECT CASE WHEN k % 3 = 0 THEN status || '_suppressed' ELSE status END AS kind, count(*) AS n FROM captures GROUP BY 1"))
def alerts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return review.alerts_by_type(d.captures(spark, sf).select(F.col("status").alias("type"), (F.col("k") % 3 == 0).alias("suppressed")))


@query(sql("SELECT status AS outcome, count(*) AS n, arg_min('e' || k, image_id) FILTER (k < 5) AS first_error FROM captures GROUP BY 1"))
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.captures(spark, sf).select(F.col("status").alias("outcome"), "image_id", F.when(F.col("k") < 5, F.concat(F.lit("e"), F.col("k").cast("string"))).alias("error"))
    return review.outcome_counts(rows, "outcome", "image_id", "error")


@query(sql("SELECT status, side, count(*) AS n, min(confidence) AS low, round(avg(confidence), 4) AS mean, max(confidence) AS high FROM captures GROUP BY 1, 2"))
def signal_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return review.signal_ranges(d.captures(spark, sf), ["status", "side"], "confidence")


@query(sql("SELECT run_id, ind_id, CASE WHEN avg(CASE WHEN zone = 'buffer' THEN 1 ELSE 0 END) > 0.5 THEN 'buffer' ELSE 'core' END AS zone FROM (SELECT DISTINCT run_id, ind_id, station_id FROM visits) JOIN stations USING (station_id) GROUP BY 1, 2"))
def dominant_zone(spark: SparkSession, sf: str) -> DataFrame:
    return review.dominant_zone(d.visits(spark, sf).select("run_id", "ind_id", "station_id").distinct(), d.stations(spark), ["run_id", "ind_id"])


@query(sql("""-- more
u AS (SELECT DISTINCT ind_id, run_id, station_id FROM visits),
x AS (SELECT u.*, EXISTS (SELECT 1 FROM u p WHERE p.ind_id = u.ind_id AND p.station_id = u.station_id AND p.run_id < u.run_id) AS old FROM u)
SELECT ind_id, run_id, count(*) FILTER (NOT old) AS n_fresh, count(*) FILTER (old) AS n_again FROM x GROUP BY 1, 2"""))
def station_changes(spark: SparkSession, sf: str) -> DataFrame:
    sets = d.visits(spark, sf).groupBy("ind_id", "run_id").agg(F.collect_set("station_id").alias("stations"))
    return review.station_changes(sets, "ind_id", "run_id", "stations").select("ind_id", "run_id", F.size("fresh").cast("long").alias("n_fresh"), F.size("again").cast("long").alias("n_again"))


@query("SELECT l_orderkey, l_linenumber, CAST(bit_count(xor(l_partkey, l_suppkey)) AS INTEGER) AS bits FROM lineitem")
def hamming_distances(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", review.hamming(F.col("l_partkey"), F.col("l_suppkey")).alias("bits"))


@query(sql("""-- more
b AS (SELECT image_id, (k % 10) / 10.0::DOUBLE AS x, 0.1::DOUBLE AS y, 0.3::DOUBLE AS w, 0.2::DOUBLE AS h, 0.2::DOUBLE AS x2, 0.15::DOUBLE AS y2, 0.4::DOUBLE AS w2, 0.3::DOUBLE AS h2 FROM captures),
i AS (SELECT *, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) * greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) AS s FROM b)
SELECT image_id, round(s / (w * h + w2 * h2 - s), 6) AS iou FROM i"""))
def box_overlap(spark: SparkSession, sf: str) -> DataFrame:
    box = lambda x, y, w, h: F.struct(x.alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    return d.captures(spark, sf).withColumn("a", box((F.col("k") % 10) / 10.0, 0.1, 0.3, 0.2)).withColumn("b", box(F.lit(0.2), 0.15, 0.4, 0.3)).select("image_id", F.round(geo.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query(sql("SELECT image_id, CASE WHEN confidence >= 0.8 THEN 'a' WHEN 1 - confidence >= 0.8 THEN 'b' ELSE 'unknown' END AS label FROM captures"))
def class_labels(spark: SparkSession, sf: str) -> DataFrame:
    return d.captures(spark, sf).select("image_id", vision.best_label(F.array(F.col("confidence"), 1 - F.col("confidence")), ["a", "b"], 0.8).alias("label"))


@query(sql("""-- more
r AS (SELECT max(captured_at) FILTER (k < 50) AS top, station_id FROM captures GROUP BY station_id)
SELECT station_id, greatest(top, TIMESTAMP '2024-01-29') AS value FROM r"""))
def latest_or_floor(spark: SparkSession, sf: str) -> DataFrame:
    latest = d.captures(spark, sf).groupBy("station_id").agg(F.max(F.when(F.col("k") < 50, F.col("captured_at"))).alias("top"))
    return latest.select("station_id", F.greatest("top", F.lit("2024-01-29").cast("timestamp_ntz")).alias("value"))


@query("SELECT coalesce(max(o_orderkey) FILTER (o_custkey < 0), -1) AS value FROM orders")
def largest_or_default(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.largest_or(d.table(spark, sf, "orders").filter("o_custkey < 0"), "o_orderkey", -1)


@query(sql("""-- more
f AS (SELECT station_id, image_id, captured_at AS t, k % 4 = 0 AS bad FROM captures),
g AS (SELECT *, CASE WHEN bad THEN t - INTERVAL 8000 DAY ELSE t END AS exif FROM f),
m AS (SELECT *, min(CASE WHEN bad THEN exif END) OVER (PARTITION BY station_id) AS low FROM g)
SELECT image_id, CASE WHEN bad THEN TIMESTAMP '2024-01-01' + (exif - low) ELSE exif END AS repaired_at FROM m"""))
def clock_drift(spark: SparkSession, sf: str) -> DataFrame:
    c = d.captures(spark, sf)
    bad = F.col("k") % 4 == 0
    t = F.col("captured_at").cast("timestamp")
    frames = c.select("station_id", "image_id", bad.alias("bad"), F.when(bad, t - F.expr("INTERVAL 8000 DAYS")).otherwise(t).alias("exif"))
    fixed = sessions.clock_drift(frames, "station_id", "exif", ~F.col("bad"), F.lit("2024-01-01").cast("timestamp"))
    return fixed.select("image_id", F.col("repaired_at").cast("timestamp_ntz").alias("repaired_at"))


@query("SELECT l_partkey AS source, CASE WHEN l_partkey % 10 = 3 THEN l_partkey + 1 ELSE l_partkey END AS ind_id, count(*) AS n FROM lineitem GROUP BY 1, 2")
def merged_individuals(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("ind_id"), F.col("l_partkey").alias("before"), F.lit(None).cast("long").alias("superseded_by"))
    merges = d.table(spark, sf, "part").filter("p_partkey % 10 = 3").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 1).alias("target"))
    return changes.merged_individuals(rows, merges).groupBy(F.col("before").alias("source"), "ind_id").agg(F.count("*").alias("n"))


@query(sql("""SELECT image_id, CASE WHEN k < 20 AND status IN ('error', 'view') THEN 'pending' ELSE status END AS status FROM captures"""))
def restored_images(spark: SparkSession, sf: str) -> DataFrame:
    c = d.captures(spark, sf)
    images = c.select("image_id", F.when(F.col("status") == "error", "quarantined").when(F.col("status") == "view", "blank").otherwise(F.col("status")).alias("status"))
    held = c.select("image_id", F.lit(None).cast("timestamp").alias("restored_at"))
    out, _ = changes.restored(images, held, c.filter("k < 20").select("image_id"), F.lit("2024-02-01").cast("timestamp"))
    return out.select("image_id", F.when(F.col("status") == "quarantined", "error").when(F.col("status") == "blank", "view").otherwise(F.col("status")).alias("status"))


@query("""WITH n AS (SELECT DISTINCT p_type AS folder FROM part), s AS (SELECT min(p_partkey) AS station_id, p_type || 'X' AS name FROM part WHERE p_partkey % 4 = 1 GROUP BY p_type),
p AS (SELECT folder, station_id, greatest(0, 1 - levenshtein(folder, name) / greatest(length(folder), length(name))::DOUBLE) AS ratio,
  levenshtein(regexp_replace(upper(folder), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(name), '[^A-Z0-9]', '', 'g')) AS edits FROM n, s),
z AS (SELECT folder, station_id, edits, round(CASE WHEN ratio > 0.6 THEN 0.4 * ratio ELSE 0 END + CASE WHEN ratio > 0.4 THEN 0.1 * ratio ELSE 0 END, 3) AS score FROM p),
a AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, station_id) AS r FROM z),
f AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY edits, station_id) AS q FROM z WHERE edits <= 2)
SELECT folder, station_id, score, 'signals' AS signal FROM a WHERE r = 1 AND score >= 0.477
UNION ALL SELECT folder, station_id, 0.65::DOUBLE, 'folder_fuzzy' FROM f WHERE q = 1 AND folder NOT IN (SELECT folder FROM a WHERE score >= 0.477)""")
def station_match(spark: SparkSession, sf: str) -> DataFrame:
    """Folders against stations that are called like every fourth of them, with a letter more."""
    part = d.table(spark, sf, "part")
    folders = part.select(F.lit("R").alias("reserve_id"), F.col("p_type").alias("folder")).distinct()
    stations = part.filter("p_partkey % 4 = 1").groupBy(F.concat("p_type", F.lit("X")).alias("name")).agg(F.min("p_partkey").alias("station_id")).select(F.lit("R").alias("reserve_id"), "station_id", F.col("station_id").alias("place"), "name")
    none = F.lit(None).cast("string")
    file = {"folder": F.col("folder"), "file_name": F.col("folder"), "serial": none, "body": none, "time": none}
    station = {"folder_hint": none, "name": F.col("name"), "serial": none, "body": none, "active_from": none, "active_to": none}
    return review.best_station_match(folders, stations, identity.station_score(file, station), 0.477)


_CHAIN = """-- more
b AS (SELECT *, 'e' || station_id || '-' || event_no AS event_id FROM bursts)"""


def chain(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Captures as images, detections, crops, assignments, bursts and their members; every third assignment is superseded."""
    b = survey.bursts(spark, sf).withColumn("event_id", F.concat(F.lit("e"), F.col("station_id").cast("string"), F.lit("-"), F.col("event_no").cast("string")))
    i = F.col("image_id")
    events = b.groupBy("event_id", "station_id").agg(F.min("captured_at").alias("started_at"), F.max("captured_at").alias("ended_at"))
    return {
        "images": b.select("image_id", "run_id", F.lit("R").alias("reserve_id"), "station_id", "captured_at", F.concat(F.lit("img/"), i.cast("string")).alias("orig_path")),
        "detections": b.filter("k > 4").select("image_id", (i * 2).alias("det_id"), (F.col("k") / 100).alias("x"), F.lit(0.5).alias("y"), F.lit(0.2).alias("w"), F.lit(0.3).alias("h")),
        "crops": b.filter("k > 4").select((i * 2).alias("det_id"), (i * 3).alias("crop_id"), "side"),
        "assignments": b.filter("k > 9").select((i * 3).alias("crop_id"), "ind_id", "confidence", F.when(F.col("k") % 3 == 0, "later").alias("superseded_by")),
        "members": b.select("image_id", "event_id"),
        "events": events,
    }


@query(sql(f"""{_CHAIN},
e AS (SELECT event_id, station_id, min(captured_at) AS started_at, max(captured_at) AS ended_at FROM b GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY ind_id, started_at, event_id) AS place FROM (SELECT DISTINCT event_id, ind_id FROM b WHERE k > 9) JOIN e USING (event_id)"""))
def individual_events(spark: SparkSession, sf: str) -> DataFrame:
    t = chain(spark, sf)
    return d.in_order(review.individual_events(t["events"], t["members"], t["images"], t["detections"], t["crops"], t["assignments"]))


@query(sql(f"""{_CHAIN} SELECT run_id, ind_id, round(avg(confidence), 3) AS mean_confidence FROM b WHERE k > 9 AND k % 3 <> 0 GROUP BY 1, 2"""))
def mean_confidences(spark: SparkSession, sf: str) -> DataFrame:
    t = chain(spark, sf)
    return review.mean_confidences(t["images"], t["detections"], t["crops"], t["assignments"])


@query(sql(f"""{_CHAIN} SELECT image_id * 3 AS crop_id, image_id * 2 AS det_id, image_id, side, k / 100 AS x, 'img/' || image_id AS orig_path, run_id, station_id, captured_at FROM b WHERE k > 4"""))
def crop_context(spark: SparkSession, sf: str) -> DataFrame:
    t = chain(spark, sf)
    return records.crop_context(t["crops"], t["detections"], t["images"]).select("crop_id", "det_id", "image_id", "side", "x", "orig_path", "run_id", "station_id", "captured_at")


@query(sql("SELECT activity_id, station_id, name, start_date, row_number() OVER (ORDER BY name, start_date, activity_id) AS place FROM site_activity JOIN sites USING (station_id)"))
def station_activity(spark: SparkSession, sf: str) -> DataFrame:
    return d.in_order(catalogue.station_activity(d.site_activity(spark, sf), d.sites(spark, sf))).select("activity_id", "station_id", "name", "start_date", "place")


def package(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    c = d.captures(spark, sf)
    k, image = F.col("k"), F.col("image_id").cast("string")
    media = c.select("image_id", "station_id", "captured_at", F.when(k == 0, "person").when(k < 10, "blank").otherwise("animal").alias("status"), F.concat(F.lit("img/"), image, F.lit(".jpg")).alias("path"))
    label = F.when(k < 70, "animal").when(k < 80, "person").when(k < 85, "vehicle").when(k < 90, "blank").otherwise("odd")
    detections = c.filter("k >= 10").select(
        "image_id",
        (F.col("image_id") * 10).alias("det_id"),
        label.alias("label"),
        F.when(F.col("side") == "L", "tiger").when(k < 60, "deer").otherwise("").alias("species"),
        F.col("confidence").alias("conf"),
        F.when(k % 4 == 0, 0.75).otherwise(0.0).alias("assign_confidence"),
        F.when(k % 3 == 0, F.concat(F.lit("ev_"), F.col("station_id").cast("string"))).alias("event_id"),
        F.when(k < 70, F.col("ind_id")).alias("ind_id"),
        F.when(k % 8 == 0, "human").otherwise("embed").alias("assign_method"),
    )
    activity = d.activity(spark).withColumn("note", F.when(F.col("station_id") % 2 == 0, "by the road"))
    return exchange.camera_trap_package(d.stations(spark), activity, media, detections, F.lit("2024-02-01").cast("timestamp_ntz"))


@query(sql("""SELECT CASE WHEN k >= 10 THEN CAST(image_id * 10 AS VARCHAR) ELSE 'blank_' || image_id END AS "observationID", station_id AS "deploymentID", image_id AS "mediaID",
CASE WHEN k >= 10 AND k % 3 = 0 THEN 'ev_' || station_id END AS "eventID", captured_at AS "eventStart", captured_at AS "eventEnd", 'media' AS "observationLevel",
CASE WHEN k < 10 THEN 'blank' WHEN k < 70 THEN 'animal' WHEN k < 80 THEN 'human' WHEN k < 85 THEN 'vehicle' ELSE 'unclassified' END AS "observationType",
CASE WHEN k >= 10 THEN CASE WHEN side = 'L' THEN 'Panthera tigris' WHEN k < 60 THEN 'deer' END END AS "scientificName", CASE WHEN k >= 10 THEN 1 END AS count,
CASE WHEN k BETWEEN 10 AND 69 THEN CAST(ind_id AS VARCHAR) END AS "individualID", CASE WHEN k >= 10 AND k % 8 = 0 THEN 'human' ELSE 'machine' END AS "classificationMethod",
CASE WHEN k < 10 THEN NULL WHEN k % 4 = 0 THEN 0.75::DOUBLE ELSE nullif(confidence, 0) END AS "classificationProbability" FROM captures WHERE k >= 1"""))
def package_observations(spark: SparkSession, sf: str) -> DataFrame:
    return package(spark, sf)["observations"]


@query(sql("""SELECT image_id AS "mediaID", station_id AS "deploymentID", captured_at AS "timestamp", 'img/' || image_id || '.jpg' AS "filePath", k <> 0 AS "filePublic",
image_id || '.jpg' AS "fileName", 'image/jpeg' AS "fileMediatype" FROM captures"""))
def package_media(spark: SparkSession, sf: str) -> DataFrame:
    return package(spark, sf)["media"]


_FEATURE = "to_json({{'type': 'Feature',{id} 'geometry': {{'type': 'Point', 'coordinates': [lon, lat]}}, 'properties': {{'station_id': station_id, 'name': name, 'zone': zone, 'village_dist_km': village_dist_km{more}}}}})"


@query(sql(f"SELECT CAST({_FEATURE.format(id='', more='')} AS VARCHAR) AS feature FROM sites"))
def station_features(spark: SparkSession, sf: str) -> DataFrame:
    return exchange.station_features(d.sites(spark, sf))


@query(sql(f"""SELECT CAST({_FEATURE.format(id=" 'id': station_id,", more=", 'folder_hint': NULL, 'camera_make': 'M' || station_id % 3, 'camera_model': NULL, 'camera_serial': NULL")} AS VARCHAR) AS feature FROM sites"""))
def station_features_full(spark: SparkSession, sf: str) -> DataFrame:
    make = F.concat(F.lit("M"), (F.col("station_id") % 3).cast("string"))
    return exchange.station_features(d.sites(spark, sf).withColumn("camera_make", make), full=True)


@query()
def range_features(spark: SparkSession, sf: str) -> DataFrame:
    return exchange.range_features(analytics.home_ranges(spark, sf), True)


@query(sql("""-- more
x AS (SELECT ind_id, captured_at, confidence FROM captures)
SELECT ind_id, round(avg(confidence) FILTER (captured_at < TIMESTAMP '2024-01-16'), 3) AS before, round(avg(confidence) FILTER (captured_at >= TIMESTAMP '2024-01-16'), 3) AS after FROM x GROUP BY ind_id"""))
def confidence_by_half(spark: SparkSession, sf: str) -> DataFrame:
    early = F.col("captured_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    return d.captures(spark, sf).groupBy("ind_id").agg(F.round(F.avg(F.when(early, F.col("confidence"))), 3).alias("before"), F.round(F.avg(F.when(~early, F.col("confidence"))), 3).alias("after"))


@query(sql("SELECT DISTINCT ind_id FROM captures WHERE run_id < 2 UNION SELECT DISTINCT ind_id FROM captures WHERE run_id = 2"))
def eligible_or_seen(spark: SparkSession, sf: str) -> DataFrame:
    c = d.captures(spark, sf)
    return catalogue.eligible_or_seen(c.filter("run_id < 2"), c.filter("run_id = 2"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def active_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("state"))
    return catalogue.counted(lists.active_jobs(jobs, ("O", "P")), "state").withColumnRenamed("state", "o_orderstatus")


@query(sql("SELECT station_id, min(start_date) AS first_start FROM site_activity GROUP BY station_id"))
def first_starts(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.first_starts(d.site_activity(spark, sf))


@query(sql("SELECT station_id, count(*) AS n_events FROM (SELECT DISTINCT station_id, event_no FROM bursts) GROUP BY station_id"))
def station_events(spark: SparkSession, sf: str) -> DataFrame:
    return survey.bursts(spark, sf).select("station_id", "event_no").distinct().groupBy("station_id").agg(F.count("*").alias("n_events"))
