"""Queries of the cascade and of changes of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import geo
from tracklake.operators import cascade, records
from tracklake.plans import derived as d
from tracklake.plans.derived import sql
from tracklake.plans.review_queries import queue, spine_tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return register


@query()
def identified(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade over the embeddings: those of label 0 are the catalogue, the others come one after the other."""
    e = d.table(spark, sf, "embeddings")
    vector = F.col("embedding").cast("array<double>")
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v * v))
    unit = F.when(length > 0, F.transform(vector, lambda v: v / length))
    side = F.when(F.col("vec_id") % 2 == 0, "L").otherwise("R")
    base = e.select(F.col("vec_id").alias("id"), unit.alias("embedding"), side.alias("side"), (F.col("vec_id") % 4).alias("reserve"), "label")
    catalogue = base.filter("label = 0").select(F.col("reserve").cast("string").alias("reserve_id"), "side", F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_id"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("ind_id"), "embedding")
    rows = base.filter("label <> 0").select(
        F.col("id").cast("long").alias("det_id"),
        F.lit(1).alias("run_id"),
        F.col("reserve").cast("string").alias("reserve_id"),
        (F.col("id") % 36).alias("station_id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("captured_at"),
        F.when(F.col("id") % 29 == 0, F.lit(None)).when(F.col("id") % 31 == 0, "deer").otherwise("tiger").alias("species"),
        F.when(F.col("id") % 37 == 0, "?").otherwise(F.col("side")).alias("side"),
        (F.col("id") % 41 != 0).alias("posed"),
        "embedding",
    )
    return cascade.identified(rows, catalogue).select("det_id", "outcome", "status", "ind_id", F.round("score", 3).alias("score"), "neighbour_ind")


@query(sql("""SELECT image_id, CASE WHEN k % 7 = 0 THEN 'blank' ELSE status END AS status, CASE WHEN k % 7 = 0 THEN 'A' END AS triage_stage,
CASE WHEN k % 3 = 0 THEN CAST(CASE WHEN k % 7 = 0 THEN 101 ELSE 5 END AS BIGINT) END AS lamport FROM captures"""))
def status_updates(spark: SparkSession, sf: str) -> DataFrame:
    c = d.captures(spark, sf)
    images = c.select("image_id", "status", F.lit(None).cast("string").alias("triage_stage"), F.when(F.col("k") % 3 == 0, 5).cast("long").alias("lamport"), F.lit("h").alias("row_hash"), F.lit(None).cast("timestamp").alias("synced_at"))
    new = c.filter("k % 7 = 0").select("image_id", F.lit("blank").alias("status"), F.lit("A").alias("triage_stage"))
    return records.with_status(images, new, 100, ["image_id", "status", "triage_stage"]).select("image_id", "status", "triage_stage", "lamport")


@query(sql("SELECT image_id, CASE WHEN k % 5 = 0 THEN CASE WHEN station_id % 2 = 0 THEN station_id END ELSE station_id END AS station_id FROM captures"))
def confirmed_images(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the images comes without station; folders with even numbers get theirs, the others are skipped."""
    c = d.captures(spark, sf)
    folder = F.concat(F.lit("F"), F.col("station_id").cast("string"))
    images = c.select("image_id", folder.alias("folder"), F.when(F.col("k") % 5 != 0, F.col("station_id")).alias("station_id"))
    given = d.stations(spark).filter("station_id % 2 = 0").select(folder.alias("folder"), "station_id")
    return records.confirmed_images(images, given, d.stations(spark), [f"F{i}" for i in range(1, 36, 2)]).select("image_id", "station_id")


@query(sql("SELECT image_id FROM captures WHERE k % 4 <> 0"))
def still_to_ingest(spark: SparkSession, sf: str) -> DataFrame:
    c = d.captures(spark, sf).withColumn("sha256", F.sha2(F.col("image_id").cast("string"), 256))
    return records.still_to_ingest(c.select("image_id", "sha256"), c.filter("k % 4 = 0").select(F.lit(1).alias("run_id"), "sha256"), 1, "preflight").select("image_id")


@query(sql("""SELECT CAST(ind_id AS VARCHAR) || '-' || side AS entity_id, ind_id, side, count(*) AS crop_count FROM captures
WHERE k % 5 IN (1, 2) AND k % 10 <> 1 AND NOT (side = 'R' AND ind_id < 3) GROUP BY 1, 2, 3"""))
def entities_from_crops(spark: SparkSession, sf: str) -> DataFrame:
    t = spine_tables(spark, sf)
    there = spark.range(3).select(F.concat(F.col("id").cast("string"), F.lit("-R")).alias("entity_id"), F.col("id").alias("ind_id"), F.lit("R").alias("side"), F.lit(0).cast("long").alias("crop_count"))
    new, _ = records.entities_from_crops(t["assignments"].withColumn("entity_id", F.lit(None).cast("string")), t["crops"], there)
    return new.select("entity_id", "ind_id", "side", "crop_count")


@query(sql("SELECT image_id * 100 AS crop_id, CASE WHEN k % 10 = 1 OR ind_id <> 4 THEN ind_id ELSE 7 END AS ind_id FROM captures WHERE k % 5 IN (1, 2)"))
def confirmed_association(spark: SparkSession, sf: str) -> DataFrame:
    t = spine_tables(spark, sf)["assignments"]
    links = spark.createDataFrame([("x1", 7, 4, "UNKNOWN_RELATIONSHIP", None, None)], "assoc_id string, l_ind_id long, r_ind_id long, status string, confirmed_by string, confirmed_at timestamp")
    chosen = spark.createDataFrame([("x1", 7)], "assoc_id string, primary_ind long")
    _, moved = records.confirmed_association(links, t, chosen, "me", F.lit("2026-01-01").cast("timestamp"))
    return moved.select("crop_id", "ind_id")


@query(sql("SELECT image_id AS queue_id, CASE WHEN k % 4 = 3 OR (k % 4 <= 2 AND image_id % 3 = 0) THEN 'done' WHEN k % 4 = 2 THEN 'claimed' ELSE 'open' END AS state FROM captures"))
def closed_items(spark: SparkSession, sf: str) -> DataFrame:
    q = queue(spark, sf).withColumn("crop_id", F.col("queue_id"))
    return records.closed_items(q, q.filter("queue_id % 3 = 0").select("crop_id")).select("queue_id", "state")


@query(sql("SELECT image_id * 100 AS crop_id, CASE WHEN image_id % 2 = 0 THEN 'crop/' || image_id WHEN image_id % 3 = 0 THEN 'orig/' || image_id END AS shown FROM captures WHERE k % 5 IN (1, 2, 3)"))
def crop_paths(spark: SparkSession, sf: str) -> DataFrame:
    t = spine_tables(spark, sf)
    name = lambda kind, n: F.concat(F.lit(f"{kind}/"), n.cast("string"))
    crops = t["crops"].withColumn("path", name("crop", F.floor(F.col("det_id") / 10)))
    images = t["images"].withColumn("orig_path", name("orig", F.col("image_id")))
    files = t["images"].filter("image_id % 2 = 0").select(name("crop", F.col("image_id")).alias("path")).union(t["images"].filter("image_id % 3 = 0").select(name("orig", F.col("image_id"))))
    return records.crop_paths(crops, t["detections"], images, files)


@query(sql("SELECT image_id, status = 'error' AS person, k % 2 = 0 OR status <> 'error' AS granted FROM captures"))
def served_images(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of one status stand for persons; every other request comes from an allowed role."""
    c = d.captures(spark, sf)
    images = c.select("image_id", F.when(F.col("status") == "error", "person").otherwise(F.col("status")).alias("status"))
    asked = c.select(F.col("image_id").alias("request_id"), "image_id", F.when(F.col("k") % 2 == 0, "director").otherwise("ranger").alias("role"))
    return records.served(asked, images, ("director",)).select("image_id", "person", "granted")


@query(sql("SELECT station_id AS image_id, count(*) + 1 AS access_count FROM captures GROUP BY 1"))
def access_counts(spark: SparkSession, sf: str) -> DataFrame:
    held = d.captures(spark, sf).select(F.col("station_id").alias("image_id")).distinct().withColumn("access_count", F.lit(1).cast("long"))
    return records.access_counts(held, d.captures(spark, sf).select(F.col("station_id").alias("image_id")))


@query(sql("SELECT station_id, zone FROM stations WHERE station_id NOT IN (SELECT 30 + s FROM range(6) t(s)) UNION ALL SELECT 100 + s, 'core' FROM range(3) t(s)"))
def station_changes_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Three stations are added with defaults and six without images removed."""
    s = d.stations(spark)
    new = spark.range(3).select((F.col("id") + 100).alias("station_id"), F.lit(21.0).alias("lat"), F.lit(79.0).alias("lon"))
    stations, active = records.added_stations(s, d.activity(spark), new, F.lit("2024-01-01").cast("timestamp_ntz"))
    gone = spark.range(6).select((F.col("id") + 30).alias("station_id"))
    images = d.captures(spark, sf).filter("station_id < 30").select("image_id", "station_id")
    return records.removed_stations(stations, active, images, gone)[0].select("station_id", "zone")


@query(sql("""SELECT user_id AS job_id, CAST(max(k) AS BIGINT) AS done FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(json_extract_string(props, '$.k') AS INTEGER) DESC) AS r FROM events) WHERE r = 1 GROUP BY 1"""))
def checkpointed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "events")
    marks = e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("done"), F.col("event_id").cast("string").alias("cursor"))
    jobs = marks.select("job_id").distinct().select("job_id", F.lit(None).cast("timestamp_ntz").alias("checkpoint_at"), F.lit(0).cast("long").alias("done"), F.lit(None).cast("string").alias("cursor"))
    return records.checkpointed_jobs(jobs, marks).select("job_id", "done")


@query("""WITH b AS (SELECT c_custkey AS a, c_custkey % 17 AS x, c_custkey % 5 AS y FROM customer)
SELECT a, round(greatest(0, least(10, x + 4) - greatest(0, x)) * greatest(0, least(10, y + 4) - greatest(0, y)) / 16.0::DOUBLE, 6) AS overlap FROM b""")
def hull_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Squares of side 4 against one of side 10."""
    box = lambda x, y, side: F.array(*[F.struct((x + dx * side).cast("double").alias("x"), (y + dy * side).cast("double").alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])
    k = F.col("c_custkey")
    return d.table(spark, sf, "customer").select(k.alias("a"), F.round(geo.overlap(box(k % 17, k % 5, 4), box(F.lit(0), F.lit(0), 10)), 6).alias("overlap"))
