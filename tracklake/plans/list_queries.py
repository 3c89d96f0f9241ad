"""Queries of lists, pages and sides, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import vision
from tracklake.operators import changes, identity, lists
from tracklake.plans import derived as d
from tracklake.plans.derived import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return register


@query("SELECT o_orderkey AS run_id, o_custkey % 5 AS reserve_id, o_orderdate AS started_at FROM orders WHERE o_custkey % 5 = 2 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def runs_listed(spark: SparkSession, sf: str) -> DataFrame:
    runs = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 5).alias("reserve_id"), F.col("o_orderdate").alias("started_at"))
    return lists.runs_listed(runs, 2)


@query(sql("SELECT image_id, station_id, name AS station_name, captured_at FROM captures LEFT JOIN (SELECT * FROM stations WHERE station_id < 30) USING (station_id) WHERE status = 'error'"))
def images_of_status(spark: SparkSession, sf: str) -> DataFrame:
    known = d.stations(spark).filter("station_id < 30")
    return lists.images_of_status(d.captures(spark, sf), known, "error").select("image_id", "station_id", "station_name", "captured_at")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 150 AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_of(spark: SparkSession, sf: str) -> DataFrame:
    return lists.page_of(d.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 100, 50)


@query(sql("SELECT DISTINCT ind_id, side FROM visits WHERE side = 'L'"))
def catalogue_of_side(spark: SparkSession, sf: str) -> DataFrame:
    return lists.catalogue_of_side(d.visits(spark, sf).select("ind_id", "side").distinct(), "L")


@query("SELECT o_orderkey AS alert_id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS acknowledged_at, row_number() OVER (ORDER BY o_orderstatus = 'F', o_orderkey) AS place FROM orders")
def acknowledged_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("alert_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("acknowledged_at"))
    return d.in_order(lists.acknowledged_last(rows, "alert_id"))


@query(sql("SELECT image_id, confidence AS conf, station_id, captured_at FROM captures WHERE k % 5 <> 0 ORDER BY confidence, image_id LIMIT 24"))
def quarantine_sample(spark: SparkSession, sf: str) -> DataFrame:
    c = d.captures(spark, sf)
    held = c.select("image_id", F.col("confidence").alias("conf"), F.when(F.col("k") % 5 == 0, F.col("captured_at")).alias("restored_at"))
    return lists.quarantine_sample(held, c.withColumn("is_night", F.col("k") % 2 == 1)).select("image_id", "conf", "station_id", "captured_at")


@query("SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS path FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def quarantine_manifest(spark: SparkSession, sf: str) -> DataFrame:
    ids = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    new = ids.filter("image_id % 3 = 0").withColumn("path", F.lit("new"))
    return lists.quarantine_manifest(ids.filter("image_id % 2 = 0").withColumn("path", F.lit("old")), new.union(new))


@query("SELECT c_custkey AS ind_id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS area_km2, c_custkey % 3 = 0 AS provisional, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS place FROM customer WHERE c_custkey % 2 = 0")
def occupancy_listed(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("ind_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("area_km2"))
    known = d.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ind_id"), (F.col("c_custkey") % 3 == 0).alias("provisional"))
    return d.in_order(lists.occupancy_listed(rows, known))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    return d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 3).cast("int").alias("run_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("created_at"), state.alias("state"))


@query("SELECT o_orderkey AS job_id, o_orderpriority AS kind, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return lists.recent_jobs(jobs(spark, sf)).select("job_id", "kind", "created_at")


@query("SELECT o_orderkey AS job_id, o_orderdate AS created_at, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_custkey % 3 = 1")
def jobs_of_run(spark: SparkSession, sf: str) -> DataFrame:
    return d.in_order(lists.jobs_of_run(jobs(spark, sf), 1).select("job_id", "created_at"))


@query("SELECT l_orderkey AS job_id, l_linenumber AS item, CAST(o_custkey % 3 AS INTEGER) AS run_id, o_orderpriority AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def failed_items(spark: SparkSession, sf: str) -> DataFrame:
    items = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("item"), F.when(F.col("l_returnflag") == "R", "dead").otherwise("done").alias("state"))
    return lists.failed_items(items, jobs(spark, sf)).select("job_id", "item", "run_id", "kind")


@query("""WITH e AS (SELECT vec_id, label AS ind, CASE WHEN vec_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, q.ind AS qi, q.side AS qs, e.ind, e.side, e.vec_id, round(list_dot_product(q.v, e.v), 9) AS score FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM p)
SELECT count(*) AS total, count(*) FILTER (ind = qi AND side = qs) AS correct_entity_hits, count(*) FILTER (ind = qi AND side <> qs) AS opposite_flank_hits FROM t WHERE r = 1""")
def side_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th vector against all others in one pool; an individual's sides are by parity of the vector's id."""
    e = d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity_id"), F.col("label").alias("ind_id"), "embedding", F.lit(0).alias("pool"))
    best = identity.matched(e.filter("entity_id % 50 = 0").select(F.col("entity_id").alias("query_id"), "embedding", "pool"), e, "pool", 1, digits=9, skip_self=True)
    side = lambda c: F.when(F.col(c) % 2 == 0, "L").otherwise("R")
    named = lambda ind, of: F.concat_ws("-", F.col(ind).cast("string"), side(of))
    own = e.select(F.col("entity_id").alias("query_id"), F.col("ind_id").alias("query_ind"))
    rows = best.join(own, "query_id").select("query_id", "query_ind", side("query_id").alias("query_side"), named("query_ind", "query_id").alias("query_entity"), named("ind_id", "entity_id").alias("entity"), "ind_id", side("entity_id").alias("side"), "score")
    return lists.side_leakage(rows.withColumnRenamed("entity", "entity_id"))


@query("SELECT o_orderkey AS log_id, o_orderpriority AS actor FROM orders ORDER BY o_orderkey DESC LIMIT 200")
def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    return lists.audit_tail(d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("log_id"), F.col("o_orderpriority").alias("actor")))


@query("SELECT l_orderkey AS job_id, l_linenumber AS item_id, l_shipdate AS updated_at FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 25")
def recent_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("item_id"), F.col("l_shipdate").alias("updated_at"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("state"))
    return lists.recent_failures(rows).drop("state")


@query(sql("SELECT reserve_id, run_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY reserve_id ORDER BY started_at DESC, run_id DESC) AS r FROM order_runs) WHERE r = 1"))
def latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    return lists.latest_runs(d.order_runs(spark, sf))


@query(sql("SELECT image_id, station_id, captured_at, row_number() OVER (ORDER BY station_id, captured_at, image_id) AS place FROM captures WHERE run_id = 1"))
def images_of_run(spark: SparkSession, sf: str) -> DataFrame:
    return d.in_order(lists.images_of_run(d.captures(spark, sf), 1).select("image_id", "station_id", "captured_at"))


@query(sql("""SELECT image_id, station_id, '' AS captured_at, NOT (k % 3 = 0) AS is_animal FROM (SELECT image_id, CAST(station_id AS VARCHAR) AS station_id, k FROM captures)"""))
def image_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Every third image has the empty category alone, the next ones it and another, the rest none."""
    c = d.captures(spark, sf)
    images = c.select(F.col("image_id").alias("id"), F.col("station_id").alias("location"), F.lit(None).cast("string").alias("date_captured"))
    some = c.filter("k % 3 <> 2").select("image_id", F.explode(F.when(F.col("k") % 3 == 0, F.array(F.lit(30))).otherwise(F.array(F.lit(30), F.lit(5)))).alias("category_id"))
    return lists.image_truth(images, some)


@query(sql("""SELECT image_id, CASE WHEN k % 4 = 0 THEN 'R' WHEN k % 4 = 1 THEN 'L' ELSE 'UNKNOWN' END AS side FROM captures"""))
def voted_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Two pairs of points that agree on a side, disagree, or say nothing."""
    k = F.col("k") % 4
    point = lambda seen: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(seen, 2).otherwise(0).alias("v"))
    points = F.struct(point((k == 0) | (k == 2)).alias("right_shoulder"), point((k == 1) | (k == 3)).alias("left_shoulder"), point((k == 0) | (k == 3)).alias("right_hip"), point((k == 1) | (k == 2)).alias("left_hip"))
    pairs = [("right_shoulder", "left_shoulder"), ("right_hip", "left_hip")]
    return d.captures(spark, sf).select("image_id", vision.voted_side(points, pairs).alias("side"))


@query("SELECT c_custkey AS ind_id, c_custkey % 2 = 0 AND c_custkey % 6 <> 0 AS provisional, CASE WHEN c_custkey % 6 = 0 THEN 77 ELSE 1 END AS lamport FROM customer")
def promoted(spark: SparkSession, sf: str) -> DataFrame:
    people = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("ind_id"), (F.col("c_custkey") % 2 == 0).alias("provisional"), F.lit(1).alias("lamport"), F.lit(None).cast("timestamp").alias("synced_at"), F.lit("h").alias("row_hash"))
    chosen = people.filter("ind_id % 3 = 0").select("ind_id")
    return changes.promoted(people, chosen, 77, ["ind_id", "provisional"]).select("ind_id", "provisional", "lamport")
