"""Queries of matching, evaluation, changes, triage, home ranges and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions import geo, vision
from tracklake.operators import alerts as rules
from tracklake.operators import catalogue, changes, effort, evaluation, identity, occupancy, tiles, triage
from tracklake.plans import derived as d
from tracklake.plans import survey
from tracklake.plans.derived import sql
from tracklake.storage import checkpointed

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text
        return f

    return register


# Matching -------------------------------------------------------------------------------------------------------------


def sided_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every 50th vector as a query, and all vectors as entries, with a side (label parity); labels are the individuals."""
    e = d.table(spark, sf, "embeddings").withColumn("side", F.col("label") % 2)
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "side")
    return queries, e.select(F.col("vec_id").alias("entity_id"), F.col("label").alias("ind_id"), "embedding", "side")


def vector_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the queries with all others of their side."""
    return tiles.all_scores(*sided_vectors(spark, sf), "side", digits=4, skip_self=True)


_SCORES = """s AS (SELECT q.vec_id AS query_id, e.vec_id AS entity_id, e.label AS ind_id, q.label AS q_label,
  round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 4) AS score
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.label % 2 = e.label % 2 AND q.vec_id <> e.vec_id)"""


@query(f"""WITH {_SCORES}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM s)
SELECT query_id, entity_id, ind_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ind_id ORDER BY rank) AS f FROM t WHERE rank <= 5) WHERE f = 1""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return identity.matched(*sided_vectors(spark, sf), "side", 5, digits=4, skip_self=True)


@query(f"""WITH {_SCORES}, t AS (SELECT query_id, ind_id, max(score) AS score FROM s GROUP BY 1, 2)
SELECT query_id, ind_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ind_id) AS rank FROM t) WHERE rank <= 5""")
def vector_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return identity.matched_individuals(*sided_vectors(spark, sf), "side", 5, digits=4, skip_self=True)


@query(f"""WITH {_SCORES} SELECT query_id, max(score) AS best, CASE WHEN max(score) >= 0.5 THEN 'auto' WHEN max(score) >= 0.3 THEN 'review' ELSE 'enroll' END AS decision FROM s GROUP BY query_id""")
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    best = tiles.top_entries(*sided_vectors(spark, sf), "side", 1, digits=4, skip_self=True).groupBy("query_id").agg(F.max("score").alias("best"))
    return best.withColumn("decision", vision.decide(F.col("best"), 0.3, 0.5))


@query(f"""WITH {_SCORES}, x AS (SELECT query_id, max(score) AS best FROM s GROUP BY query_id)
SELECT round(count(*) FILTER (best >= 0.5) / count(*), 4) AS "auto", round(count(*) FILTER (best >= 0.3 AND best < 0.5) / count(*), 4) AS review, round(count(*) FILTER (best < 0.3) / count(*), 4) AS enroll FROM x""")
def decide_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.bucket_shares(decisions(spark, sf), "decision")


def labelled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    labels = d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    scores = vector_scores(spark, sf).withColumnRenamed("entity_id", "gallery_id")
    return scores.join(labels, "query_id").withColumn("same", F.col("own") == F.col("ind_id"))


def score_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many of ``labelled_pairs`` have a score, of the same individual and of others; written once, as it is read twice."""
    entries = sided_vectors(spark, sf)[1]
    own = d.table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), "embedding", (F.col("label") % 2).alias("side"))
    return checkpointed(tiles.score_counts(own, entries, "side", digits=4, skip_self=True))


@query("""SELECT q.vec_id AS query_id, e.vec_id AS gallery_id, q.label = e.label AS same FROM embeddings q JOIN embeddings e ON q.label % 2 = e.label % 2
WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id AND NOT (q.label = e.label AND abs(q.vec_id - e.vec_id) <= 50)""")
def evaluation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("entity_id"), (F.col("label") % 2).alias("side"), F.col("vec_id").alias("frame"))
    return evaluation.evaluation_pairs(rows.filter("vec_id % 50 = 0"), rows)


@query(f"""WITH {_SCORES}, r AS (SELECT *, q_label = ind_id AS same, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM s),
h AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM r)
SELECT query_id, round(avg(hits / rank) FILTER (same), 6) AS average_precision, max(same AND rank <= 1) AS top1, max(same AND rank <= 5) AS top5 FROM h GROUP BY query_id HAVING count(*) FILTER (same) > 0""")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.ranking_quality(labelled_pairs(spark, sf)).withColumn("average_precision", F.round("average_precision", 6))


@query(f"""WITH {_SCORES}, p AS (SELECT score, q_label = ind_id AS same FROM s), r AS (SELECT same, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p),
c AS (SELECT CAST(sum(r) FILTER (same) AS DOUBLE) AS s, count(*) FILTER (same) AS n_pos, count(*) FILTER (NOT same) AS n_neg FROM r)
SELECT round((s - n_pos * (n_pos + 1) / 2.0) / (n_pos::DOUBLE * n_neg), 6) AS auc, n_pos, n_neg FROM c""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.counted_roc_auc(score_counts(spark, sf), "score")


@query(f"""WITH {_SCORES} SELECT round(quantile_cont(score, 0.05) FILTER (q_label = ind_id), 6) AS t_low, round(quantile_cont(score, 0.99) FILTER (q_label <> ind_id), 6) AS t_high FROM s""")
def calibrated_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.counted_thresholds(score_counts(spark, sf), "score")


@query(f"""WITH {_SCORES} SELECT query_id, max(score) FILTER (q_label = ind_id) AS genuine, max(score) FILTER (q_label <> ind_id) AS impostor FROM s GROUP BY query_id""")
def open_set_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.open_set_scores(labelled_pairs(spark, sf))


@query()
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.bootstrap_interval(d.captures(spark, sf).withColumn("hit", (F.col("k") < 40).cast("int")), "status", "hit")


# Evaluation -----------------------------------------------------------------------------------------------------------

#: The thresholds of the sweep.
THRESHOLDS = [0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2]


@query(sql(f"""-- more
x AS (SELECT k >= 50 AS animal, confidence AS score, unnest({THRESHOLDS}::DOUBLE[]) AS threshold FROM captures),
c AS (SELECT threshold, count(*) FILTER (animal AND score <= threshold) AS fn, count(*) FILTER (animal AND score > threshold) AS tp, count(*) FILTER (NOT animal AND score <= threshold) AS tn, count(*) FILTER (NOT animal AND score > threshold) AS fp FROM x GROUP BY threshold)
SELECT *, round(fn / (fn + tp), 4) AS fn_rate, round(tp / (fn + tp), 4) AS recall, round(tn / (tn + fp), 4) AS blank_caught, round(tn / nullif(tn + fn, 0), 4) AS quarantine_precision FROM c"""))
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.threshold_sweep(d.captures(spark, sf), F.col("k") >= 50, F.col("confidence"), THRESHOLDS)


@query(sql("SELECT status, count(*) FILTER (side = 'L') AS \"L\", count(*) FILTER (side = 'R') AS \"R\" FROM captures GROUP BY status"))
def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.label_confusion(d.captures(spark, sf), "status", "side", ["L", "R"])


@query(sql("""SELECT tag, count(*) AS n, round(avg(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END), 4) AS accuracy FROM (SELECT k, unnest([status, side]) AS tag FROM captures) GROUP BY tag"""))
def accuracy_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.accuracy_by_tag(d.captures(spark, sf), F.col("k") % 3 == 0, F.array("status", "side"))


@query(sql("""-- more
c AS (SELECT status, count(*) FILTER (k < 30)::DOUBLE AS x, count(*)::DOUBLE AS n FROM captures GROUP BY status)
SELECT status, round((x / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(x / n * (1 - x / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 4) AS low,
round((x / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(x / n * (1 - x / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 4) AS high FROM c"""))
def wilson_interval(spark: SparkSession, sf: str) -> DataFrame:
    counts = d.captures(spark, sf).groupBy("status").agg(F.count_if(F.col("k") < 30).alias("x"), F.count("*").alias("n"))
    low, high = evaluation.wilson(F.col("x"), F.col("n"))
    return counts.select("status", low.alias("low"), high.alias("high"))


@query("""WITH i AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY sha256('split|' || user_id), user_id) AS r, (SELECT greatest(1, floor(0.2 * count(*) + 0.5)) FROM i) AS n FROM i) SELECT user_id, r <= n AS held_out FROM r""")
def identity_split(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.identity_split(d.table(spark, sf, "events"), "user_id", 0.2)


# Changes --------------------------------------------------------------------------------------------------------------


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping versions of orders with clocks and origins."""
    o = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"))
    local = o.filter("id % 3 <> 0").select("id", "owner", "price", (F.col("id") % 7).alias("lamport"), F.lit("a").alias("origin"))
    remote = o.filter("id % 3 <> 1").select("id", "owner", F.when(F.col("id") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), (F.col("id") % 5).alias("lamport"), F.lit("b").alias("origin"))
    return local, remote


_HALVES = """l AS (SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS price, o_orderkey % 7 AS lamport, 'a' AS origin FROM orders WHERE o_orderkey % 3 <> 0),
r AS (SELECT o_orderkey AS id, o_custkey AS owner, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderkey % 5 AS lamport, 'b' AS origin FROM orders WHERE o_orderkey % 3 <> 1)"""


@query(f"""WITH {_HALVES} SELECT coalesce(l.id, r.id) AS id,
CASE WHEN l.id IS NULL OR (r.id IS NOT NULL AND l.price <> r.price AND (r.lamport, r.origin) > (l.lamport, l.origin)) THEN r.price ELSE l.price END AS price,
CASE WHEN r.id IS NULL THEN 'kept' WHEN l.id IS NULL THEN 'inserted' WHEN l.price = r.price THEN 'unchanged' ELSE 'conflict_resolved' END AS outcome FROM l FULL JOIN r ON l.id = r.id""")
def lww_merge(spark: SparkSession, sf: str) -> DataFrame:
    from tracklake.functions.text import row_hash

    local, remote = (x.withColumn("row_hash", row_hash("owner", "price")) for x in halves(spark, sf))
    return changes.merged_by_clock(local, remote, ["id"], ["owner", "price"]).select("id", "price", "outcome")


@query(f"WITH {_HALVES} SELECT id, owner, price, lamport, origin FROM r UNION ALL SELECT * FROM l WHERE id NOT IN (SELECT id FROM r)")
def insert_or_replace(spark: SparkSession, sf: str) -> DataFrame:
    local, remote = halves(spark, sf)
    return changes.replaced(local, remote, ["id"])


@query(f"WITH {_HALVES} SELECT id, owner FROM r WHERE id NOT IN (SELECT id FROM l)")
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    local, remote = halves(spark, sf)
    return changes.inserted_only(local, remote, ["id"]).select("id", "owner")


@query(f"WITH {_HALVES} SELECT coalesce(l.id, r.id) AS id, coalesce(r.price, l.price) AS price, coalesce(l.origin, r.origin) AS origin FROM l FULL JOIN r ON l.id = r.id")
def upsert_columns(spark: SparkSession, sf: str) -> DataFrame:
    local, remote = halves(spark, sf)
    return changes.upserted(local, remote, ["id"], ["price"]).select("id", "price", "origin")


@query(sql("SELECT station_id, ind_id, count(*) AS attempts, arg_max(status, captured_at) AS last_error FROM captures WHERE status = 'error' GROUP BY 1, 2"))
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    failures = d.captures(spark, sf).filter("status = 'error'").select("station_id", "ind_id", F.col("status").alias("error"), F.col("captured_at").alias("at"))
    return changes.with_attempts(failures, ["station_id", "ind_id"]).drop("last_at")


@query(sql("""SELECT image_id, ind_id, CASE WHEN k < 50 THEN (SELECT max(1000000 + c.image_id) FROM captures c WHERE c.k >= 50 AND c.station_id = captures.station_id) END AS superseded_by FROM captures WHERE k < 50
UNION ALL SELECT 1000000 + image_id, ind_id, NULL FROM captures WHERE k >= 50"""))
def supersede(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.captures(spark, sf).select("image_id", "ind_id", "station_id", "k").withColumn("superseded_by", F.lit(None).cast("long"))
    new = rows.filter("k >= 50").withColumn("image_id", F.col("image_id") + 1_000_000)
    return changes.superseded(rows.filter("k < 50"), new, "station_id", "image_id").select("image_id", "ind_id", "superseded_by")


@query("SELECT o_orderkey AS alert_id, o_orderpriority, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN o_orderdate END AS acknowledged_at FROM orders WHERE o_orderkey % 5 <> 0")
def replace_preserve_ack(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "alert_id")
    old = o.filter("alert_id % 2 = 0").select("alert_id", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("acknowledged_at"))
    return changes.replaced_alerts(old, o.filter("alert_id % 5 <> 0").select("alert_id", "o_orderpriority"))


@query("SELECT o_custkey, o_orderkey, 0 AS version FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_custkey % 10 = 3 AND o_orderkey % 2 = 0")
def replace_partition(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("part"), "o_custkey", "o_orderkey")
    return changes.replaced_partition(o.withColumn("version", F.lit(0)), o.filter("part = 3 and o_orderkey % 2 = 0").withColumn("version", F.lit(1)), "part").drop("part")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"customer": d.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "orders": d.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "lineitem": d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")}
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    return changes.cascaded(tables, links, {"customer": tables["customer"].filter("c_mktsegment = 'BUILDING'")})["lineitem"]


@query(sql("""SELECT image_id, CASE WHEN k % 3 = 0 OR (k % 3 = 1 AND captured_at < TIMESTAMP '2024-01-15 11:45:00') THEN 'me' WHEN k % 3 = 1 THEN 'other' WHEN k % 3 = 2 THEN NULL END AS claimed_by,
CASE WHEN k % 3 = 2 THEN 'done' ELSE 'claimed' END AS state FROM captures"""))
def claims(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k") % 3
    queue = d.captures(spark, sf).select("image_id", F.when(k == 0, "open").when(k == 1, "claimed").otherwise("done").alias("state"), F.when(k == 1, "other").alias("claimed_by"), F.when(k == 1, F.col("captured_at")).alias("claimed_at"))
    return changes.claimed(queue, F.lit(True), "me", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("image_id", "claimed_by", "state")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS key, 'enum:l_returnflag' AS rule FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'reference:l_suppkey' FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal <= 0)""")
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    known = d.table(spark, sf, "supplier").filter("s_acctbal > 0")
    return changes.violations(d.table(spark, sf, "lineitem"), {"l_returnflag": ["A", "N"]}, {"l_suppkey": (known, "s_suppkey")}, "l_orderkey")


@query("SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name")
def dedup_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    files = d.table(spark, sf, "part").select("p_partkey", "p_name", F.sha2("p_name", 256).alias("sha"))
    return changes.first_by_hash(files, "sha", "p_partkey").select("p_partkey", "p_name")


@query(sql("SELECT image_id, CASE WHEN k >= 5 THEN [1, 5, 15, 30][CAST(least(k - 5, 3) + 1 AS INT)] END AS minutes FROM captures"))
def lockouts(spark: SparkSession, sf: str) -> DataFrame:
    return d.captures(spark, sf).select("image_id", changes.lockout_minutes(F.col("k")).alias("minutes"))


# Triage ---------------------------------------------------------------------------------------------------------------


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """4 x 4 grids: flat with a little noise, and a lit cell in every seventh frame."""
    c = d.captures(spark, sf)
    lit = lambda i: F.lit(100) + (F.col("image_id") * (i + 3)) % 5 + F.when((F.col("k") % 7 == 0) & (F.col("image_id") % 16 == i), 80).otherwise(0)
    return c.select("image_id", "station_id", (F.col("k") % 2 == 1).alias("is_night"), "captured_at", F.array(*[lit(i).cast("int") for i in range(16)]).alias("grid"))


@query(sql("""-- more
g AS (SELECT image_id, station_id, k % 2 = 1 AS is_night, captured_at, list_transform(range(16), lambda i: 100 + (image_id * (i + 3)) % 5 + CASE WHEN k % 7 = 0 AND image_id % 16 = i THEN 80 ELSE 0 END) AS grid FROM captures),
n AS (SELECT *, row_number() OVER (PARTITION BY station_id, is_night ORDER BY captured_at, image_id) - 1 AS i, count(*) OVER (PARTITION BY station_id, is_night) AS n FROM g),
c AS (SELECT station_id, is_night, unnest(range(16)) AS cell, unnest(grid) AS v FROM n WHERE n <= 60 OR list_contains(list_transform(range(60), lambda j: (j * (n - 1)) // 59), i)),
b AS (SELECT station_id, is_night, cell, median(v) AS m FROM c GROUP BY 1, 2, 3 HAVING count(*) >= 3),
s AS (SELECT image_id, round(max(abs(v - m)) / 255.0, 6) AS score FROM (SELECT image_id, station_id, is_night, unnest(range(16)) AS cell, unnest(grid) AS v FROM g) JOIN b USING (station_id, is_night, cell) GROUP BY image_id)
SELECT image_id, score, coalesce(score <= 0.03, FALSE) AS blank, CASE WHEN score <= 0.03 THEN round(greatest(0, least(1, 1 - score / 0.03)), 6) END AS blank_confidence FROM g LEFT JOIN s USING (image_id)"""))
def blank_frames(spark: SparkSession, sf: str) -> DataFrame:
    return triage.blank_frames(grids(spark, sf))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of the images of the individuals' runs."""
    k, c = F.col("k"), d.visits(spark, sf)
    label = F.when(k == 1, "person").when(k == 2, "vehicle").when(k > 50, "animal").otherwise("other")
    return c.select((3 * F.col("ind_id") + F.col("run_id")).alias("image_id"), F.col("image_id").alias("det_id"), label.alias("label"), F.col("confidence").alias("conf"), (k / 100).alias("x"), (k / 200).alias("y"), F.lit(0.1).alias("w"), F.lit(0.2).alias("h"))


_ROUTED = """-- more
b AS (SELECT 3 * ind_id + run_id AS image_id, image_id AS det_id, CASE WHEN k = 1 THEN 'person' WHEN k = 2 THEN 'vehicle' WHEN k > 50 THEN 'animal' ELSE 'other' END AS label, confidence AS conf, k / 100 AS x, k / 200 AS y FROM visits),
r AS (SELECT *, CASE label WHEN 'person' THEN 3 WHEN 'vehicle' THEN 2 WHEN 'animal' THEN 1 ELSE 0 END AS rank FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rank DESC, conf DESC, det_id) AS n FROM r)"""


@query(sql(f"""{_ROUTED}
SELECT image_id, CASE WHEN rank = 0 THEN 'blank' ELSE label END AS route, CASE WHEN rank > 0 THEN conf END AS conf, CASE WHEN rank > 0 THEN det_id END AS det_id, CASE WHEN rank > 0 THEN x END AS x, CASE WHEN rank > 0 THEN y END AS y FROM t WHERE n = 1"""))
def routed(spark: SparkSession, sf: str) -> DataFrame:
    return triage.routed(boxes(spark, sf)).select("image_id", "route", "conf", "best.det_id", "best.x", "best.y")


@query(sql(f"""{_ROUTED},
i AS (SELECT range AS image_id FROM range(3040))
SELECT image_id, 'q_' || substr(sha256('run-1|' || image_id), 1, 12) AS q_id, image_id * 10 AS bytes FROM i LEFT JOIN (SELECT * FROM t WHERE n = 1) USING (image_id) WHERE coalesce(rank, 0) = 0 AND image_id % 5 <> 0"""))
def quarantined_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """Images without person, vehicle or animal, of those with detections and others, that do not lie in quarantine yet."""
    images = spark.range(3040).select(F.col("id").alias("image_id"), F.lit("run-1").alias("run_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("orig_path"), (F.col("id") * 10).alias("bytes"))
    held = images.filter("image_id % 5 = 0").select("image_id", F.lit(None).cast("timestamp").alias("restored_at"))
    changed = triage.route_changes(triage.routed(boxes(spark, sf), images), images, held, "detector@1", 0.2, F.lit("2024-02-01").cast("timestamp"))
    return changed["quarantine"].select("image_id", "q_id", "bytes")


# Home ranges and alerts -----------------------------------------------------------------------------------------------


def visit_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events of the individuals, with their first and last capture."""
    keys = ["run_id", "ind_id", "station_id", "event_no"]
    return survey.visit_bursts(spark, sf).groupBy(*keys).agg(F.min("captured_at").alias("started_at"), F.max("captured_at").alias("ended_at"))


def inputs(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "ind_id", "station_id").agg(F.count("*").alias("event_count"))


def home_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return ranges_of(spark, inputs(visit_events(spark, sf)), survey.survey_days(spark, sf))


def ranges_of(spark: SparkSession, used: DataFrame, days: DataFrame) -> DataFrame:
    everyone = spark.range(d.N_INDIVIDUALS).select(F.col("id").alias("ind_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run_id")).select("run_id", "ind_id")
    return occupancy.occupancy(used, d.stations(spark), days, everyone)


@query()
def occupancy_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return home_ranges(spark, sf)


_OCC = """
n AS (SELECT run_id, ind_id, station_id, count(DISTINCT event_no) AS n FROM vbursts GROUP BY 1, 2, 3),
occ AS (SELECT run_id, ind_id, CAST(sum(n) AS BIGINT) AS event_count, round(sum(lat * n) / sum(n), 5) AS centroid_lat, round(sum(lon * n) / sum(n), 5) AS centroid_lon, round(sum(coalesce(days, 0)), 2) AS effort_days
  FROM n JOIN stations USING (station_id) LEFT JOIN station_days USING (station_id, run_id) GROUP BY 1, 2)"""


@query(sql(f"-- more{_OCC} SELECT run_id, ind_id, coalesce(event_count, 0) AS event_count, centroid_lat, centroid_lon, coalesce(effort_days, 0) AS effort_days FROM (SELECT run_id, range AS ind_id FROM runs, range(1009)) LEFT JOIN occ USING (run_id, ind_id)"))
def occupancy_rows(spark: SparkSession, sf: str) -> DataFrame:
    return home_ranges(spark, sf).select("run_id", "ind_id", "event_count", "centroid_lat", "centroid_lon", "effort_days")


def alert_frame(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The wide frame, the moves of the runs and the effort.  Events are found and written once: ranges, coverage and moves all start from them."""
    events, days = checkpointed(visit_events(spark, sf)), checkpointed(survey.survey_days(spark, sf))
    used = checkpointed(inputs(events))
    occ = checkpointed(ranges_of(spark, used, days).filter("event_count > 0").select("run_id", "ind_id", "station_set", "centroid_lat", "centroid_lon", "event_count"))
    conf = d.visits(spark, sf).groupBy("run_id", "ind_id").agg(F.round(F.avg("confidence"), 3).alias("id_conf"))
    earlier = used.filter("run_id < 2").select(F.explode(F.sequence(F.col("run_id") + 1, F.lit(2))).alias("run_id"), "ind_id", "station_id").distinct()
    cov = effort.coverage(earlier, days, survey.periods(spark, sf))
    h = rules.history(occ, d.runs(spark), d.stations(spark), conf, cov)
    return h, rules.transits(events, d.stations(spark), ["run_id", "ind_id"]), days


def buffer_ratio(spark: SparkSession, sf: str, days: DataFrame) -> DataFrame:
    stations = d.stations(spark).filter("zone = 'buffer'").select("station_id")
    every = stations.withColumn("run_id", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("ind_id", F.lit(-1).cast("long"))
    return effort.coverage(every.select("run_id", "ind_id", "station_id"), days, survey.periods(spark, sf)).select("run_id", F.col("coverage").alias("ratio"))


#: The alert frame and the ten rules over it.  c: a row of an individual in a run with the two rows before it (l_, p_).
_ALERTS = f"""-- more{_OCC},
u AS (SELECT run_id, ind_id, station_id FROM n),
about AS (SELECT run_id, ind_id, avg(CAST(zone = 'buffer' AS INTEGER)) AS buffer_share, min(village_dist_km) AS nearest FROM u JOIN stations USING (station_id) GROUP BY 1, 2),
conf AS (SELECT run_id, ind_id, round(avg(confidence), 3) AS id_conf FROM visits GROUP BY 1, 2),
earlier AS (SELECT DISTINCT r.run_id, u.ind_id, u.station_id FROM u JOIN runs r ON r.run_id > u.run_id),
totals AS (SELECT e.run_id, ind_id, s.run_id AS d_run, round(sum(days), 2) AS total FROM earlier e JOIN station_days s USING (station_id) GROUP BY 1, 2, 3),
cov AS (SELECT run_id, ind_id, CASE WHEN sum(total) FILTER (d_run < run_id) > 0 THEN round(coalesce(sum(total) FILTER (d_run = run_id), 0) / (sum(total) FILTER (d_run < run_id) / run_id), 3) END AS coverage FROM totals GROUP BY 1, 2),
b_totals AS (SELECT run_id, round(sum(days), 2) AS total FROM station_days JOIN stations USING (station_id) WHERE zone = 'buffer' GROUP BY 1),
ratio AS (SELECT a.run_id, round(a.total / (sum(b.total) / a.run_id), 3) AS ratio FROM b_totals a JOIN b_totals b ON b.run_id < a.run_id GROUP BY a.run_id, a.total),
known AS (SELECT *, lag(run_id) OVER o AS l_run, lag(run_id, 2) OVER o AS p_run FROM occ JOIN about USING (run_id, ind_id) JOIN conf USING (run_id, ind_id) WINDOW o AS (PARTITION BY ind_id ORDER BY run_id)),
spread AS (SELECT r.run_id, f.ind_id FROM (SELECT ind_id, min(run_id) AS first_run FROM occ GROUP BY 1) f JOIN runs r ON r.run_id >= first_run WHERE r.run_id > 0),
last_two AS (SELECT s.run_id, s.ind_id, max(k.run_id) AS l_run, count(k.run_id) AS n_prior FROM spread s LEFT JOIN known k ON k.ind_id = s.ind_id AND k.run_id < s.run_id GROUP BY 1, 2),
c AS (SELECT t.run_id, t.ind_id, n_prior, k.event_count, k.centroid_lat AS lat, k.centroid_lon AS lon, k.nearest, k.id_conf, coverage,
  l.event_count AS l_count, l.centroid_lat AS l_lat, l.centroid_lon AS l_lon, l.nearest AS l_nearest, l.id_conf AS l_conf, l.buffer_share AS l_share, p.event_count AS p_count, p.centroid_lat AS p_lat, p.centroid_lon AS p_lon
  FROM last_two t LEFT JOIN known k ON k.ind_id = t.ind_id AND k.run_id = t.run_id LEFT JOIN known l ON l.ind_id = t.ind_id AND l.run_id = t.l_run LEFT JOIN known p ON p.ind_id = t.ind_id AND p.run_id = l.l_run
  LEFT JOIN cov ON cov.run_id = t.run_id AND cov.ind_id = t.ind_id),
fresh AS (SELECT u.run_id, u.ind_id, u.station_id, zone FROM u JOIN stations USING (station_id) WHERE u.run_id > 0 AND NOT EXISTS (SELECT 1 FROM u q WHERE q.ind_id = u.ind_id AND q.station_id = u.station_id AND q.run_id < u.run_id)),
watch AS (SELECT f.run_id, f.ind_id, f.station_id, count(s.run_id) AS active_before, count(q.run_id) AS watched FROM fresh f LEFT JOIN station_days s ON s.station_id = f.station_id AND s.days > 0 AND s.run_id < f.run_id
  LEFT JOIN occ q ON q.ind_id = f.ind_id AND q.run_id = s.run_id WHERE zone <> 'buffer' GROUP BY 1, 2, 3),
ev AS (SELECT run_id, ind_id, station_id, event_no, min(captured_at) AS a, max(captured_at) AS b FROM vbursts GROUP BY 1, 2, 3, 4),
steps AS (SELECT *, lag(station_id) OVER o AS s0, lag(b) OVER o AS b0 FROM ev WINDOW o AS (PARTITION BY run_id, ind_id ORDER BY a, station_id, event_no)),
moves AS (SELECT m.*, greatest(0.01, (epoch_us(a) - epoch_us(b0)) / 3600000000.0) AS hours, sqrt(power((y.lat - x.lat) * 111.0, 2) + power((y.lon - x.lon) * 111.320 * cos(radians((x.lat + y.lat) / 2)), 2)) AS km
  FROM steps m JOIN stations x ON x.station_id = s0 JOIN stations y ON y.station_id = m.station_id WHERE s0 <> m.station_id),
fast AS (SELECT *, row_number() OVER (PARTITION BY run_id, ind_id ORDER BY a, event_no, s0, station_id) AS r FROM moves WHERE km / hours > 25 AND km > 3),
km AS (SELECT *, sqrt(power((lat - l_lat) * 111.0, 2) + power((lon - l_lon) * 111.320 * cos(radians((lat + l_lat) / 2)), 2)) AS d2, sqrt(power((l_lat - p_lat) * 111.0, 2) + power((l_lon - p_lon) * 111.320 * cos(radians((l_lat + p_lat) / 2)), 2)) AS d1,
  CASE WHEN l_share > 0.5 THEN 5.0::DOUBLE ELSE sqrt(17.5::DOUBLE / pi()) END AS most, least(event_count, l_count) AS few,
  (degrees(atan2(sin(radians(lon - l_lon)) * cos(radians(lat)), cos(radians(l_lat)) * sin(radians(lat)) - sin(radians(l_lat)) * cos(radians(lat)) * cos(radians(lon - l_lon)))) + 360) % 360 AS b2,
  (degrees(atan2(sin(radians(l_lon - p_lon)) * cos(radians(l_lat)), cos(radians(p_lat)) * sin(radians(l_lat)) - sin(radians(p_lat)) * cos(radians(l_lat)) * cos(radians(l_lon - p_lon)))) + 360) % 360 AS b1,
  (l_count + coalesce(p_count, 0)) / (CASE WHEN p_count IS NULL THEN 1 ELSE 2 END) AS recent FROM c),
raw AS (
SELECT run_id, ind_id, 'centroid_shift' AS type, 'watch' AS severity, '' AS key, least(0.95, 0.55 + 0.25 * (d2 - most) / most) AS strength, id_conf, coverage, few < 5 AS held, 'only ' || few || ' events, below the minimum' AS reason FROM km WHERE d2 > most
UNION ALL SELECT run_id, ind_id, 'new_station', 'info', CAST(station_id AS VARCHAR), 0.6, id_conf, coverage, active_before < 1 OR watched = 0, CASE WHEN active_before < 1 THEN 'station was installed this cycle' ELSE 'individual was not detected while the station was active' END FROM watch JOIN c USING (run_id, ind_id) WHERE n_prior > 0
UNION ALL SELECT run_id, ind_id, 'buffer_ward', 'act', CAST(s AS VARCHAR), 0.85 * CASE WHEN ratio > 1.2 THEN 0.5 ELSE 1 END, id_conf, coverage, FALSE, NULL FROM (SELECT run_id, ind_id, min(station_id) AS s FROM fresh WHERE zone = 'buffer' GROUP BY 1, 2) JOIN c USING (run_id, ind_id) LEFT JOIN ratio USING (run_id)
UNION ALL SELECT run_id, ind_id, 'absence', 'watch', '', 0.7, l_conf, coverage, coalesce(coverage, 0) < 0.6, 'coverage ' || coalesce(coverage, 0.0::DOUBLE) || ' is too low' FROM c WHERE n_prior >= 2 AND event_count IS NULL
UNION ALL SELECT run_id, ind_id, 'directional_trend', 'watch', '', 0.75, id_conf, coverage, least(abs(b1 - b2), 360 - abs(b1 - b2)) > 50, 'movement is not in one direction' FROM km WHERE d1 >= 1 AND d2 >= 1
UNION ALL SELECT run_id, ind_id, 'decreasing_village_distance', 'act', '', 0.85, id_conf, coverage, FALSE, NULL FROM c WHERE nearest < l_nearest AND nearest <= 2.5
UNION ALL SELECT run_id, ind_id, 'activity_collapse', 'watch', '', 0.75, id_conf, coverage, coalesce(coverage, 0) < 0.6, 'survey coverage dropped' FROM km WHERE recent >= 4 AND event_count > 0 AND event_count <= 0.25 * recent
UNION ALL SELECT run_id, ind_id, 'new_corridor', 'watch', CAST(s AS VARCHAR), 0.8, id_conf, coverage, FALSE, NULL FROM (SELECT run_id, ind_id, min(station_id) AS s FROM fresh WHERE zone = 'corridor' GROUP BY 1, 2) JOIN c USING (run_id, ind_id) WHERE n_prior > 0
UNION ALL SELECT run_id, ind_id, 'travel_time_anomaly', 'watch', s0 || '_' || station_id, 0.85, id_conf, coverage, FALSE, NULL FROM fast JOIN c USING (run_id, ind_id) WHERE r = 1 AND n_prior > 0
UNION ALL SELECT run_id, ind_id, 'identity_confidence_collapse', 'watch', '', 0.8, id_conf, coverage, FALSE, NULL FROM c WHERE l_conf >= 0.8 AND l_conf - id_conf >= 0.25)
SELECT 'al_' || substr(sha256(run_id || '|' || ind_id || '|' || type || '|' || key), 1, 16) AS alert_id, run_id, ind_id, type, severity, key, round(least(coalesce(id_conf, 1), strength) * least(1, coalesce(coverage, 1)), 3) AS confidence,
coalesce(coverage, 1) AS coverage, held OR coalesce(id_conf < 0.55, FALSE) AS suppressed, CASE WHEN held THEN reason WHEN id_conf < 0.55 THEN 'identity confidence is below the review threshold' END AS suppress_reason FROM raw"""


@query(sql(_ALERTS))
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    h, moves, days = alert_frame(spark, sf)
    return rules.alerts(h, d.stations(spark), days, d.runs(spark), moves, buffer_ratio(spark, sf, days))


@query(sql(f"""-- more{_OCC},
x AS (SELECT run_id, ind_id, event_count, lag(event_count, 1) OVER o AS e1, lag(event_count, 2) OVER o AS e2 FROM occ WINDOW o AS (PARTITION BY ind_id ORDER BY run_id))
SELECT run_id, ind_id FROM x WHERE e1 IS NOT NULL AND (e1 + coalesce(e2, 0)) / (CASE WHEN e2 IS NULL THEN 1 ELSE 2 END) >= 4 AND event_count > 0 AND event_count <= 0.25 * (e1 + coalesce(e2, 0)) / (CASE WHEN e2 IS NULL THEN 1 ELSE 2 END)"""))
def alerts_activity_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return rules.activity_collapse(alert_frame(spark, sf)[0]).select("run_id", "ind_id")


@query(sql("""-- more
u AS (SELECT DISTINCT run_id, ind_id, station_id FROM visits)
SELECT u.run_id, u.ind_id, u.station_id AS key FROM u JOIN stations USING (station_id) WHERE zone <> 'buffer' AND EXISTS (SELECT 1 FROM u p WHERE p.ind_id = u.ind_id AND p.run_id < u.run_id)
AND NOT EXISTS (SELECT 1 FROM u p WHERE p.ind_id = u.ind_id AND p.station_id = u.station_id AND p.run_id < u.run_id)"""))
def alerts_new_station(spark: SparkSession, sf: str) -> DataFrame:
    h, _, days = alert_frame(spark, sf)
    found = rules.new_station(h, d.stations(spark), days, d.runs(spark))
    return found.select("run_id", "ind_id", F.col("key").cast("long").alias("key"))


@query(sql("""-- more
u AS (SELECT DISTINCT run_id, ind_id, station_id FROM visits),
f AS (SELECT u.run_id, u.ind_id, min(u.station_id) AS key FROM u JOIN stations USING (station_id) WHERE zone = 'corridor' AND u.run_id > 0 AND EXISTS (SELECT 1 FROM u p WHERE p.ind_id = u.ind_id AND p.run_id < u.run_id)
AND NOT EXISTS (SELECT 1 FROM u p WHERE p.ind_id = u.ind_id AND p.station_id = u.station_id AND p.run_id < u.run_id) GROUP BY 1, 2)
SELECT * FROM f"""))
def alerts_new_corridor(spark: SparkSession, sf: str) -> DataFrame:
    return rules.new_corridor(alert_frame(spark, sf)[0], d.stations(spark)).select("run_id", "ind_id", F.col("key").cast("long").alias("key"))


@query(sql("""-- more
u AS (SELECT run_id, ind_id, min(village_dist_km) AS near FROM (SELECT DISTINCT run_id, ind_id, station_id FROM visits) JOIN stations USING (station_id) GROUP BY 1, 2),
x AS (SELECT run_id, ind_id, near, lag(near) OVER (PARTITION BY ind_id ORDER BY run_id) AS before FROM u)
SELECT run_id, ind_id FROM x WHERE near < before AND near <= 2.5"""))
def alerts_village_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rules.decreasing_village_distance(alert_frame(spark, sf)[0]).select("run_id", "ind_id")


@query(sql("""SELECT station_id, round(sqrt(power((lat - 21.6) * 111.0, 2) + power((lon - 79.3) * 111.320 * cos(radians((lat + 21.6) / 2)), 2)), 1) AS km, TRUE AS close FROM sites"""))
def utm_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances in the projection agree with the equirectangular ones within 1 %."""
    east, north = geo.utm(F.col("lat"), F.col("lon"), 32644)
    e0, n0 = geo.utm(F.lit(21.6), F.lit(79.3), 32644)
    plain = geo.distance_km(F.lit(21.6), F.lit(79.3), F.col("lat"), F.col("lon"))
    projected = F.hypot(east - e0, north - n0) / 1000
    return d.sites(spark, sf).select("station_id", F.round(plain, 1).alias("km"), (F.abs(projected - plain) <= 0.01 * plain + 1e-6).alias("close"))
