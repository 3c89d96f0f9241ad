"""Queries over small made tables, against their own SQL."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tracklake.operators import identity
from tracklake.plans import analytics, survey

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def from_sql(text, folder, *tables):
    con = duckdb.connect()
    for name in tables:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return sorted(con.sql(text).fetchall())


def test_activity_collapses_only_where_all_captures_say_so(spark, tmp_path):
    seen = [(1, first, 8) for first in (1, 11, 21)] + [(2, 1, 8), (2, 11, 8), (2, 21, 1)]
    days = [(user, first + i) for user, first, n in seen for i in range(n)]
    rows = [(2 * i, datetime(2024, 1, 1) + timedelta(days=day - 1), user, "view", 50.0, '{"k": 0}') for i, (user, day) in enumerate(days)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in analytics.alerts_activity_collapse(spark, str(tmp_path)).collect())
    # Individual 1 is seen as often as before: an alert for it comes from rows that were left out.
    assert got == [(2, 2)] == from_sql(analytics.ORACLE["alerts_activity_collapse"], tmp_path, "events")


def test_nearest_opposite_is_that_of_all_pairs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(40_000)), rng.randrange(4), "view", 50.0, f'{{"k": {int(rng.random() < 0.2)}}}') for i in range(400)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in survey.nearest_opposite_side(spark, str(tmp_path)).collect())
    assert got == from_sql(survey.ORACLE["nearest_opposite_side"], tmp_path, "events") and 100 < len(got) < 400
    times = [(i, 0, rng.choice("LRX") if i % 9 else None, rng.randrange(60)) for i in range(80)]
    df = spark.createDataFrame(times, "image_id long, g long, side string, s long").select("image_id", "g", "side", F.timestamp_seconds("s").alias("captured_at"))
    want = set()
    for i, _, side, t in times:
        near = [(abs(t - u), j) for j, _, other, u in times if side and other and side != other and abs(t - u) <= 5]
        want |= {(i, min(near)[1], min(near)[0])} if near else set()
    assert {tuple(r) for r in identity.nearest_opposite(df, 5, ["g"]).collect()} == want


def test_nearest_opposite_makes_no_pairs_of_captures(spark):
    """4,000 captures of one station in ten seconds are 8 million pairs."""
    df = spark.range(4000).select(F.col("id").alias("image_id"), F.lit(0).alias("g"), F.when(F.col("id") % 2 == 0, "L").otherwise("R").alias("side"), F.timestamp_seconds(F.col("id") % 10).alias("captured_at"))
    out = identity.nearest_opposite(df, 3600, ["g"])
    assert out.count() == 4000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("bucket" in line for line in plan.splitlines() if "Join" in line)
