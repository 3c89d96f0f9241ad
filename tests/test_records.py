from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracklake.functions import geo
from tracklake.operators import records

NOW = datetime(2026, 3, 1)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_confirming_an_import(spark):
    images = spark.createDataFrame([("a", "F1", 1, NOW, "pending"), ("b", "F2", None, NOW, "pending"), ("c", "F3", None, NOW, "CORRUPT"), ("d", "F2", None, None, "pending")], "image_id string, folder string, station_id int, captured_at timestamp, status string")
    stations = spark.createDataFrame([(1,), (2,)], "station_id int")
    given = spark.createDataFrame([("F2", 2), ("F3", 99)], "folder string, station_id int")
    with pytest.raises(ValueError, match="F3"):
        records.confirmed_images(images, given, stations)
    done = records.confirmed_images(images, given, stations, ["F3"])
    assert rows(done, "image_id", "station_id") == [("a", 1), ("b", 2), ("c", None), ("d", 2)] or {r["image_id"]: r["station_id"] for r in done.collect()} == {"a": 1, "b": 2, "c": None, "d": 2}
    assert records.bursts_of_confirmed(done, 10).count() == 2
    scanned = spark.createDataFrame([("x",), ("y",)], "sha256 string")
    stored = spark.createDataFrame([(1, "x"), (2, "y")], "run_id int, sha256 string")
    assert rows(records.still_to_ingest(scanned, stored, 1, "preflight"), "sha256") == [("y",)]
    assert records.still_to_ingest(scanned, stored, 1, "triage").isEmpty()


def test_status_changes_restamp_tracked_rows_only(spark):
    images = spark.createDataFrame([("a", "pending", None, 3, "h", NOW), ("b", "pending", None, None, None, NOW), ("c", "pending", None, 4, "h", NOW)], "image_id string, status string, triage_stage string, lamport long, row_hash string, synced_at timestamp")
    new = spark.createDataFrame([("a", "blank", "A"), ("b", "blank", "A"), ("zz", "blank", "A")], "image_id string, status string, triage_stage string")
    got = {r["image_id"]: r for r in records.with_status(images, new, 8, ["image_id", "status", "triage_stage"]).collect()}
    assert (got["a"]["lamport"], got["a"]["synced_at"], got["a"]["status"]) == (9, None, "blank") and got["a"]["row_hash"] != "h"
    assert (got["b"]["lamport"], got["b"]["row_hash"], got["b"]["status"], got["b"]["synced_at"]) == (None, None, "blank", NOW)
    assert (got["c"]["lamport"], got["c"]["row_hash"], got["c"]["status"], got["c"]["synced_at"]) == (4, "h", "pending", NOW)


def test_entities_and_associations(spark):
    assigned = spark.createDataFrame([("k1", "i1", None, None), ("k2", "i1", None, None), ("k3", "i1", "z", None), ("k4", "i2", None, "old"), ("k5", "i2", None, None)], "crop_id string, ind_id string, superseded_by string, entity_id string")
    crops = spark.createDataFrame([("k1", "L"), ("k2", "L"), ("k3", "R"), ("k4", "R"), ("k5", "unknown")], "crop_id string, side string")
    none = spark.createDataFrame([("i2-R", "i2", "R", 7)], "entity_id string, ind_id string, side string, crop_count long")
    new, filled = records.entities_from_crops(assigned, crops, none)
    assert rows(new, "entity_id", "crop_count") == [("i1-L", 2)]
    assert {r["crop_id"]: r["entity_id"] for r in filled.collect()} == {"k1": "i1-L", "k2": "i1-L", "k3": "i1-R", "k4": "old", "k5": None}
    links = spark.createDataFrame([("x1", "i1", "i2", "UNKNOWN_RELATIONSHIP", None, None), ("x2", "i3", "i4", "UNKNOWN_RELATIONSHIP", None, None)], "assoc_id string, l_ind_id string, r_ind_id string, status string, confirmed_by string, confirmed_at timestamp")
    decided, moved = records.confirmed_association(links, assigned, spark.createDataFrame([("x1", "i2")], "assoc_id string, primary_ind string"), "me", F.lit(NOW))
    assert {r["assoc_id"]: r["status"] for r in decided.collect()} == {"x1": "CONFIRMED", "x2": "UNKNOWN_RELATIONSHIP"}
    assert {r["crop_id"]: r["ind_id"] for r in moved.collect()} == {"k1": "i2", "k2": "i2", "k3": "i1", "k4": "i2", "k5": "i2"}
    refused = records.rejected_association(decided, spark.createDataFrame([("x2",)], "assoc_id string"), "me", F.lit(NOW))
    assert {r["assoc_id"]: (r["status"], r["confirmed_by"]) for r in refused.collect()}["x2"] == ("REJECTED", "me")


def test_review_crops_and_access(spark):
    queue = spark.createDataFrame([("q1", "k1", "open"), ("q2", "k1", "claimed"), ("q3", "k1", "done"), ("q4", "k2", "open")], "queue_id string, crop_id string, state string")
    closed = records.closed_items(queue, spark.createDataFrame([("k1",)], "crop_id string"))
    assert records.open_items(closed).first()[0] == 1 and {r["state"] for r in closed.filter("crop_id = 'k1'").collect()} == {"done"}
    assert records.open_items(records.dismissed_items(queue, spark.createDataFrame([("q4",)], "queue_id string"))).first()[0] == 1
    with pytest.raises(KeyError):
        records.dismissed_items(queue, spark.createDataFrame([("q9",)], "queue_id string"))
    crops = spark.createDataFrame([("k1", 1, "c1.jpg"), ("k2", 1, "gone.jpg"), ("k3", 2, None)], "crop_id string, det_id int, path string")
    shown = records.crop_paths(crops, spark.createDataFrame([(1, "a"), (2, "b")], "det_id int, image_id string"), spark.createDataFrame([("a", "a.jpg"), ("b", "b.jpg")], "image_id string, orig_path string"), spark.createDataFrame([("c1.jpg",), ("a.jpg",)], "path string"))
    assert {r["crop_id"]: r["shown"] for r in shown.collect()} == {"k1": "c1.jpg", "k2": "a.jpg", "k3": None}
    asked = spark.createDataFrame([(1, "a", "ranger"), (2, "a", "director"), (3, "b", "ranger"), (4, "c", "director")], "request_id int, image_id string, role string")
    frames = spark.createDataFrame([("a", "person"), ("b", "animal")], "image_id string, status string")
    answer = records.served(asked, frames, ("director",))
    assert {r["request_id"]: r["granted"] for r in answer.collect()} == {1: False, 2: True, 3: True, 4: False}
    held = spark.createDataFrame([("a", None), ("z", 2)], "image_id string, access_count long")
    assert rows(records.access_counts(held, answer.filter("person")), "image_id", "access_count") == [("a", 2), ("z", 2)]


def test_stations(spark):
    have = spark.createDataFrame([(1, "A", 1.0, 2.0, "core", 3.0, NOW, None, "active")], "station_id int, name string, lat double, lon double, zone string, village_dist_km double, active_from timestamp, active_to timestamp, status string")
    active = spark.createDataFrame([("x", 1, NOW, None)], "activity_id string, station_id int, start_date timestamp, end_date timestamp")
    new = spark.createDataFrame([(2, 5.0, 6.0)], "station_id int, lat double, lon double")
    stations, deployed = records.added_stations(have, active, new, F.lit(NOW))
    got = {r["station_id"]: r for r in stations.collect()}
    assert (got[2]["name"], got[2]["zone"], got[2]["village_dist_km"], got[2]["status"]) == ("2", "core", 5.0, "active") and deployed.count() == 2
    with pytest.raises(ValueError):
        records.added_stations(have, active, new.withColumn("station_id", F.lit(1)), F.lit(NOW))
    changed = records.changed_stations(stations, spark.createDataFrame([(2, "buffer")], "station_id int, zone string"))
    assert {r["station_id"]: r["zone"] for r in changed.collect()} == {1: "core", 2: "buffer"}
    images = spark.createDataFrame([("a", 1)], "image_id string, station_id int")
    with pytest.raises(ValueError):
        records.removed_stations(stations, deployed, images, have)
    assert [t.count() for t in records.removed_stations(stations, deployed, images, new)] == [1, 1]
    edges = spark.createDataFrame([('{"a": 1}', "oops", None, None)], "boundary_geojson string, core_geojson string, buffer_geojson string, corridor_geojson string")
    out = records.boundaries(edges).select(F.variant_get("boundary_geojson", "$.a", "int"), F.col("core_geojson").cast("string"), F.col("buffer_geojson").isNull()).first()
    assert out[0] == 1 and "oops" in out[1] and out[2]


def test_jobs_and_accounts(spark):
    old, fresh = NOW - timedelta(hours=1), NOW - timedelta(seconds=5)
    jobs = spark.createDataFrame([("j1", "running", None, 0, old, None, None), ("j2", "running", None, 0, fresh, None, None), ("j3", "done", None, 0, old, None, None)], "job_id string, state string, cursor string, done long, checkpoint_at timestamp, error string, finished_at timestamp")
    assert {r["job_id"]: r["state"] for r in records.reaped_jobs(jobs, F.lit(NOW)).collect()} == {"j1": "paused", "j2": "running", "j3": "done"}
    marks = spark.createDataFrame([("j2", fresh, 10, "k10"), ("j2", NOW, 20, "k20")], "job_id string, at timestamp, done long, cursor string")
    assert rows(records.checkpointed_jobs(jobs, marks).filter("job_id = 'j2'"), "done", "cursor") == [(20, "k20")]
    ends = spark.createDataFrame([("j1", "failed", "x" * 3000), ("j3", "cancelled", None)], "job_id string, state string, error string")
    got = {r["job_id"]: r for r in records.ended_jobs(jobs, ends, F.lit(NOW)).collect()}
    assert (got["j1"]["state"], len(got["j1"]["error"]), got["j3"]["state"], got["j3"]["finished_at"]) == ("failed", 2000, "done", None)
    assert rows(records.after_cursor(spark.createDataFrame([("a",), ("b",)], "k string"), "k", "a"), "k") == [("b",)]
    users = spark.createDataFrame([("u", "ranger", False)], "username string, role string, disabled boolean")
    sessions = spark.createDataFrame([("t", "u", None)], "token string, username string, revoked_at timestamp")
    people, open_ = records.changed_accounts(users, sessions, spark.createDataFrame([("u", "ranger", True), ("v", "analyst", False)], users.schema), F.lit(NOW))
    assert people.count() == 2 and open_.first()["revoked_at"] == NOW
    marker = spark.createDataFrame([("seeded", old), ("odd", NOW)], "mode string, at timestamp")
    assert records.data_mode(marker) == "seeded" and records.data_mode(marker.limit(0)) == "live"
    assert records.worth_keeping({"individuals": users}) and not records.worth_keeping({"individuals": users.limit(0), "other": users})
    assert records.node_name(spark) == records.node_name(spark)
    told = spark.createDataFrame([(1, "{bad", old), (1, '{"blank": 3}', NOW), (2, "{}", NOW)], "run_id int, status_counts string, recorded_at timestamp")
    assert [r["status_counts"] for r in records.telemetry(told, 1).collect()] == [{"blank": 3}, {}]


def test_hull_overlap(spark):
    ring = lambda *points: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
    square, shifted = ring((0, 0), (2, 0), (2, 2), (0, 2)), ring((1, 1), (3, 1), (3, 3), (1, 3))
    inner, far, line = ring((0.5, 0.5), (1, 0.5), (0.5, 1)), ring((9, 9), (10, 9), (10, 10)), ring((0, 0), (1, 1))
    one = spark.range(1)
    got = one.select(geo.shoelace(geo.clipped(square, shifted)), geo.overlap(square, shifted), geo.overlap(square, inner), geo.overlap(inner, square), geo.overlap(square, far), geo.overlap(square, line), geo.overlap(square, square)).first()
    assert [round(v, 9) for v in got] == [1.0, 0.25, 1.0, 1.0, 0.0, 0.0, 1.0]


def test_of_several_updates_of_a_key_the_same_wins(spark):
    images = spark.createDataFrame([(1, "old", None, 5, "h", None)], "image_id long, status string, triage_stage string, lamport long, row_hash string, synced_at timestamp")
    updates = [(1, s, None) for s in "prsqab"]
    for parts in (1, 3, 6):
        df = spark.createDataFrame(updates, "image_id long, status string, triage_stage string").repartition(parts)
        assert records.with_status(images, df, 7, ["image_id", "status"]).first()["status"] == "s"
        assert records.set_many(images, df.select("image_id", "status"), "image_id").first()["status"] == "s"


CROPS = "crop_id string, det_id long, side string, rect_ok boolean, quality double, embedding array<double>, embed_model_version string, side_confidence double, side_source string"


def test_crops_are_recorded_end_early_and_get_vectors(spark):
    crops = spark.createDataFrame([("c1", 1, "L", True, 0.9, None, None, 0.8, "model")], CROPS)
    ended = records.terminal_crops(spark.createDataFrame([(7, None, None), (8, "R", 0.7), (9, "both", 0.1)], "det_id long, side string, side_confidence double"), F.lit("model"))
    both = records.recorded_crops(crops, ended)
    assert both.columns == crops.columns
    assert {r["det_id"]: (r["side"], r["rect_ok"], r["quality"], r["embedding"]) for r in both.collect()} == {1: ("L", True, 0.9, None), 7: ("unknown", False, 0.0, None), 8: ("R", False, 0.0, None), 9: ("unknown", False, 0.0, None)}
    for bad in (crops, ended.withColumn("side", F.lit("top"))):
        with pytest.raises(ValueError):
            records.recorded_crops(crops, bad).count()
    got = {r["crop_id"]: (r["embedding"], r["embed_model_version"]) for r in records.with_embeddings(both, spark.createDataFrame([("c1", [1.0, 0.0]), ("zz", [0.0, 1.0]), ("c9", None)], "crop_id string, embedding array<double>"), "m@2").collect()}
    assert got["c1"] == ([1.0, 0.0], "m@2") and sum(v[0] is not None for v in got.values()) == 1
    detections = spark.createDataFrame([(1, None, None, None), (2, "deer", 0.5, "x")], "det_id long, species string, species_conf double, species_source string")
    said = spark.createDataFrame([(1, "tiger", 0.9, "model")], detections.schema)
    assert sorted(map(tuple, records.with_species(detections, said).collect())) == [(1, "tiger", 0.9, "model"), (2, "deer", 0.5, "x")]


def test_a_run_s_first_screen_and_notes(spark):
    from tracklake.operators import cascade, catalogue

    images = spark.createDataFrame([(1, 1, "blank", "exif", '["dark"]'), (2, 1, "subject", "exif", '["dark", "drift"]'), (3, 1, "subject", "filename", "oops"), (4, 2, "blank", "exif", None)], "image_id long, run_id int, status string, time_source string, flags string")
    raised = spark.createDataFrame([(1, "act", False), (1, "watch", True), (2, "act", False)], "run_id int, severity string, suppressed boolean")
    told = catalogue.run_dashboard(1, images, F.col("status") == "subject", raised)
    (counts,) = told["counts"].collect()
    assert (counts["n_images"], counts["n_blank"], counts["n_animal"]) == (3, 1, 2)
    assert [tuple(r) for r in told["timestamp_sources"].collect()] == [("exif", 2), ("filename", 1)] and [tuple(r) for r in told["flags"].collect()] == [("dark", 2), ("drift", 1)]
    assert told["alerts"].first()["total"] == 2
    assert "nothing is left" in cascade.pending_note(0) and cascade.pending_note(5).startswith("5 ")


def test_merges_rebuild_entities(spark):
    assignments = spark.createDataFrame([("a1", "c1", "x", None), ("a2", "c2", "y", None), ("a3", "c3", "y", "a9")], "assign_id string, crop_id string, ind_id string, superseded_by string")
    crops = spark.createDataFrame([("c1", "L", datetime(2026, 1, 1)), ("c2", "L", datetime(2026, 1, 2)), ("c3", "R", datetime(2026, 1, 3))], "crop_id string, side string, captured_at timestamp")
    entities = spark.createDataFrame([("x-L", "x", "L", 1, datetime(2026, 1, 1)), ("y-L", "y", "L", 1, None)], "entity_id string, ind_id string, side string, crop_count long, first_seen timestamp")
    moved, found = records.merged_with_entities(assignments.withColumn("entity_id", F.when(F.col("superseded_by").isNull(), F.concat("ind_id", F.lit("-L")))), crops, entities, spark.createDataFrame([("y", "x")], "source string, target string"))
    assert {(r["assign_id"], r["ind_id"], r["entity_id"]) for r in moved.filter("superseded_by is null").collect()} == {("a1", "x", "x-L"), ("a2", "x", "x-L")}
    assert {(r["entity_id"], r["crop_count"], r["first_seen"]) for r in found.collect()} == {("x-L", 2, datetime(2026, 1, 1)), ("y-L", 1, None)}
