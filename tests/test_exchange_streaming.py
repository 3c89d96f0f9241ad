import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracklake.functions.text import row_hash
from tracklake.operators import evaluation, sessions
from tracklake.sources import exchange, files
from tracklake.sources.tables import TableLog
from tracklake.streaming.bursts import ClockTable, streamed_bursts

T0 = datetime(2026, 1, 1)


def test_scan_folder(spark, tmp_path):
    png, jpeg = b"\x89PNG\r\n\x1a\n" + b"x" * 20, b"\xff\xd8\xff\xe0" + b"y" * 20
    for name, data in {"a/1.png": png, "a/2.png": png, "b/3.jpg": jpeg, "b/4.jpg": b"", "c/5.jpg": b"", "c/notes.txt": b"hello", "c/ü.webp": b"RIFF1234WEBPzz"}.items():
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(data)
    scanned = files.scan_folder(spark, str(tmp_path))
    by = {r["name"]: r for r in scanned.collect()}
    assert by["1.png"]["format"] == "png" and by["3.jpg"]["format"] == "jpeg" and by["4.jpg"]["flags"] == ["empty"] and by["notes.txt"]["corrupt"]
    assert sum(r["format"] == "webp" for r in by.values()) == 1
    assert by["1.png"]["sha256"] == by["2.png"]["sha256"] and by["4.jpg"]["sha256"] != by["5.jpg"]["sha256"]
    known = spark.createDataFrame([(by["3.jpg"]["sha256"][:16],)], "image_id string")
    rows, counts = files.shaped_images(scanned, "r1", known)
    assert rows.count() == 5 and counts.first()[:] == (7, 3, 1)
    assert files.preflight(scanned, 10**9).first()["warning"] is None


def test_stations_in_and_out(spark, tmp_path):
    (tmp_path / "s.csv").write_text("ID,Latitude,longitude,Zone,make\nS1,21.5,79.2,Buffer,Cam\nS2,0,79.2,core,\nS3,21.5,79.3,nowhere,\n,1,1,core,\n")
    good, errors = exchange.stations_from_csv(spark, str(tmp_path / "s.csv"))
    assert sorted((r["station_id"], r["zone"], r["village_dist_km"]) for r in good.collect()) == [("S1", "buffer", 5.0), ("S3", "core", 5.0)]
    assert sorted((r["row"], r["error"]) for r in errors.collect()) == [(2, "no valid position"), (4, "no id")]
    features = [json.loads(r["feature"]) for r in exchange.station_features(good).collect()]
    features.append({"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {}})
    (tmp_path / "s.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    back, _ = exchange.stations_from_geojson(spark, str(tmp_path / "s.geojson"))
    assert sorted((r["station_id"], r["lat"], r["lon"], r["zone"]) for r in back.collect()) == sorted((r["station_id"], r["lat"], r["lon"], r["zone"]) for r in good.collect())
    with pytest.raises(exchange.SchemaNotAvailable):
        exchange.export_mstripes()


def test_rows_in_error_are_numbered_in_a_file_of_many_blocks(spark, tmp_path):
    lines = ["station_id,lat,lon,village_dist_km,serial,folder_hint"] + [f"S{i},{0 if i % 50 == 3 else 21.5},79.2,{'far' if i % 70 == 5 else ''},C{i},{'' if i % 2 else 'F'}" for i in range(1, 401)]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    try:
        good, errors = exchange.stations_from_csv(spark, str(tmp_path / "s.csv"))
        assert good.rdd.getNumPartitions() >= 1
        want = {i: "no valid position" for i in range(1, 401) if i % 50 == 3} | {i: "no valid distance" for i in range(1, 401) if i % 70 == 5 and i % 50 != 3}
        assert {r["row"]: r["error"] for r in errors.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = {r["station_id"]: r for r in good.collect()}
    assert one["S1"]["folder_hint"] == "S1" and one["S2"]["folder_hint"] == "F" and one["S2"]["camera_serial"] == "C2" and one["S2"]["grid_cell"] is None
    features = [{"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [79.2, 21.5]}, "properties": {}}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": []}, "properties": {}}, {"type": "Feature", "id": "b", "geometry": {"type": "Point", "coordinates": [79.2, 0]}, "properties": {}}]
    (tmp_path / "s.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    assert [(r["row"], r["error"]) for r in exchange.stations_from_geojson(spark, str(tmp_path / "s.geojson"))[1].collect()] == [(3, "no valid position")]


def test_range_exports_hide_positions(spark):
    occ = spark.createDataFrame([(1, 2, [3, 4], "POLYGON((1.0 2.0, 3.0 4.0, 5.0 1.0, 1.0 2.0))", 9.5, 2.0, 3.0, 7, 1.5, None), (1, 3, [], None, None, None, None, 0, 0.0, "no captures this cycle")], "run_id int, ind_id long, station_set array<long>, hull_wkt string, area_km2 double, centroid_lat double, centroid_lon double, event_count long, effort_days double, insufficient_reason string")
    shown, hidden = ([json.loads(r["feature"]) for r in exchange.range_features(occ, w).collect()] for w in (True, False))
    assert len(shown) == 1 and shown[0]["geometry"]["coordinates"][0][1] == [3.0, 4.0]
    assert hidden[0]["geometry"] is None and "centroid_lat" not in hidden[0]["properties"]
    rows = {r["ind_id"]: r for r in exchange.range_rows(occ, False).collect()}
    assert rows["2"]["station_set"] == "" and rows["2"]["area_km2"] == "9.5"


def test_package(spark):
    stations = spark.createDataFrame([(1, "S1", 21.5, 79.2)], "station_id long, name string, lat double, lon double")
    activity = spark.createDataFrame([(10, 1, T0, T0 + timedelta(days=5)), (11, 1, T0 + timedelta(days=6), None)], "activity_id long, station_id long, start_date timestamp, end_date timestamp")
    media = spark.createDataFrame([(1, 1, T0 + timedelta(days=1), "animal", "p1"), (2, 1, T0 + timedelta(days=7), "person", "p2"), (3, 9, T0, "blank", "p3"), (4, 1, T0 - timedelta(days=1), "blank", "p4"), (5, 1, T0, "BLANK", "p5")], "image_id long, station_id long, captured_at timestamp, status string, path string")
    detections = spark.createDataFrame([(1, 100, "animal", "tiger", 0.8, 0.0), (2, 101, "odd", None, 0.0, None)], "image_id long, det_id long, label string, species string, conf double, assign_confidence double")
    tables = exchange.camera_trap_package(stations, activity, media, detections)
    shown = {r["mediaID"]: (r["deploymentID"], r["filePublic"]) for r in tables["media"].collect()}
    assert shown == {1: (10, True), 2: (11, False), 4: (10, True), 5: (10, True)}
    seen = {r["observationID"]: (r["observationType"], r["scientificName"], r["classificationProbability"]) for r in tables["observations"].collect()}
    assert seen == {"100": ("animal", "Panthera tigris", 0.8), "101": ("unclassified", None, None), "blank_4": ("blank", None, None)}
    far = exchange.camera_trap_package(stations, activity, media, detections, F.lit(T0 + timedelta(days=30)), include_locations=False)
    ends = {r["deploymentID"]: (r["deploymentEnd"], r["latitude"], r["locationName"]) for r in far["deployments"].collect()}
    assert ends == {10: (T0 + timedelta(days=5), None, "S1"), 11: (T0 + timedelta(days=30), None, "S1")}
    assert {r["mediaID"]: r["fileName"] for r in exchange.camera_trap_package(stations, activity, media.withColumn("path", F.concat(F.lit("/a/b/"), "path")), detections)["media"].collect()}[1] == "p1"


def test_bundle_round_trip_and_tampering(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exchange, "ROWS_PER_LEAF", 4)
    monkeypatch.setattr(exchange, "CHILDREN", 3)
    rows = spark.createDataFrame([(i, f"v{i}", i, None if i % 3 else 0.5 * i) for i in range(120)], "id long, v string, lamport long, x double").withColumn("row_hash", row_hash("id", "v"))
    keys, secret = {"t": ["id"], "empty": ["id"]}, b"secret"
    signed = exchange.write_bundle({"t": rows, "empty": rows.limit(0)}, 9, str(tmp_path / "b"), secret, keys)
    audit = lambda at, s=signed, key=secret: exchange.audited_bundle(spark, at, ["t", "empty"], 9, s, key, keys)
    sound = exchange.read_bundle(spark, str(tmp_path / "b"), ["t", "empty"], 9, signed, secret, keys)
    assert sound["t"].count() == 110 and sound["empty"].count() == 0
    for s, key in (("", secret), (signed, b"other"), (exchange.signature({"t": [1, ""]}, 9, b"other"), secret)):
        with pytest.raises(ValueError, match="signature"):
            audit(str(tmp_path / "b"), s, key)
    leaves, t = 110 // 4, spark.read.parquet(str(tmp_path / "b/t"))
    where = {r["id"]: r["node"] for r in t.select("id", (F.conv(F.substring(F.sha2(exchange._json(["id"]), 256), 1, 12), 16, 10).cast("decimal(20,0)") * leaves / F.lit(1 << 48)).cast("long").alias("node")).collect()}
    other = F.when(F.col("id") == 30, "v31").when(F.col("id") == 31, "v30").otherwise(F.col("v"))
    damage = {
        "replaced": (t.withColumn("v", F.when(F.col("id") == 50, "x").otherwise(F.col("v"))), {50}, 0),
        "clock": (t.withColumn("lamport", F.when(F.col("id") == 50, 999).otherwise(F.col("lamport"))), {50}, 0),
        "lost": (t.filter("id <> 12"), {12}, -1),
        "repeated": (t.union(t.filter("id = 77")), {77}, 1),
        "swapped": (t.withColumn("v", other).withColumn("row_hash", row_hash("id", "v")), {30, 31}, 0),
        "added": (t.union(t.filter("id = 20").withColumn("id", F.lit(10).cast("long"))), {10}, 1),
    }
    for name, (df, ids, more) in damage.items():
        at = str(tmp_path / name)
        df.write.parquet(f"{at}/t")
        for part in ("empty", "_trees/t", "_trees/empty"):
            spark.read.parquet(str(tmp_path / "b" / part)).write.parquet(f"{at}/{part}")
        spark.read.text(str(tmp_path / "b/_trees/_roots")).write.text(f"{at}/_trees/_roots")
        found = audit(at).collect()
        assert {r["node"] for r in found} == {where[i] for i in ids} and {r["table"] for r in found} == {"t"}, name
        assert sum(r["found_rows"] - r["signed_rows"] for r in found) == more
        with pytest.raises(ValueError, match="t range"):
            exchange.read_bundle(spark, at, ["t", "empty"], 9, signed, secret, keys)
    # A forged tree for other rows does not lead to the signed root.
    at = str(tmp_path / "replaced")
    forged = exchange.tree_of(spark.read.parquet(f"{at}/t"), "t", ["id"], b"guess", leaves)
    forged.write.mode("overwrite").parquet(f"{at}/_trees/t")
    with pytest.raises(ValueError, match="tree of t"):
        audit(at)


def test_streamed_bursts_equal_batch(spark, tmp_path):
    rows = [(i % 3, i, T0 + timedelta(seconds=37 * i * (i % 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "station_id long, image_id long, captured_at timestamp").repartition(1).sortWithinPartitions("captured_at")
    df.write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(99, 999, T0 + timedelta(days=30))], df.schema)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streamed_bursts(stream, 60, "30 days").writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    late.write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(98, 998, T0 + timedelta(days=90))], df.schema).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.table("bursts").filter("station_id < 10").collect())
    batch = sessions.burst_events(df, 60).select("station_id", "started_at", "ended_at", "frames")
    assert got == sorted(tuple(r) for r in batch.collect())


def test_streamed_merge(spark, tmp_path):
    schema = "id long, v string, lamport long, origin string, row_hash string"
    log = TableLog(spark, str(tmp_path / "tables"))
    table = ClockTable(log, "things", ["id"], buckets=8)
    table.merge(spark.createDataFrame([(1, "a", 1, "x", "h1")], schema), -1)  # what was there before the stream
    table.merge(spark.createDataFrame([(1, "a", 1, "x", "h1")], schema), 0)
    log.commit([], cursor=("merge:things", {"batch": 0}))
    spark.createDataFrame([(1, "b", 2, "y", "h2"), (2, "c", 1, "y", "h3")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number + 1)).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["id"], r["v"]) for r in table.rows().collect()) == [(1, "b"), (2, "c")]


def test_package_descriptor_and_empty_tables(spark, tmp_path):
    told = exchange.package_descriptor("TR-1", "North", 7, created=datetime(2024, 3, 1, 12, 0, 5, 9))
    assert told["name"] == "tracklake-tr-1-7" and told["created"] == "2024-03-01T12:00:05" and "7" in told["title"] and [r["name"] for r in told["resources"]] == ["deployments", "media", "observations"]
    some = spark.createDataFrame([(1, "a")], "mediaID long, filePath string").coalesce(1)
    exchange.write_package({"media": some, "observations": some.limit(0)}, str(tmp_path), told)
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert read("media") == "mediaID,filePath\n1,a\n" and read("observations") == "" and json.loads(read("datapackage")) == told


def test_pairs_leave_out_near_frames_of_one_entity(spark):
    rows = spark.createDataFrame([(1, 1, "L", 0), (2, 1, "L", 50), (3, 1, "L", 51), (4, 2, "L", 1), (5, 2, "R", 1), (6, None, "L", 1)], "vec_id long, entity_id long, side string, frame int")
    pairs = lambda by_side: {(r["gallery_id"], r["same"]) for r in evaluation.evaluation_pairs(rows.filter("vec_id = 1"), rows, by_side=by_side).collect()}
    assert pairs(True) == {(3, True), (4, False), (6, None)} and pairs(False) == pairs(True) | {(5, False)}
