"""Golden cases of the survey operators."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracklake.functions import geo, vision
from tracklake.functions.text import exif_timestamp, filename_timestamp, json_list, plausible
from tracklake.operators import alerts, changes, effort, evaluation, identity, occupancy, review, sessions, tiles, triage

BASE = datetime(2026, 1, 1)


def day(n):
    return BASE + timedelta(days=n)


# Scenarios: each individual's occupancy by cycle, and the alert that is expected in the last of three cycles of 30 days.
STATIONS = [
    (1, "A1", 21.600, 79.300, "core", 12.0), (2, "A2", 21.601, 79.301, "core", 12.0), (3, "BUF", 21.605, 79.302, "buffer", 1.0), (4, "FAR", 21.636937, 79.300, "core", 10.0), (5, "FAR2", 21.636937, 79.310, "core", 10.0),
    (6, "ABS1", 21.550, 79.250, "core", 14.0), (7, "ABS2", 21.551, 79.251, "core", 14.0), (8, "NEW", 21.610, 79.310, "core", 13.0), (9, "DEAD1", 21.500, 79.200, "core", 14.0), (10, "DEAD2", 21.501, 79.201, "core", 14.0),
    (11, "NEWCAM", 21.620, 79.320, "core", 13.0), (12, "BUFLOW", 21.606, 79.303, "buffer", 0.8),
]
ACTIVE = {s[0]: (0, None) for s in STATIONS} | {9: (0, 64), 10: (0, 64), 11: (60, None)}
A = [1, 2]
OCCUPANCY = {
    1: {0: (A, 6), 1: (A, 6), 2: ([3], 3)}, 2: {1: (A, 6), 2: ([4], 6)}, 3: {0: ([6, 7], 4), 1: ([6, 7], 4)}, 4: {0: (A, 5), 1: (A, 5), 2: ([8], 3)}, 5: {0: ([9, 10], 4), 1: ([9, 10], 4)}, 6: {0: (A, 5), 1: (A, 5), 2: ([11], 2)},
    7: {1: (A, 5), 2: ([5], 2)}, 8: {2: ([12], 2)},
}
EXPECTED = {
    (1, "buffer_ward"): None, (2, "centroid_shift"): None, (3, "absence"): None, (4, "new_station"): None, (5, "absence"): "coverage", (6, "new_station"): "installed this cycle", (7, "centroid_shift"): "minimum", (8, "buffer_ward"): "identity confidence",
}


def test_alert_scenarios(spark):
    stations = spark.createDataFrame(STATIONS, "station_id long, name string, lat double, lon double, zone string, village_dist_km double")
    activity = spark.createDataFrame([(i, i, day(a), None if b is None else day(b)) for i, (a, b) in ACTIVE.items()], "activity_id long, station_id long, start_date timestamp, end_date timestamp")
    runs = spark.createDataFrame([(i, "R", day(30 * i)) for i in range(3)], "run_id int, reserve_id string, started_at timestamp")
    where = {s[0]: s for s in STATIONS}
    rows = []
    for ind, by in OCCUPANCY.items():
        for run, (own, events) in by.items():
            rows.append((run, ind, own, sum(where[s][2] for s in own) / len(own), sum(where[s][3] for s in own) / len(own), events))
    occ = spark.createDataFrame(rows, "run_id int, ind_id long, station_set array<long>, centroid_lat double, centroid_lon double, event_count long")
    conf = spark.createDataFrame([(2, 8, 0.44)], "run_id int, ind_id long, id_conf double")
    periods = sessions.cycle_periods(runs, 90)
    days = effort.station_days(activity, periods)
    earlier = occ.select("run_id", "ind_id", F.explode("station_set").alias("station_id")).filter("run_id < 2").withColumn("run_id", F.explode(F.sequence(F.col("run_id") + 1, F.lit(2)))).distinct()
    cov = effort.coverage(earlier, days, periods)
    h = alerts.history(occ, runs, stations, conf, cov)
    moves = alerts.transits(spark.createDataFrame([], "run_id int, ind_id long, station_id long, event_no long, started_at timestamp, ended_at timestamp"), stations, ["run_id", "ind_id"])
    ratio = spark.createDataFrame([(2, 1.0)], "run_id int, ratio double")
    got = {(r["ind_id"], r["type"]): r for r in alerts.alerts(h, stations, days, runs, moves, ratio).filter("run_id = 2").collect()}
    for key, reason in EXPECTED.items():
        assert key in got, key
        assert got[key]["suppressed"] == (reason is not None), (key, got[key])
        if reason:
            assert reason in got[key]["suppress_reason"]


def test_direction_village_and_collapse_rules(spark):
    stations = spark.createDataFrame([(1, "S1", 0.0, 0.0, "core", 6.0), (2, "S2", 0.0, 0.0, "core", 4.0), (3, "S3", 0.0, 0.0, "core", 1.5)], "station_id long, name string, lat double, lon double, zone string, village_dist_km double")
    runs = spark.createDataFrame([(i, day(30 * i)) for i in range(4)], "run_id int, started_at timestamp")
    none = "run_id int, ind_id long, "
    trend = [(0, 1, [1], 21.60, 79.20, 5), (1, 1, [2], 21.65, 79.25, 5), (2, 1, [3], 21.70, 79.30, 5)]
    collapse = [(i, i2, [1], 1.0, 1.0, n) for i2 in (2, 3) for i, n in enumerate((12, 15, 14, 2))]
    occ = spark.createDataFrame(trend + collapse, none + "station_set array<long>, centroid_lat double, centroid_lon double, event_count long")
    conf = spark.createDataFrame([], none + "id_conf double")
    cov = spark.createDataFrame([(3, 2, 0.9), (3, 3, 0.3)], none + "coverage double")
    h = alerts.history(occ, runs, stations, conf, cov)
    assert [(r["run_id"], r["ind_id"], r["suppressed"]) for r in alerts.directional_trend(h).filter("ind_id = 1 and run_id = 2").collect()] == [(2, 1, False)]
    assert {(r["run_id"], r["ind_id"]) for r in alerts.decreasing_village_distance(h).collect()} == {(2, 1)}
    assert {(r["ind_id"], r["suppressed"]) for r in alerts.activity_collapse(h).collect()} == {(2, False), (3, True)}


def test_timestamp_tiers(spark):
    start = datetime(2026, 4, 1)
    rows = [("f", "IMG_0001.JPG", datetime(2026, 4, 1, 12)), ("f", "2026_04_02_140000.JPG", datetime(1970, 1, 1)), ("f", "IMG_0003.JPG", None), ("f", "IMG_0004.JPG", datetime(2026, 4, 2, 16)), ("g", "x.JPG", datetime(2002, 1, 1)), ("h", "y.JPG", None)]
    df = spark.createDataFrame([(*r, start) for r in rows], "folder string, name string, exif_at timestamp, station_start timestamp")
    got = {r["name"]: r for r in sessions.resolved_timestamps(df, F.lit(datetime(2026, 6, 1))).collect()}
    assert (got["IMG_0001.JPG"]["time_source"], got["IMG_0001.JPG"]["time_confidence"]) == ("exif", 1.0)
    assert got["2026_04_02_140000.JPG"]["time_source"] == "filename" and got["2026_04_02_140000.JPG"]["captured_at"] == datetime(2026, 4, 2, 14)
    assert got["IMG_0003.JPG"]["time_source"] == "inferred" and got["IMG_0003.JPG"]["captured_at"] == datetime(2026, 4, 2, 2)
    assert got["IMG_0004.JPG"]["time_source"] == "exif"
    assert (got["x.JPG"]["time_source"], got["x.JPG"]["captured_at"]) == ("drift_corrected", start)
    assert (got["y.JPG"]["captured_at"], got["y.JPG"]["time_confidence"]) == (start, 0.3)


def test_text_functions(spark):
    names = ["IMG_20240230_101010.JPG", "x-2024-02-29T23-59-58.png", "none", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(filename_timestamp(F.col("n"))).collect()] == [None, datetime(2024, 2, 29, 23, 59, 58), None, None]
    one = spark.range(1)
    assert one.select(exif_timestamp(F.lit("2024:02:01 10:11:12"))).first()[0] == datetime(2024, 2, 1, 10, 11, 12)
    assert one.select(exif_timestamp(F.lit("bad"))).first()[0] is None
    assert one.select(json_list(F.lit("{oops")), json_list(F.lit('["a"]'))).first()[:] == ([], ["a"])
    assert not one.select(plausible(F.lit(datetime(1999, 1, 1)), F.lit(day(0)))).first()[0]


def test_bursts_at_the_gap(spark):
    rows = [(1, "a", day(0)), (1, "b", day(0) + timedelta(seconds=10)), (1, "c", day(0) + timedelta(seconds=20.5)), (2, "d", None)]
    got = sessions.burst_events(spark.createDataFrame(rows, "station_id long, image_id string, captured_at timestamp"), 10).collect()
    assert sorted((r["station_id"], r["images"]) for r in got) == [(1, ["a", "b"]), (1, ["c"])]


def test_geometry(spark):
    one = spark.range(1)
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1000, 0), (1000, 1000), (0, 1000))])
    assert one.select(geo.shoelace(square)).first()[0] == 1_000_000
    east, north = one.select(*geo.utm(F.lit(0.0), F.lit(3.0), 32631)).first()
    assert abs(east - 500_000) < 1e-3 and abs(north) < 1e-3
    e1, n1, e2, n2 = one.select(*geo.utm(F.lit(21.65), F.lit(79.3), 32644), *geo.utm(F.lit(21.668), F.lit(79.319), 32644)).first()
    plain = one.select(geo.distance_km(F.lit(21.65), F.lit(79.3), F.lit(21.668), F.lit(79.319))).first()[0]
    assert abs(math.hypot(e1 - e2, n1 - n2) / 1000 - plain) < 0.01 * plain
    points = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon")) for a, o in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.5, 0.5), (0.5, 0.0), (0.0, 0.0))])
    hull = one.select(geo.convex_hull(points).alias("h")).first()["h"]
    assert {(p["lat"], p["lon"]) for p in hull} == {(0, 0), (0, 1), (1, 1), (1, 0)} and len(hull) == 4


def test_occupancy_reasons(spark):
    stations = spark.createDataFrame([(i, 21.5 + 0.01 * (i % 3), 79.2 + 0.01 * (i // 3)) for i in range(9)] + [(20, 21.5, 79.5), (21, 21.75, 79.75), (22, 22.0, 80.0)], "station_id long, lat double, lon double")
    inputs = spark.createDataFrame([(0, 1, s, 2) for s in range(9)] + [(0, 2, 0, 1), (0, 2, 1, 1)] + [(0, 4, s, 1) for s in (20, 21, 22)], "run_id int, ind_id long, station_id long, event_count long")
    days = spark.createDataFrame([(0, 0, 7.5), (1, 0, 2.5)], "station_id long, run_id int, days double")
    got = {r["ind_id"]: r for r in occupancy.occupancy(inputs, stations, days, spark.createDataFrame([(0, 3)], "run_id int, ind_id long"), 32644).collect()}
    assert got[1]["hull_wkt"].startswith("POLYGON((") and 4 < got[1]["area_km2"] < 5 and got[1]["event_count"] == 18 and got[1]["effort_days"] == 10.0
    assert "only 2 stations" == got[2]["insufficient_reason"] and got[3]["insufficient_reason"] == "no captures this cycle" and got[3]["event_count"] == 0
    assert got[4]["insufficient_reason"] == "stations lie in a line"


def test_decisions_sides_and_quality(spark):
    df = spark.createDataFrame([(None,), (0.5,), (0.55,), (0.949,), (0.95,)], "s double")
    assert [r[0] for r in df.select(vision.decide(F.col("s"))).collect()] == ["enroll", "enroll", "review", "review", "auto"]
    p = lambda **kw: {k: (0.0, 0.0, v) for k, v in kw.items()}
    rows = [(p(left_shoulder=2, left_hip=1),), (p(right_shoulder=2, right_hip=2, left_shoulder=1, left_hip=1),), (p(right_shoulder=2, right_hip=2),), (p(left_shoulder=2),)]
    pts = spark.createDataFrame(rows, "p map<string,struct<x:double,y:double,v:int>>").withColumn("side", vision.infer_side(F.col("p")))
    assert [r["side"] for r in pts.collect()] == ["L", None, "R", None]
    assert [r[0] for r in pts.select(vision.view_quality(F.col("p"), F.col("side"))).collect()][:3] == [0.75, 0.0, 1.0]


def test_matching_by_blocks_equals_broadcast(spark, monkeypatch):
    rng = random.Random(1)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    entries = spark.createDataFrame([(i, i % 5, vector(), "LR"[i % 2]) for i in range(60)], "entity_id long, ind_id long, embedding array<float>, side string")
    queries = spark.createDataFrame([(i, vector(), "LR"[i % 2]) for i in range(6)], "query_id long, embedding array<float>, side string")
    wide = sorted(tuple(r) for r in identity.match_scores(queries, entries, "side").collect())
    monkeypatch.setattr(tiles, "MAX_BROADCAST_BYTES", 3)
    assert sorted(tuple(r) for r in identity.match_scores(queries, entries, "side").collect()) == wide and len(wide) == 180


def test_fuzzy_stations_equal_brute_force(spark):
    rng = random.Random(2)
    stations = [(i, "".join(rng.choices("abc1", k=rng.randint(0, 8)))) for i in range(40)]
    names = ["".join(rng.choices("abc1", k=rng.randint(0, 8))) for _ in range(60)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for n in filter(None, names):
        d, s = min((edits(n.upper(), hint.upper()), i) for i, m in stations for hint in (str(i), m) if hint)
        if d <= 2:
            want[n] = (s, d)
    got = identity.fuzzy_station(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(stations, "station_id long, station_name string")).collect()
    assert {r["name"]: (r["station_id"], r["distance"]) for r in got} == want


def test_stations_called_by_three_hints(spark):
    stations = [(9, "PNC-009", "North Pond", "stn_north", "R", 2), (3, "ZZ", "North Pont", None, "R", 1), (4, "", "", "", "R", 0), (5, "PNC-009", "x", "x", "Q", 0)]
    df = spark.createDataFrame(stations, "station_id long, name string, station_name string, folder_hint string, reserve_id string, place int")
    ask = lambda *n: spark.createDataFrame([("R", x) for x in n], "reserve_id string, name string")
    got = {r["name"]: (r["station_id"], r["distance"]) for r in identity.fuzzy_station(ask("pnc009", "STN NORT", "northpond", "North Pon", "nothing like it", "", "--", "9"), df, group="reserve_id", place="place").collect()}
    # The hint, the exact name although another station comes first, the first by place on a tie, the id itself.
    assert got == {"pnc009": (9, 0), "STN NORT": (9, 1), "northpond": (9, 0), "North Pon": (3, 1), "9": (9, 0)}
    folders = ask("PNC_0009", "North Pond", "nowhere").withColumnRenamed("name", "folder")
    none = F.lit(None).cast("string")
    file = {"folder": F.col("folder"), "file_name": none, "serial": none, "body": none, "time": none}
    station = {"folder_hint": F.col("folder_hint"), "name": F.col("station_name"), "serial": none, "body": none, "active_from": none, "active_to": none}
    found = {r["folder"]: (r["station_id"], r["score"], r["signal"]) for r in review.best_station_match(folders, df, identity.station_score(file, station), 0.36).collect()}
    assert found == {"PNC_0009": (9, 0.65, "folder_fuzzy"), "North Pond": (3, 0.36, "signals")}


def test_routes_and_what_they_change(spark):
    rows = [(1, 10, "animal", 0.9), (1, 11, "person", 0.3), (1, 12, "person", 0.4), (2, 20, "vehicle", 0.5), (2, 21, "animal", 0.99), (3, 30, "animal", 0.7), (3, 31, "animal", 0.7), (4, 40, "odd", 0.9)]
    boxes = spark.createDataFrame([(*r, 0.1, 0.2, 0.3, r[1] / 100) for r in rows], "image_id long, det_id long, label string, conf double, x double, y double, w double, h double").repartition(4)
    images = spark.createDataFrame([(i, "r1", f"p{i}", 5 * i) for i in range(1, 7)], "image_id long, run_id string, orig_path string, bytes long")
    got = {r["image_id"]: (r["route"], r["conf"], r["best"]["det_id"] if r["best"] else None) for r in triage.routed(boxes, images).collect()}
    assert got == {1: ("person", 0.4, 12), 2: ("vehicle", 0.5, 20), 3: ("animal", 0.7, 30), 4: ("blank", None, None), 5: ("blank", None, None), 6: ("blank", None, None)}
    held = spark.createDataFrame([(5, None), (6, day(0))], "image_id long, restored_at timestamp")
    changed = triage.route_changes(triage.routed(boxes, images), images, held, "m@1", 0.2, F.lit(day(1)))
    assert {r["image_id"]: r["status"] for r in changed["images"].collect()} == {1: "person", 2: "vehicle", 3: "subject", 4: "blank", 5: "blank", 6: "blank"}
    assert sorted((r["image_id"], r["bytes"], r["restored_at"]) for r in changed["quarantine"].collect()) == [(4, 20, None), (6, 30, None)]
    assert [(r["image_id"], r["det_id"], r["conf"]) for r in changed["persons_restricted"].collect()] == [(1, 12, 0.4)]
    again = triage.route_changes(triage.routed(boxes, images), images, held.unionByName(changed["quarantine"].select("image_id", "restored_at")), "m@1", 0.2, F.lit(day(1)))
    assert again["quarantine"].isEmpty()


def test_station_score(spark):
    lit = lambda v: F.lit(v)
    file = {"folder": lit("PNC001"), "file_name": lit("IMG_1.JPG"), "serial": lit("CB88902"), "body": lit("Cam X"), "time": lit("2026-02-01")}
    station = {"folder_hint": lit("PNC001"), "name": lit("PN-C-001"), "serial": lit("CB88902"), "body": lit("CAM X 2"), "active_from": lit("2026-01-01"), "active_to": F.lit(None).cast("string")}
    assert spark.range(1).select(identity.station_score(file, station)).first()[0] >= 0.85


def test_blank_scores_and_order_independence(spark):
    rows = [(f"i{i}", "s", False, day(0) + timedelta(minutes=5 * i), [100] * 15 + ([112] if i in (3, 6) else [100])) for i in range(10)] + [("x", "t", False, day(0), [1] * 16)]
    schema = "image_id string, station_id string, is_night boolean, captured_at timestamp, grid array<int>"
    first = {r["image_id"]: (r["blank"], r["score"]) for r in triage.blank_frames(spark.createDataFrame(rows, schema)).collect()}
    assert first["x"] == (False, None) and [i for i in range(10) if not first[f"i{i}"][0]] == [3, 6]
    random.Random(0).shuffle(rows)
    assert {r["image_id"]: (r["blank"], r["score"]) for r in triage.blank_frames(spark.createDataFrame(rows, schema)).collect()} == first


def test_nms(spark):
    boxes = [(1, 1, 0.9, 0.0, 0.0, 0.5, 0.5), (1, 2, 0.8, 0.01, 0.01, 0.5, 0.5), (1, 3, 0.7, 0.6, 0.6, 0.3, 0.3)]
    df = spark.createDataFrame(boxes, "image_id long, det_id long, conf double, x double, y double, w double, h double")
    assert sorted(r["det_id"] for r in triage.kept_boxes(df).collect()) == [1, 3]


def test_merge_is_idempotent_and_the_later_clock_wins(spark):
    schema = "id long, v string, lamport long, origin string, row_hash string"
    local = spark.createDataFrame([(1, "old", 1, "a", "h1"), (2, "mine", 9, "a", "h2"), (3, "same", 1, "a", "h3")], schema)
    remote = spark.createDataFrame([(1, "new", 2, "b", "x1"), (2, "theirs", 3, "b", "x2"), (3, "same", 8, "b", "h3"), (4, "added", None, None, "x4")], schema)
    merged = changes.merged_by_clock(local, remote, ["id"], ["v"])
    got = {r["id"]: (r["v"], r["outcome"]) for r in merged.collect()}
    assert got == {1: ("new", "conflict_resolved"), 2: ("mine", "conflict_resolved"), 3: ("same", "unchanged"), 4: ("added", "inserted")}
    again = changes.merged_by_clock(merged.drop("outcome"), remote, ["id"], ["v"])
    assert {r["id"]: r["v"] for r in again.collect()} == {k: v[0] for k, v in got.items()}
    with pytest.raises(ValueError):
        changes.inserted_strictly(local, remote, ["id"])


def test_restore_is_idempotent(spark):
    images = spark.createDataFrame([(1, "quarantined"), (2, "blank"), (3, "animal")], "image_id long, status string")
    quarantine = spark.createDataFrame([(1, None), (2, day(1))], "image_id long, restored_at timestamp")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")
    once = changes.restored(images, quarantine, ids, F.lit(day(5)))
    twice = changes.restored(*once, ids, F.lit(day(6)))
    assert sorted(tuple(r) for r in once[0].collect()) == [(1, "pending"), (2, "blank"), (3, "animal")] == sorted(tuple(r) for r in twice[0].collect())
    assert {r["image_id"]: r["restored_at"] for r in twice[1].collect()} == {1: day(5), 2: day(1)}


def test_stage_machine_claims_sessions_progress(spark):
    assert changes.next_stage("preflight", "confirmed") == "confirmed"
    with pytest.raises(ValueError):
        changes.next_stage("preflight", "complete")
    assert changes.next_stage("complete", "identified") == "identified" and changes.next_stage("failed", "triaged") == "triaged"
    now = F.lit(day(1))
    queue = spark.createDataFrame([(1, "claimed", "x", day(0)), (2, "claimed", "x", day(1))], "id long, state string, claimed_by string, claimed_at timestamp")
    assert [r["state"] for r in changes.released(queue, now).orderBy("id").collect()] == ["open", "claimed"]
    users = spark.createDataFrame([("u", "ranger", False), ("v", "x", True)], "username string, role string, disabled boolean")
    held = spark.createDataFrame([("t1", "u", None, day(2), day(1)), ("t2", "v", None, day(2), day(1)), ("t3", "u", None, day(2), day(0))], "token string, username string, revoked_at timestamp, expires_at timestamp, last_seen_at timestamp")
    assert [r["token"] for r in changes.session_valid(held, users, now).collect()] == ["t1"]
    jobs = spark.createDataFrame([("running", 50, 200, day(0), day(0) + timedelta(seconds=100))], "state string, done long, total long, started_at timestamp, checkpoint_at timestamp")
    row = changes.progress(jobs, now).first()
    assert (row["share"], row["stale"], row["eta_s"]) == (0.25, True, 300)
    assert spark.range(1).select(changes.merged_json(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}'))).first()[0] == '{"a":"1","b":"3"}'
    merged = changes.merged_individuals(spark.createDataFrame([(1, 5, None), (2, 5, 1)], "assign_id long, ind_id long, superseded_by long"), spark.createDataFrame([(5, 6)], "source long, target long"))
    assert sorted(tuple(r)[:2] for r in merged.collect()) == [(1, 6), (2, 5)]


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([("g", i % 2) for i in range(400)], "g string, v int")
    row = evaluation.bootstrap_interval(df, "g", "v").first()
    assert row["low"] < 0.5 < row["high"] and row["high"] - row["low"] < 0.12


def test_reserves_do_not_mix(spark):
    runs = spark.createDataFrame([("a0", "A", day(0)), ("a1", "A", day(30)), ("b0", "B", day(5)), ("b1", "B", day(35)), ("b2", "B", day(65))], "run_id string, reserve_id string, started_at timestamp")
    activity = spark.createDataFrame([(1, 1, day(0), day(60)), (2, 2, day(5), day(200))], "activity_id long, station_id long, start_date timestamp, end_date timestamp")
    periods = sessions.cycle_periods(runs, 90)
    days = effort.station_days(activity, periods)
    cov = effort.coverage(spark.createDataFrame([("a1", 7, 1)], "run_id string, ind_id long, station_id long"), days, periods)
    assert [tuple(r) for r in cov.collect()] == [("a1", 7, 1.0)]
    kept = effort.station_days(activity.withColumn("reserve_id", F.when(F.col("station_id") == 1, "A").otherwise("B")), periods)
    assert {(r["station_id"], r["run_id"][0]) for r in kept.collect()} == {(1, "a"), (2, "b")}
    stations = spark.createDataFrame([(1, "S", 0.0, 0.0, "core", 9.0)], "station_id long, name string, lat double, lon double, zone string, village_dist_km double")
    occ = spark.createDataFrame([("a0", 7, [1], 1.0, 1.0, 4), ("a1", 7, [1], 1.0, 1.0, 4), ("a0", 8, [1], 1.0, 1.0, 4)], "run_id string, ind_id long, station_set array<long>, centroid_lat double, centroid_lon double, event_count long")
    none = "run_id string, ind_id long, "
    h = alerts.history(occ, runs, stations, spark.createDataFrame([], none + "id_conf double"), cov)
    assert {(r["run_id"], r["ind_id"]) for r in h.filter("n_earlier > 0").collect()} == {("a1", 7), ("a1", 8)}
    alive = spark.createDataFrame([(7,)], "ind_id long")
    assert {r["ind_id"] for r in alerts.history(occ, runs, stations, spark.createDataFrame([], none + "id_conf double"), cov, alive).collect()} == {7}


def test_cascade_takes_equal_children_over_two_links(spark):
    a = spark.createDataFrame([(1,), (2,)], "a long")
    b = spark.createDataFrame([(1, 1), (2, 2)], "b long, a long")
    c = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "a long, b long")
    out = changes.cascaded({"a": a, "b": b, "c": c}, [("b", "a", "a", "a"), ("c", "a", "a", "a"), ("c", "b", "b", "b")], {"a": a.filter("a = 1")})
    assert [tuple(r) for r in out["c"].collect()] == [(2, 2)] and out["b"].count() == 1 and out["a"].count() == 1


def test_merges_follow_chains_and_refuse_bad_ones(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", 9)], "assign_id long, ind_id string, superseded_by long")
    pairs = lambda *p: spark.createDataFrame(list(p), "source string, target string")
    merged = changes.merged_individuals(rows, pairs(("a", "b"), ("b", "c")))
    assert sorted((r["assign_id"], r["ind_id"]) for r in merged.collect()) == [(1, "c"), (2, "c"), (3, "a")]
    people = spark.createDataFrame([("a", "R", "old", False), ("b", "R", None, False), ("c", "S", None, True)], "ind_id string, reserve_id string, notes string, provisional boolean")
    for bad in (pairs(("a", "a")), pairs(("a", "b"), ("b", "a")), pairs(("a", "b"), ("a", "c"))):
        with pytest.raises(ValueError):
            changes.merged_individuals(rows, bad)
    for bad in (pairs(("a", "c")), pairs(("a", "x"))):
        with pytest.raises(ValueError):
            changes.merged_individuals(rows, bad, people)
    got = {r["ind_id"]: r for r in changes.retired(people, pairs(("a", "b")), F.lit("T")).collect()}
    assert got["a"]["notes"] == "old | merged into b on T" and got["a"]["provisional"] and not got["b"]["provisional"]
    clocked = people.withColumns({"lamport": F.lit(1).cast("long"), "synced_at": F.lit("x"), "row_hash": F.lit("h")})
    now = {r["ind_id"]: r for r in changes.promoted(clocked, spark.createDataFrame([("c",), ("a",)], "ind_id string"), 5, ["ind_id", "provisional"]).collect()}
    assert (now["c"]["provisional"], now["c"]["lamport"], now["c"]["synced_at"]) == (False, 5, None) and now["c"]["row_hash"] != "h" and now["a"]["lamport"] == 1
    assert changes.next_clock({"x": clocked}) == 2 and changes.next_clock({}) == 1
    assert {r["synced_at"] for r in changes.marked_synced(clocked.withColumn("synced_at", F.lit(None).cast("string")), 1, F.lit("now")).collect()} == {"now"}


def test_replaced_takes_one_of_equal_new_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y")], "id long, v string")
    assert sorted(tuple(r) for r in changes.replaced(old, new, ["id"]).collect()) == [(1, "a"), (2, "y")]
