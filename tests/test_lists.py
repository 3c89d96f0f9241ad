from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions import text, vision
from tracklake.operators import changes, lists


def test_side_guard_and_page(spark):
    df = spark.createDataFrame([(i, "L" if i % 2 else "R") for i in range(7)], "id long, side string")
    assert lists.catalogue_of_side(df, "R").count() == 4
    with pytest.raises(ValueError):
        lists.catalogue_of_side(df, "UNKNOWN")
    rows = lists.page_of(df, ["id"], 4, 9999).collect()
    assert [(r["id"], r["total"], r["has_more"]) for r in rows] == [(4, 7, False), (5, 7, False), (6, 7, False)]
    assert lists.page_of(df, ["id"], -3, 0).first()["has_more"] is True


def test_explanations(spark):
    start = datetime(2026, 1, 1)
    runs = spark.createDataFrame([("a", "R", start), ("b", "R", start + timedelta(30)), ("c", "R", start + timedelta(60)), ("d", "R", start + timedelta(90))], "run_id string, reserve_id string, started_at timestamp")
    occ = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1), ("d", 0)], "run_id string, event_count long")
    alerts = spark.createDataFrame([("c", False), ("c", True), ("c", True)], "run_id string, suppressed boolean")
    got = {r["run_id"]: r["explanation"] for r in lists.explained(runs, occ, alerts).collect()}
    assert "first cycle" in got["a"] and "nothing deviated" in got["b"] and "1 alerts raised, 2 held back" in got["c"] and "Nobody" in got["d"]
    again = lists.reserves_of(runs, runs.filter("run_id = 'c'"))
    assert [r["run_id"] for r in again.collect()] == ["a", "b", "c", "d"]
    bundle = lists.map_bundle("c", runs, occ, occ, occ, alerts, runs)
    assert bundle["alerts"].count() == 3 and bundle["occupancy"].count() == 1 and bundle["stations"].count() == 4


def test_points_are_relabelled_or_refused(spark):
    point = "struct<x:double,y:double,v:int>"
    near = {"right_shoulder": (1.0, 2.0, 2), "right_hip": (3.0, 4.0, 1), "left_hip": (9.0, 9.0, 2), "nose": (5.0, 5.0, 0)}
    half = {"right_shoulder": (1.0, 2.0, 2), "left_hip": (9.0, 9.0, 2)}
    df = spark.createDataFrame([(1, near), (2, half)], f"id int, p map<string,{point}>")
    got = {r["id"]: r["q"] for r in df.select("id", vision.relabelled(F.col("p"), "L").alias("q")).collect()}
    assert {k: tuple(v) for k, v in got[1].items()} == {"nose": (5.0, 5.0, 0), "left_shoulder": (1.0, 2.0, 2), "left_hip": (3.0, 4.0, 1)} and got[2] is None
    with pytest.raises(ValueError):
        vision.relabelled(F.col("p"), "X")
    stub = spark.range(1).select(vision.stub_points(F.lit(0.1), F.lit(0.2), F.lit(0.4), F.lit(0.2), F.lit(1000), F.lit(500)).alias("p")).first()["p"]
    assert tuple(round(x, 6) for x in stub["right_shoulder"]) == (200.0, 150.0, 2) and round(stub["right_hip"]["x"], 6) == 400.0


def test_quality_gate(spark):
    limits = SimpleNamespace(min_crop_pixels=100, min_laplacian_variance=50.0, min_mean_exposure=30.0, max_mean_exposure=220.0, max_saturated=0.2, min_quality=0.35)
    rows = [(None, 50, 50, 1.0, None, None, None), ("L", 5, 5, 1.0, 99.0, 99.0, 0.0), ("L", 50, 50, 0.5, 10.0, 99.0, 0.0), ("R", 50, 50, 1.0, 10.0, 10.0, 0.5), ("R", 50, 50, 1.0, None, None, None), ("R", 50, 50, 1.0, 10.0, 99.0, 0.0)]
    df = spark.createDataFrame(rows, "side string, w int, h int, base double, blur double, light double, sat double")
    got = [tuple(r["g"]) for r in df.select(vision.quality_gate(*[F.col(c) for c in df.columns], limits).alias("g")).collect()]
    assert got == [(False, 0.0, "side is not determinable"), (False, 0.0, "crop is too small"), (False, 0.3, "motion blur"), (False, 0.294, "quality is too low"), (True, 1.0, "ok"), (True, 0.6, "ok")]


def test_vectors_come_back_at_length_one(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select("v", vision.packed("v").alias("b"))
    got = df.select("v", "b", vision.unpacked("b").alias("w")).collect()
    assert np.frombuffer(got[0]["b"], "<f4").tolist() == pytest.approx([0.6, 0.8]) and got[0]["w"] == pytest.approx([0.6, 0.8])
    assert got[1]["w"] == [0.0, 0.0] and got[2]["b"] is None and got[2]["w"] is None


def test_tables_merge_and_restore(spark):
    row = "id long, v string, lamport long, origin string, row_hash string"
    here, there = spark.createDataFrame([(1, "a", 1, "x", "h1")], row), spark.createDataFrame([(1, "b", 2, "y", "h2"), (2, "c", 1, "y", "h3")], row)
    out = changes.merged_tables({"t": here, "mine": here}, {"t": there}, {"t": ["id"]}, {"t": ["v"]})
    assert {(r["id"], r["v"]) for r in out["t"].collect()} == {(1, "b"), (2, "c")} and out["mine"].count() == 1
    back = changes.restored_tables({"users": here, "runs": here}, {"users": there, "runs": there})
    assert back["users"].count() == 1 and back["runs"].count() == 2
    stamped = changes.stamped(there, 7, "z", F.col("id") == 2)
    assert {(r["id"], r["lamport"], r["origin"]) for r in stamped.collect()} == {(1, 2, "y"), (2, 8, "z")}


def test_weak_passwords_and_names(spark):
    df = spark.createDataFrame([("u", "short"), ("ranger", "xxRANGERxx12"), ("u2", "..ChangeMe!?"), ("u3", "12345678"), ("q", "long enough 42"), ("", "another one 7")], "u string, p string")
    got = [r["w"] for r in df.select(lists.weak_password(F.col("p"), F.col("u")).alias("w")).collect()]
    assert got == [["too short"], ["holds the user name"], ["too common"], ["too short", "too common"], [], []]
    assert [r["c"] for r in spark.createDataFrame([(" ab-cd 12 ",), ("AB CD12",)], "c string").select(lists.recovery_code(F.col("c")).alias("c")).collect()] == ["ABCD12", "ABCD12"]
    assert lists.by_name(df, "u", ("p",)).columns == ["u"]


def test_file_name_times(spark):
    names = ["IMG_20260102_030405.JPG", "2026-01-02 03:04:05.jpg", "x2026_01_02T03-04-05", "20261302_030405", "short_2026"]
    got = [r["t"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.filename_timestamp(F.col("n")).alias("t")).collect()]
    assert got[:3] == [datetime(2026, 1, 2, 3, 4, 5)] * 3 and got[3:] == [None, None]


def test_annotation_files(spark, tmp_path):
    import json

    from tracklake.sources import files

    told = {"images": [{"id": f"i{n}", "file_name": f"{n}.jpg", "location": 7 + n, "date_captured": None if n else "2024-01-01 00:00:00"} for n in range(5)],
            "annotations": [{"image_id": "i0", "category_id": 30}, {"image_id": "i1", "category_id": 30}, {"image_id": "i1", "category_id": 5}, {"image_id": "i2", "category_id": 4}]}
    (tmp_path / "a.json").write_text(json.dumps(told, indent=1))
    images, marks = files.annotations(spark, str(tmp_path / "a.json"))
    got = {r["image_id"]: (r["station_id"], r["captured_at"], r["is_animal"]) for r in lists.image_truth(images, marks).collect()}
    assert got == {"i0": ("7", "2024-01-01 00:00:00", False), "i1": ("8", "", True), "i2": ("9", "", True), "i3": ("10", "", True), "i4": ("11", "", True)}
    there = spark.createDataFrame([("1.jpg", "/b/1.jpg"), ("1.jpg", "/a/1.jpg"), ("9.jpg", "/a/9.jpg")], "name string, path string")
    assert [(r["id"], r["orig_path"]) for r in files.found_images(images, there).collect()] == [("i1", "/a/1.jpg")]
