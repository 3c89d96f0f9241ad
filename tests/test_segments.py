"""Scans over blocks of groups equal plain loops, however few blocks a group's rows lie in."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracklake.operators import catalogue, segments, sessions, triage

START = datetime.datetime(2026, 1, 1)


def at(seconds):
    return None if seconds is None else START + datetime.timedelta(seconds=seconds)


@pytest.fixture(params=[61, None])
def blocks(request, monkeypatch):
    monkeypatch.setattr(segments, "BLOCKS", request.param)
    return request.param


def frames_of(rng, stations):
    rows = []
    for station, n in stations:
        t = 0
        for i in range(n):
            t += rng.choice([0, 0, 3, 9, 10, 11, 40])
            rows.append((station, f"i{i:04d}", None if rng.random() < 0.1 else t))
    return rows


def test_bursts(spark, blocks):
    rows = frames_of(random.Random(1), [("a", 350), ("b", 3), ("c", 40), (None, 30), ("d", 1)])
    df = spark.createDataFrame([(s, i, at(t), 1) for s, i, t in rows], "station_id string, image_id string, captured_at timestamp, other int")
    want, last = {}, {}
    for s, i, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] or "", r[2], r[1])):
        no, before = last.get(s, (0, None))
        no += before is None or t - before > 10
        last[s] = (no, t)
        want[s, i] = no
    found = sessions.burst_sessions(df.repartition(5), 10)
    assert found.columns == [*df.columns, "event_no"]
    assert {(r["station_id"], r["image_id"]): r["event_no"] for r in found.collect()} == want
    assert found.count() == len(want)


def test_one_station_in_fifty_blocks(spark, monkeypatch):
    monkeypatch.setattr(segments, "BLOCKS", 50)
    rows = [("a", f"i{i:04d}", START if i < 400 else at(i)) for i in range(1000)]  # a clock that stood still
    df = spark.createDataFrame(rows, "station_id string, image_id string, captured_at timestamp")
    cut = segments.in_blocks(df, "station_id", ["captured_at", "image_id"])
    sizes = [r["count"] for r in cut.groupBy("_block").count().collect()]
    assert len(sizes) >= 40 and max(sizes) < 100
    counts = {r["event_no"]: r["count"] for r in sessions.burst_sessions(df, 10).groupBy("event_no").count().collect()}
    assert counts == {1: 400, 2: 600}
    plan = sessions.burst_sessions(df, 10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    # Rows are scanned by station and block; the ends of blocks alone by station.
    assert windows and all("_block" in x for x in windows)


def filled_by_hand(rows, anchor):
    """name: (seconds, source) of a group's rows (name, seconds) in order of names."""
    rows = sorted(rows)
    known = [i for i, (_, t) in enumerate(rows) if t is not None]
    out = {}
    for i, (name, t) in enumerate(rows):
        before, after = max((k for k in known if k < i), default=None), min((k for k in known if k > i), default=None)
        if t is not None:
            out[name] = (t, "known")
        elif before is not None and after is not None:
            a, b = rows[before][1], rows[after][1]
            out[name] = (a + (b - a) * (i - before) / (after - before), "interpolated")
        elif before is not None:
            out[name] = (rows[before][1], "propagated")
        elif after is not None:
            out[name] = (rows[after][1], "propagated" if i == 0 else "interpolated")
        else:
            out[name] = (anchor, "anchored" if i == 0 else "propagated")
    return out


def test_filled_times(spark, blocks):
    rng = random.Random(2)
    groups = {"a": 200, "b": 2, "c": 30, "none": 25}
    rows = [(g, f"n{i:04d}", None if g == "none" or rng.random() < 0.7 else 60 * rng.randrange(1000)) for g, n in groups.items() for i in range(n)]
    df = spark.createDataFrame([(g, n, at(t)) for g, n, t in rows], "folder string, name string, t timestamp").repartition(4)
    got = {(r["folder"], r["name"]): ((r["filled_at"] - START).total_seconds(), r["fill_source"]) for r in sessions.filled_timestamps(df, "folder", "name", "t", F.lit(at(5))).collect()}
    for g in groups:
        want = filled_by_hand([(n, t) for x, n, t in rows if x == g], 5)
        for name, (t, source) in want.items():
            assert got[g, name][1] == source and abs(got[g, name][0] - t) < 1e-5


def test_even_samples_and_backgrounds(spark, blocks):
    rows = [(g, i) for g, n in (("a", 150), ("b", 5), (None, 61), ("c", 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(3)
    got = sorted((r["g"] or "", r["i"]) for r in catalogue.evenly_spaced(df, "g", "i", 60).collect())
    want = sorted((g or "", i) for g, n in (("a", 150), ("b", 5), (None, 61), ("c", 60)) for i in (range(n) if n <= 60 else sorted({j * (n - 1) // 59 for j in range(60)})))
    assert got == want
    frames = spark.createDataFrame([(1, False, at(i), i, [i % 7, 10]) for i in range(130)] + [(2, False, at(1), 900, [1, 2])], "station_id long, is_night boolean, captured_at timestamp, image_id long, grid array<int>")
    (r,) = triage.backgrounds(frames).collect()
    some = sorted(j * 129 // 59 % 7 for j in range(60))
    assert (r["station_id"], list(r["background"])) == (1, [(some[29] + some[30]) / 2, 10.0])


def test_nothing(spark):
    df = spark.createDataFrame([], "station_id string, image_id string, captured_at timestamp")
    assert sessions.burst_sessions(df, 10).count() == 0
    assert sessions.filled_timestamps(df, "station_id", "image_id", "captured_at").count() == 0
    assert catalogue.evenly_spaced(df, "station_id", "image_id", 5).count() == 0
