import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import cascade, tiles

START = datetime.datetime(2026, 1, 1)
DETECTION = "det_id long, run_id int, reserve_id string, station_id long, captured_at timestamp, species string, side string, posed boolean, embedding array<double>"
CATALOGUE = "reserve_id string, side string, entity_id string, ind_id string, embedding array<double>"


def one_by_one(rows, catalogue, t_low, t_high):
    """The plain loop: every enrolment joins the catalogue before the next row."""
    known = {}
    for reserve, side, _, ind, vector in catalogue:
        known.setdefault((reserve, side), []).append((ind, vector))
    out = {}
    for det, _, reserve, _, _, species, side, posed, vector in sorted(rows):
        if species in (None, "unknown"):
            out[det] = ("unknown_species", None)
        elif species != "tiger":
            out[det] = ("non_target_species", None)
        elif side not in ("L", "R"):
            out[det] = ("side_unknown", None)
        elif not posed or vector is None:
            out[det] = ("refuse", None)
        else:
            own = known.setdefault((reserve, side), [])
            scores = [(float(np.dot(v, vector)), i) for i, (_, v) in enumerate(own)]
            best = max(scores, key=lambda s: (s[0], -s[1]), default=None)
            if best is None or best[0] < t_low:
                own.append((f"new-{det}", vector))
                out[det] = ("enroll", f"new-{det}")
            elif best[0] >= t_high:
                out[det] = ("auto", own[best[1]][0])
            else:
                out[det] = ("review", None)
    return out


@pytest.mark.parametrize("settle", [0, 5, 2000])
def test_like_the_plain_loop(spark, monkeypatch, settle):
    monkeypatch.setattr(cascade, "SETTLE", settle)
    monkeypatch.setattr(tiles, "TILE", 7)
    rng = np.random.default_rng(3)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    centres = rng.normal(size=(9, 6))
    rows = []
    for det in range(90):
        vector = unit(centres[det * 7 % 9] + rng.normal(scale=0.25, size=6))
        species = [None, "deer", "tiger"][min(2, det % 11)]
        rows.append((det, 1, f"R{det % 2}", det, START, species, ["L", "R", "?"][0 if det % 13 else 2] if det % 3 else "R", det % 17 != 5, vector if det % 19 else None))
    catalogue = [("R0", "L", "a-L", "a", unit(centres[0])), ("R0", "R", "a-R", "a", unit(centres[1])), ("R1", "L", "b-L", "b", unit(centres[2]))]
    want = one_by_one(rows, catalogue, 0.55, 0.95)
    got = {r["det_id"]: r for r in cascade.identified(spark.createDataFrame(rows, DETECTION), spark.createDataFrame(catalogue, CATALOGUE)).collect()}
    assert {d: r["outcome"] for d, r in got.items()} == {d: w[0] for d, w in want.items()}
    assert len({w[0] for w in want.values()}) == 7
    name = {w[1]: got[d]["ind_id"] for d, w in want.items() if w[0] == "enroll"} | {"a": "a", "b": "b"}
    assert all(got[d]["ind_id"] == name[w[1]] for d, w in want.items() if w[0] in ("auto", "enroll"))
    assert all(r["status"] == cascade.STATUS[r["outcome"]] for r in got.values())


def test_cross_flank_needs_an_earlier_assigned_neighbour(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [
        (1, 1, "R", 5, at(0), "tiger", "L", True, a),  # enrols; nothing before it
        (2, 1, "R", 5, at(60), "tiger", "R", True, a),  # the other side at the limit
        (3, 1, "R", 6, at(61), "tiger", "R", True, b),  # another station
        (4, 1, "R", 5, at(500), "tiger", "R", True, c),  # too late
        (5, 1, "R", None, None, "tiger", "L", True, c),
    ]
    found = cascade.identified(spark.createDataFrame(rows, DETECTION), spark.createDataFrame([], CATALOGUE))
    got = {r["det_id"]: r for r in found.collect()}
    assert [got[i]["outcome"] for i in range(1, 6)] == ["enroll", "cross_flank_candidate", "enroll", "enroll", "enroll"]
    assert got[2]["neighbour_ind"] == got[1]["ind_id"]
    (link,) = cascade.cross_flank_candidates(found, spark.createDataFrame(rows, DETECTION)).collect()
    assert (link["l_ind_id"], link["r_ind_id"], link["status"]) == (got[1]["ind_id"], got[2]["ind_id"], "UNKNOWN_RELATIONSHIP")
    counts = {r["outcome"]: r["n"] for r in found.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert cascade.outcome_note(counts) == "4 enrolled; 1 enrolled with a possible other flank."


def test_no_detections(spark):
    assert cascade.identified(spark.createDataFrame([], DETECTION), spark.createDataFrame([], CATALOGUE)).isEmpty()


def test_rounds_do_not_grow_with_the_enrolments(spark, monkeypatch):
    """5,000 enrolments of one reserve and side, each with a near copy later on."""
    rng = np.random.default_rng(7)
    own = rng.normal(size=(5_000, 48))
    both = np.concatenate((own, own[rng.permutation(5_000)] + rng.normal(scale=0.05, size=own.shape)))
    vectors = both / np.linalg.norm(both, axis=1, keepdims=True)
    rows = [(i, "R|L", "R", v.tolist()) for i, v in enumerate(vectors)]
    passed = spark.createDataFrame(rows, "det_id long, _group string, reserve_id string, embedding array<double>").repartition(8)
    near = vectors @ vectors.T >= 0.55
    want: list[int] = []
    for i in range(len(vectors)):
        if not near[i, want].any():
            want.append(i)
    rounds = []
    with_near = tiles.with_near
    monkeypatch.setattr(tiles, "with_near", lambda *a, **b: rounds.append(b.get("earlier", False)) or with_near(*a, **b))
    monkeypatch.setattr(cascade, "SETTLE", 500)
    got = cascade.enrolled_rows(passed, passed.limit(0).selectExpr("_group", "'' AS entity_id", "'' AS ind_id", "embedding"), 0.55)
    assert sorted(r["det_id"] for r in got.select("det_id").collect()) == want and len(want) > 4_500
    assert 1 <= sum(rounds) <= 6


def test_a_score_just_below_the_limit(spark):
    """Scores are not rounded before they decide: row 2 enrols, and row 3, which is equal to it, matches it."""
    c = 0.54996
    rows = [(i, 1, "R", 1, START, "tiger", "L", True, v) for i, v in ((1, [1.0, 0.0]), (2, [c, (1 - c * c) ** 0.5]), (3, [c, (1 - c * c) ** 0.5]))]
    got = {r["det_id"]: r for r in cascade.identified(spark.createDataFrame(rows, DETECTION), spark.createDataFrame([], CATALOGUE)).collect()}
    assert [got[i]["outcome"] for i in (1, 2, 3)] == ["enroll", "enroll", "auto"] and got[3]["ind_id"] == got[2]["ind_id"]


GATED = "det_id long, crop_id string, image_id string, run_id int, reserve_id string, station_id long, captured_at timestamp, species string, points map<string,struct<x:double,y:double,v:int>>, crop_width int, crop_height int, blur double, exposure double, saturated double, embedding array<double>"


def detection(det, vector, points="right", **more):
    p = {"x": 1.0, "y": 2.0, "v": 2}
    pair = {f"{points}_shoulder": p, f"{points}_hip": p} if points else {"right_shoulder": p}
    row = dict(det_id=det, crop_id=f"c{det}", image_id=f"i{det}", run_id=1, reserve_id="R", station_id=1, captured_at=START, species="tiger", points=pair, crop_width=200, crop_height=200, blur=90.0, exposure=100.0, saturated=0.0, embedding=vector)
    return tuple((row | more).values())


def test_sides_that_a_person_names_are_completed(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]
    rows = [
        detection(1, a), detection(2, b), detection(3, c), detection(4, c, "left"), detection(5, a, None), detection(6, a, crop_width=10, crop_height=10),
        detection(7, None), detection(8, a, blur=1.0, exposure=5.0, saturated=0.9), detection(9, a),
    ]
    catalogue = spark.createDataFrame([("R", "L", "known-L", "known", a), ("R", "R", "other-R", "other", c)], CATALOGUE)
    at = F.lit(START)
    said = spark.createDataFrame([(f"c{i}", "L", "kim", START) for i in range(1, 9)] + [("c1", "R", "kim", START - datetime.timedelta(1))], "crop_id string, side string, actor string, confirmed_at timestamp")
    done = cascade.completed_sides(said, spark.createDataFrame(rows, GATED), catalogue)
    got = {r["det_id"]: r for r in done.collect()}
    assert {i: r["outcome"] for i, r in got.items()} == {1: "auto", 2: "review", 3: "enroll", 4: "auto", 5: "refuse", 6: "refuse", 7: "refuse", 8: "refuse"}
    assert got[1]["ind_id"] == "known" and got[4]["ind_id"] == got[3]["ind_id"]  # what one enrols the later ones match
    assert [got[i]["reason"] for i in (5, 6, 7, 8)] == ["no complete pair of shoulder and hip", "crop is too small", "no embedding", "quality is too low"]
    assert {i: r["status"] for i, r in got.items()} == {1: "IDENTIFIED", 2: "IDENTITY_REVIEW", 3: "NEW_INDIVIDUAL", 4: "IDENTIFIED", 5: None, 6: None, 7: None, 8: None}
    queue = spark.createDataFrame([(f"q{i}", f"c{i}", "claimed" if i == 5 else "open", 0.1, "side") for i in range(1, 10)] + [("old", "c1", "resolved", 0.1, "x")], "queue_id string, crop_id string, state string, priority double, reason string")
    changed = cascade.completion_changes(done, queue, at)
    states = {r["queue_id"]: r["state"] for r in changed["review_queue"].collect()}
    assert {q: s for q, s in states.items() if not q.startswith("rq_")} == {f"q{i}": "closed" for i in range(1, 9)} | {"q9": "open", "old": "resolved"}
    (again,) = changed["review_queue"].filter("queue_id like 'rq_%'").collect()
    assert (again["crop_id"], again["state"]) == ("c2", "open") and abs(again["priority"] - 0.6) < 1e-9
    assert {(r["crop_id"], r["decision"], r["ind_id"]) for r in changed["assignments"].collect()} == {("c1", "auto", "known"), ("c3", "enrolled", got[3]["ind_id"]), ("c4", "auto", got[3]["ind_id"])}
    assert {r["image_id"]: r["status"] for r in changed["images"].collect()} == {"i1": "IDENTIFIED", "i2": "IDENTITY_REVIEW", "i3": "NEW_INDIVIDUAL", "i4": "IDENTIFIED"}
    assert {r["crop_id"] for r in changed["flank_crops"].collect()} == {"c1", "c2", "c3", "c4"} and changed["audit_log"].count() == 8
    for bad, kind in (([("c1", "?", "kim", START)], ValueError), ([("zz", "L", "kim", START)], KeyError)):
        with pytest.raises(kind):
            cascade.completed_sides(spark.createDataFrame(bad, said.schema), spark.createDataFrame(rows, GATED), catalogue)


def test_the_gate_stands_in_the_cascade(spark):
    rows = spark.createDataFrame([detection(1, [1.0, 0.0]), detection(2, [0.0, 1.0], blur=1.0, exposure=5.0, saturated=0.9), detection(3, [0.0, 1.0], None)], GATED).withColumn("side", F.lit("R"))
    got = {r["det_id"]: r["outcome"] for r in cascade.identified(rows, spark.createDataFrame([], CATALOGUE)).collect()}
    assert got == {1: "enroll", 2: "refuse", 3: "refuse"}
