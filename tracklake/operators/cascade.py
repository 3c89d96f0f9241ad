"""Identification of detections by gates, with enrolment that feeds later matches.

Detections count as processed in the order of det_id.  What one of them enrols belongs to the catalogue of its reserve
and side for all later ones.  That order does not force one task to see them all:

* A row whose best score against the given catalogue reaches ``t_low`` never enrols, since more entries only raise its
  best score.  Of the others a row enrols just if no earlier one that enrols is within ``t_low`` of it.
* So a row that no earlier undecided row is near enrols, whatever the others do, and all rows near it do not.  A round
  settles all such rows of all groups at once; only ids, never pairs, leave the tiles in which rows are compared.  The
  rounds are as many as the longest chain of rows each near the one before, not as the rows that enrol.
* A group with no more than ``SETTLE`` undecided rows is settled by one task, row by row.
* All rows are then matched once, in parallel, against the catalogue and the rows enrolled before them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.config import SETTINGS
from tracklake.functions.vision import infer_side, quality_gate, relabelled, view_quality
from tracklake.operators import tiles
from tracklake.operators.identity import matched
from tracklake.storage import checkpointed

#: Undecided rows of a reserve and side that one task settles.
SETTLE = 2_000

# The status of an image after each outcome.
STATUS = {
    "unknown_species": "UNKNOWN_SPECIES", "non_target_species": "NON_TARGET_SPECIES", "side_unknown": "SIDE_UNKNOWN", "refuse": "LOW_QUALITY",
    "auto": "IDENTIFIED", "review": "IDENTITY_REVIEW", "enroll": "NEW_INDIVIDUAL", "cross_flank_candidate": "IDENTITY_REVIEW",
}
CROSS_FLANK_CONFIDENCE = 0.8


def gate(target: str) -> Column:
    """Outcome of a detection (species, side, posed, embedding) that does not reach matching, else null."""
    species = F.coalesce("species", F.lit("unknown"))
    return (
        F.when(species == "unknown", "unknown_species")
        .when(species != target, "non_target_species")
        .when(~F.coalesce(F.col("side").isin("L", "R"), F.lit(False)), "side_unknown")
        .when(~F.coalesce("posed", F.lit(False)) | F.col("embedding").isNull(), "refuse")
    )


def gated(detections: DataFrame, s=SETTINGS) -> DataFrame:
    """``detections`` with flank (points named after the known side), quality, quality_reason and posed (whether the gate lets a row pass).

    They have side, points (name to x, y, v), crop_width, crop_height, blur, exposure and saturated.  Without one visible
    pair of shoulder and hip, or without a side, there is no flank, and a row is refused.
    """
    flank = F.when(F.col("side") == "L", relabelled(F.col("points"), "L")).when(F.col("side") == "R", relabelled(F.col("points"), "R"))
    rows = detections.withColumn("flank", flank)
    seen = infer_side(F.col("flank"))
    judged = quality_gate(seen, F.col("crop_width"), F.col("crop_height"), view_quality(F.col("flank"), seen), F.col("blur"), F.col("exposure"), F.col("saturated"), s)
    rows = rows.withColumn("_gate", judged)
    reason = F.when(F.col("flank").isNull(), "no complete pair of shoulder and hip").otherwise(F.col("_gate.reason"))
    return rows.withColumns({"quality": F.col("_gate.quality"), "quality_reason": reason, "posed": F.col("flank").isNotNull() & F.col("_gate.ok")}).drop("_gate")


def _group() -> Column:
    """Reserve and side: what a catalogue is made for."""
    return F.concat(F.coalesce("reserve_id", F.lit("")), F.lit("|"), F.coalesce("side", F.lit("")))


def provisional_id(reserve: Column, det_id: Column) -> Column:
    """Name of the individual that a detection enrols."""
    return F.concat(F.coalesce(reserve, F.lit("")), F.lit("-P-"), F.left(F.sha2(det_id.cast("string"), 256), F.lit(8)))


def _settled(t_low: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Rows of one group that enrol when taken one by one."""
        frame = frame.sort_values("det_id", ignore_index=True)
        vectors = np.array(frame["embedding"].tolist(), dtype=float).reshape(len(frame), -1)
        near = vectors @ vectors.T >= t_low
        kept: list[int] = []
        for i in range(len(frame)):
            if not near[i, kept].any():
                kept.append(i)
        return frame.iloc[kept][["det_id", "_group", "reserve_id", "embedding"]]

    return run


def _as_catalogue(enrolled: DataFrame) -> DataFrame:
    name = provisional_id(F.col("reserve_id"), F.col("det_id"))
    return enrolled.select("_group", F.concat(name, F.lit("-"), F.element_at(F.split("_group", r"\|"), -1)).alias("entity_id"), name.alias("ind_id"), "embedding", F.col("det_id").alias("since"))


def _asked(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("det_id").alias("query_id"), "_group", "embedding")


def _known(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("det_id").alias("entity_id"), "_group", "embedding")


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col("query_id").alias("det_id")), "det_id", "left_anti")


def enrolled_rows(passed: DataFrame, catalogue: DataFrame, t_low: float = SETTINGS.t_low) -> DataFrame:
    """det_id, _group, reserve_id, embedding of the rows of ``passed`` that enrol."""
    rows = passed.select("det_id", "_group", "reserve_id", "embedding")
    left = checkpointed(_without(rows, tiles.with_near(_asked(rows), catalogue, "_group", t_low)))
    out = left.limit(0)
    while not left.isEmpty():
        small = left.groupBy("_group").count().filter(F.col("count") <= SETTLE).select("_group")
        settled = left.join(small, "_group", "left_semi").groupBy("_group").applyInPandas(_settled(t_low), left.schema)
        out = out.unionByName(checkpointed(settled))
        large = checkpointed(left.join(small, "_group", "left_anti").select(*rows.columns))
        if large.isEmpty():
            break
        free = checkpointed(_without(large, tiles.with_near(_asked(large), _known(large), "_group", t_low, earlier=True)))
        rest = large.join(free.select("det_id"), "det_id", "left_anti")
        left = checkpointed(_without(rest, tiles.with_near(_asked(rest), _known(free), "_group", t_low)))
        out = out.unionByName(free)
    return checkpointed(out)


def identified(detections: DataFrame, catalogue: DataFrame, target: str = "tiger", t_low: float = SETTINGS.t_low, t_high: float = SETTINGS.t_high, k: int = SETTINGS.top_k, window_s: int = SETTINGS.opposite_flank_seconds, cross_flank: bool = True) -> DataFrame:
    """One row for every detection: det_id, outcome, status, ind_id, score, candidates and neighbour_ind.

    ``detections`` has det_id (unique), run_id, reserve_id, station_id, captured_at, species, side, embedding (of length 1)
    and posed, or else what ``gated`` judges; ``catalogue`` has reserve_id, side, entity_id, ind_id and embedding.  ind_id is that of the match
    (auto) or the new one (enroll, cross_flank_candidate); score the best one before it, null without entries;
    candidates the best entries of a review; neighbour_ind the individual of the nearest earlier assigned detection of
    the other side at the station, where it lies within ``window_s`` (not asked for without ``cross_flank``).  No detections, no rows.
    """
    rows = detections if "posed" in detections.columns else gated(detections)
    judged = rows.withColumn("outcome", gate(target)).withColumn("_group", _group())
    stopped = judged.filter("outcome is not null")
    passed = checkpointed(judged.filter("outcome is null").drop("outcome"))
    entries = catalogue.select(_group().alias("_group"), "entity_id", "ind_id", "embedding")
    new = enrolled_rows(passed, entries, t_low)
    everything = entries.withColumn("since", F.lit(None).cast(new.schema["det_id"].dataType)).unionByName(_as_catalogue(new))
    top = matched(_asked(passed), everything, "_group", k, since="since")
    listed = F.array_sort(F.collect_list(F.struct("rank", "ind_id", "entity_id", "score")))
    best = top.groupBy("query_id").agg(listed.alias("candidates")).withColumn("_score", F.col("candidates")[0]["score"])
    joined = passed.join(best, F.col("det_id") == F.col("query_id"), "left").join(new.select("det_id", F.lit(True).alias("_enrols")), "det_id", "left")
    # Which rows enrol is settled; what scores say at the very limit cannot contradict it.
    decided = joined.withColumn("outcome", F.when(F.col("_enrols"), "enroll").when(F.col("_score") >= t_high, "auto").otherwise("review"))
    own = F.when(F.col("outcome") == "auto", F.col("candidates")[0]["ind_id"]).when(F.col("outcome") == "enroll", provisional_id(F.col("reserve_id"), F.col("det_id")))
    decided = checkpointed(decided.withColumn("ind_id", own))
    beside = earlier_opposite(decided if cross_flank else decided.limit(0), window_s)
    full = decided.join(beside, "det_id", "left").withColumn("outcome", F.when(F.col("neighbour_ind").isNotNull(), "cross_flank_candidate").otherwise(F.col("outcome")))
    kept = F.when(F.col("outcome") == "review", F.to_json(F.transform("candidates", lambda c: c.dropFields("rank"))))
    rows = full.select("det_id", "outcome", "ind_id", F.col("_score").alias("score"), kept.alias("candidates"), "neighbour_ind")
    none = lambda kind: F.lit(None).cast(kind)
    ends = stopped.select("det_id", "outcome", none("string").alias("ind_id"), none("double").alias("score"), none("string").alias("candidates"), none("string").alias("neighbour_ind"))
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return rows.unionByName(ends).withColumn("status", status[F.col("outcome")])


def earlier_opposite(decided: DataFrame, window_s: int) -> DataFrame:
    """det_id, neighbour_ind of enrolled rows: the nearest assigned row of the other side before them, in the run and at the station, within ``window_s``.

    Rows meet by buckets of time, so a station with very many of them is not one task.
    """
    at = F.unix_timestamp(F.col("captured_at").cast("timestamp"))
    base = decided.select("det_id", "run_id", "station_id", "side", "ind_id", "outcome", at.alias("t")).filter("t is not null and station_id is not null")
    width = max(1, window_s)
    seek = base.filter("outcome = 'enroll'").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("t") / width) - 1, F.floor(F.col("t") / width) + 1)))
    known = base.filter("ind_id is not null").select(F.col("det_id").alias("o_det"), F.col("run_id").alias("o_run"), F.col("station_id").alias("o_station"), F.col("side").alias("o_side"), F.col("ind_id").alias("o_ind"), F.col("t").alias("o_t"), F.floor(F.col("t") / width).alias("o_bucket"))
    apart = F.abs(F.col("t") - F.col("o_t"))
    same = (F.col("run_id") == F.col("o_run")) & (F.col("station_id") == F.col("o_station")) & (F.col("bucket") == F.col("o_bucket")) & (F.col("side") != F.col("o_side")) & (F.col("o_det") < F.col("det_id")) & (apart <= window_s)
    return seek.join(known, same).groupBy("det_id").agg(F.min_by("o_ind", F.struct(apart, "o_det")).alias("neighbour_ind"))


def cross_flank_candidates(identified_rows: DataFrame, detections: DataFrame) -> DataFrame:
    """Associations that wait for a person: assoc_id, l_ind_id, r_ind_id, status and confidence, of rows with a neighbour."""
    rows = identified_rows.filter(F.col("outcome") == "cross_flank_candidate").join(detections.select("det_id", "reserve_id", "side"), "det_id")
    left = F.col("side") == "L"
    return rows.select(
        F.concat(F.lit("xflank_"), F.left(F.sha2(F.concat_ws("|", F.col("det_id").cast("string"), "neighbour_ind"), 256), F.lit(12))).alias("assoc_id"),
        "reserve_id",
        F.when(left, F.col("ind_id")).otherwise(F.col("neighbour_ind")).alias("l_ind_id"),
        F.when(left, F.col("neighbour_ind")).otherwise(F.col("ind_id")).alias("r_ind_id"),
        F.lit("UNKNOWN_RELATIONSHIP").alias("status"),
        F.lit(CROSS_FLANK_CONFIDENCE).alias("confidence"),
    )


def completed_sides(confirmed: DataFrame, detections: DataFrame, catalogue: DataFrame, target: str = "tiger", t_low: float = SETTINGS.t_low, t_high: float = SETTINGS.t_high, k: int = SETTINGS.top_k) -> DataFrame:
    """What becomes of crops whose side a person has named: crop_id, det_id, image_id, reserve_id, side, actor, outcome, reason, quality, ind_id, score, candidates, status.

    ``confirmed`` has crop_id, side, actor and confirmed_at (of several for a crop the last counts); ``detections``
    crop_id, image_id, what ``gated`` judges, and what ``identified`` takes; ``catalogue`` is that of now.  Points are
    named after the side, the gate judges them, and those that pass are matched in the order of det_id; what one enrols
    the later ones can match.  Refused crops have no status: their image keeps its own.  A side other than L and R, or an unknown crop, is an error.
    """
    last = confirmed.groupBy("crop_id").agg(F.max(F.struct("confirmed_at", "side", "actor")).alias("c")).select("crop_id", "c.side", "c.actor")
    if not confirmed.filter(~F.coalesce(F.col("side").isin("L", "R"), F.lit(False))).isEmpty():
        raise ValueError("a side is L or R")
    lost = [r["crop_id"] for r in last.join(detections, "crop_id", "left_anti").select("crop_id").limit(20).collect()]
    if lost:
        raise KeyError(f"unknown crops: {lost}")
    rows = checkpointed(gated(detections.drop("side", "actor").join(last, "crop_id")))
    found = identified(rows, catalogue, target, t_low, t_high, k, cross_flank=False)
    refused = F.col("outcome") == "refuse"
    reason = F.when(~refused, F.concat(F.lit("best score "), F.coalesce(F.format_number("score", 4), F.lit("none")))).when(F.col("posed"), "no embedding").otherwise(F.col("quality_reason"))
    done = rows.select("crop_id", "det_id", "image_id", "reserve_id", "side", "actor", "quality", "quality_reason", "posed").join(found, "det_id")
    return done.select(
        "crop_id", "det_id", "image_id", "reserve_id", "side", "actor", "outcome", reason.alias("reason"), "quality", "ind_id", "score", "candidates", F.when(~refused, F.col("status")).alias("status")
    )


def completion_changes(done: DataFrame, queue: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Tables that the rows of ``completed_sides`` change.

    review_queue: all of ``queue`` (queue_id, crop_id, state, priority, reason), its items of these crops closed whatever
    the outcome, and a new open one for each review.  assignments: rows of automatic matches and of enrolments.  images:
    image_id and status to set.  flank_crops: side, quality and source to set of crops that were not refused.  audit_log:
    one row a crop.
    """
    closed = queue.join(done.select("crop_id", F.lit(True).alias("_done")).distinct(), "crop_id", "left")
    closed = closed.withColumn("state", F.when(F.col("_done") & F.col("state").isin("open", "claimed"), "closed").otherwise(F.col("state"))).select(*queue.columns)
    made = lambda prefix: F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", "crop_id", "side", at.cast("string")), 256), F.lit(12)))
    review = done.filter("outcome = 'review'").select(made("rq_").alias("queue_id"), "crop_id", F.lit("open").alias("state"), F.col("score").alias("priority"), "reason")
    assigned = done.filter(F.col("outcome").isin("auto", "enroll"))
    new = F.col("outcome") == "enroll"
    sure = F.when(new, F.lit(1.0)).otherwise(F.col("score"))
    return {
        "review_queue": closed.unionByName(review.select(*[F.col(c) if c in review.columns else F.lit(None).cast(queue.schema[c].dataType).alias(c) for c in queue.columns])),
        "assignments": assigned.select(
            made("as_").alias("assign_id"), "crop_id", "ind_id", sure.alias("score"), F.lit("embed").alias("method"), F.when(new, "enrolled").otherwise("auto").alias("decision"), sure.alias("confidence"), F.lit(None).cast("string").alias("superseded_by"), at.alias("decided_at"), "actor"
        ),
        "images": done.filter("status is not null").groupBy("image_id").agg(F.max_by("status", "det_id").alias("status")),
        "flank_crops": done.filter("outcome <> 'refuse'").select("crop_id", "side", "quality", F.lit(True).alias("rect_ok"), F.lit(1.0).alias("side_confidence"), F.lit("human").alias("side_source")),
        "audit_log": done.select(F.lit("review.side_confirmed").alias("action"), "actor", F.lit("crop").alias("entity_type"), F.col("crop_id").alias("entity_id"), F.to_json(F.struct("side", "outcome", "ind_id", "reason")).alias("after"), at.alias("at")),
    }


def outcome_note(counts: dict[str, int]) -> str:
    """One sentence on the counts by outcome that an operator reads."""
    said = [f"{counts[name]} {text}" for name, text in (("auto", "matched"), ("review", "sent for review"), ("enroll", "enrolled"), ("cross_flank_candidate", "enrolled with a possible other flank"), ("refuse", "of low quality"), ("side_unknown", "of unknown side"), ("unknown_species", "of unknown species"), ("non_target_species", "of other species")) if counts.get(name)]
    return "; ".join(said) + "." if said else "No detections."


def pending_note(pending: int, target: str = "tiger") -> str:
    """One sentence on what is left to identify in a run, for an operator who starts a job that finds nothing new."""
    return f"{pending} animal detections still wait to be looked at for {target}." if pending else "Every animal detection has its crop; nothing is left to do."
