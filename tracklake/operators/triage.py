"""Blank frames by a background of medians, and routing of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.config import SETTINGS
from tracklake.functions.vision import blank_confidence, cell_score
from tracklake.operators.catalogue import evenly_spaced


def backgrounds(frames: DataFrame) -> DataFrame:
    """station_id, is_night, background: the median of every grid cell over the group's frames, at most 60 evenly spaced ones; none for fewer than three."""
    at = frames.withColumn("_group", F.struct("station_id", "is_night")).withColumn("_at", F.struct("captured_at", "image_id"))
    some = evenly_spaced(at, "_group", "_at", SETTINGS.max_background_frames)
    cells = some.select("station_id", "is_night", F.posexplode("grid").alias("cell", "value")).groupBy("station_id", "is_night", "cell").agg(F.median("value").alias("m"), F.count("*").alias("n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("cell", "m"))), lambda c: c["m"])
    return cells.groupBy("station_id", "is_night").agg(in_order.alias("background"), F.max("n").alias("n")).filter(F.col("n") >= SETTINGS.min_background_frames).drop("n")


def blank_frames(frames: DataFrame) -> DataFrame:
    """image_id, score, blank, blank_confidence; frames without a background are never blank and have no score."""
    scored = frames.join(backgrounds(frames), ["station_id", "is_night"], "left").withColumn("score", F.round(cell_score(F.col("grid"), F.col("background")), 6))
    blank = F.coalesce(F.col("score") <= SETTINGS.blank_threshold, F.lit(False))
    return scored.select("image_id", "score", blank.alias("blank"), F.when(blank, F.round(blank_confidence(F.col("score")), 6)).alias("blank_confidence"))


def routed(detections: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """image_id, route, conf and best (the best detection's det_id and box): person before vehicle before animal before blank.

    The best is the most confident detection of the route's label, of equal ones that of the smallest det_id; blank
    images have none.  With ``images`` those without any detection are blank too; without, only images with detections have a row.
    """
    rank = F.when(F.col("label") == "person", 3).when(F.col("label") == "vehicle", 2).when(F.col("label") == "animal", 1).otherwise(0)
    box = F.when(rank > 0, F.struct("det_id", "x", "y", "w", "h"))
    each = detections.groupBy("image_id").agg(F.max(F.struct(rank.alias("rank"), F.when(rank > 0, F.col("conf")).alias("conf"), (-F.col("det_id")).alias("first"), box.alias("best"))).alias("b"))
    if images is not None:
        each = images.select("image_id").distinct().join(each, "image_id", "left")
    route = F.element_at(F.array(*[F.lit(x) for x in ("blank", "animal", "vehicle", "person")]), F.coalesce(F.col("b.rank"), F.lit(0)) + 1)
    return each.select("image_id", route.alias("route"), "b.conf", "b.best")


#: An image's status by its route.
ROUTE_STATUS = {"person": "person", "vehicle": "vehicle", "animal": "subject", "blank": "blank"}


def route_changes(routes: DataFrame, images: DataFrame, quarantine: DataFrame, model: str, threshold: float, at: Column) -> dict[str, DataFrame]:
    """What routing changes: images (image_id, status, triage_stage to set), quarantine (rows to add) and persons_restricted (rows to add).

    Blank images (with run_id, orig_path and bytes in ``images``) are put into quarantine, once: those that lie there
    unrestored are not added again, so that a repeated call changes nothing.
    """
    status = F.create_map(*[F.lit(x) for pair in ROUTE_STATUS.items() for x in pair])
    held = quarantine.filter("restored_at is null").select("image_id")
    blank = routes.filter("route = 'blank'").join(images.select("image_id", "run_id", "orig_path", "bytes"), "image_id").join(held, "image_id", "left_anti")
    number = F.concat(F.lit("q_"), F.left(F.sha2(F.concat_ws("|", "run_id", F.col("image_id").cast("string")), 256), F.lit(12)))
    return {
        "images": routes.select("image_id", status[F.col("route")].alias("status"), F.lit("B").alias("triage_stage")),
        "quarantine": blank.select(
            number.alias("q_id"), "image_id", "run_id", F.col("orig_path"), F.lit("no animal, person or vehicle detected").alias("reason"), F.lit(1.0).alias("conf"), F.lit(threshold).alias("threshold"), F.lit(model).alias("model_version"), "bytes", at.alias("moved_at"), F.lit(None).cast("timestamp").alias("restored_at")
        ),
        "persons_restricted": routes.filter("route = 'person'").select("image_id", F.col("conf"), F.col("best.det_id").alias("det_id"), F.lit(0).alias("access_count")),
    }


def kept_boxes(detections: DataFrame, most_overlap: float = 0.45) -> DataFrame:
    """Boxes of each image that overlap no better kept one: the boxes of one image, in the order of confidence, are folded."""
    from tracklake.functions.geo import iou

    box = F.struct((-F.col("conf")).alias("order"), "det_id", "x", "y", "w", "h")
    ordered = detections.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    none = F.slice("boxes", 1, 0)
    kept = F.aggregate("boxes", none, lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > most_overlap), acc).otherwise(F.concat(acc, F.array(b))))
    return ordered.select("image_id", F.explode(kept).alias("b")).select("image_id", "b.det_id")
