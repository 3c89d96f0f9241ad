"""Everyday changes of survey records: ingest, individuals, crops, stations, jobs, associations, accounts.

Each takes tables and gives new ones; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions.text import row_hash
from tracklake.operators.changes import inserted_only, inserted_strictly, merged_individuals, upserted
from tracklake.operators.sessions import burst_events
from tracklake.storage import checkpointed

UNREADABLE = ("corrupt", "unreadable")


# Ingest ------------------------------------------------------------------------------------------------------------


def confirmed_images(images: DataFrame, assignments: DataFrame, stations: DataFrame, skipped: list[str] = []) -> DataFrame:  # noqa: B006
    """``images`` with stations: their own, else that of their folder (assignments: folder, station_id) if it exists.

    Folders in ``skipped`` stay without one.  Any other folder without a station is an error that names it.
    """
    known = assignments.join(stations.select("station_id"), "station_id", "left_semi").select("folder", F.col("station_id").alias("_given"))
    out = images.join(known.dropDuplicates(["folder"]), "folder", "left").withColumn("station_id", F.coalesce("station_id", F.when(~F.col("folder").isin(*skipped) if skipped else F.lit(True), F.col("_given"))))
    missing = out.filter(F.col("station_id").isNull())
    if skipped:
        missing = missing.filter(~F.col("folder").isin(*skipped))
    names = [r["folder"] for r in missing.select("folder").distinct().orderBy("folder").limit(20).collect()]
    if names:
        raise ValueError(f"folders without a station; assign or skip them: {names}")
    return out.select(*images.columns)


def bursts_of_confirmed(images: DataFrame, gap_seconds: float) -> DataFrame:
    """Bursts of the readable images that have a station and a time."""
    good = F.col("station_id").isNotNull() & F.col("captured_at").isNotNull() & ~F.lower(F.coalesce("status", F.lit(""))).isin(*UNREADABLE)
    return burst_events(images.filter(good), gap_seconds)


def still_to_ingest(scanned: DataFrame, images: DataFrame, run_id, stage: str) -> DataFrame:
    """Files of a scan whose content the run has not stored; none once the run has left preflight."""
    if stage != "preflight":
        return scanned.limit(0)
    return scanned.join(images.filter(F.col("run_id") == run_id).select("sha256").distinct(), "sha256", "left_anti")


def image_rows(probed: DataFrame, run_id: str, reserve_id: str, clock: int, origin: str) -> DataFrame:
    """Image rows of a probe: id from the content, status, clock, origin and row hash.  One clock value stamps the batch."""
    rows = probed.select(
        F.left("sha256", F.lit(16)).alias("image_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(reserve_id).alias("reserve_id"),
        F.col("path").alias("orig_path"),
        "sha256",
        "dhash",
        F.col("dhash").alias("phash"),
        "width",
        "height",
        "bytes",
        F.col("is_night").cast("int").alias("is_night"),
        F.when(F.col("error").isNotNull(), "CORRUPT").otherwise("pending").alias("status"),
        F.to_json(F.array_compact(F.array("error"))).alias("flags"),
    )
    business = rows.columns
    return rows.withColumn("lamport", F.lit(clock + 1).cast("long")).withColumn("origin", F.lit(origin)).withColumn("row_hash", row_hash(*business))


def greatest_of(updates: DataFrame, key: str) -> DataFrame:
    """One row a key: that whose other columns, in their order, are greatest, whatever the partitions."""
    columns = [c for c in updates.columns if c != key]
    if not columns:
        return updates.distinct()
    return updates.groupBy(key).agg(F.max(F.struct(*columns)).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in columns])


def with_status(images: DataFrame, updates: DataFrame, clock: int, business: list[str]) -> DataFrame:
    """``updates`` (image_id, status, triage_stage) applied; of several for an image that of the greatest (status, triage_stage).

    A changed row that carries a clock gets the next one, a new hash, and counts as not synced.
    """
    new = greatest_of(updates.select("image_id", "status", "triage_stage"), "image_id").select("image_id", F.col("status").alias("_status"), F.col("triage_stage").alias("_stage"), F.lit(True).alias("_hit"))
    hit, tracked = F.col("_hit").isNotNull(), F.col("_hit").isNotNull() & F.col("lamport").isNotNull()
    out = images.join(new, "image_id", "left").withColumn("status", F.when(hit, F.col("_status")).otherwise(F.col("status"))).withColumn("triage_stage", F.when(hit, F.col("_stage")).otherwise(F.col("triage_stage")))
    out = out.withColumn("row_hash", F.when(tracked, row_hash(*business)).otherwise(F.col("row_hash"))).withColumn("synced_at", F.when(~tracked, F.col("synced_at")))
    return out.withColumn("lamport", F.when(tracked, F.lit(clock + 1).cast("long")).otherwise(F.col("lamport"))).select(*images.columns)


def set_many(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """The columns of ``updates`` besides ``key`` set for the keys it names; other rows stay, unknown keys are ignored.

    Of several updates of a key that counts whose other columns, in their order, are greatest.
    """
    columns = [c for c in updates.columns if c != key]
    new = greatest_of(updates, key).select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = table.join(new, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_hit").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)))
    return joined.select(*table.columns)


def finished_run(runs: DataFrame, run_id, counts: DataFrame, now: Column) -> DataFrame:
    """The run with its number of images (counts: run_id, n) and its end."""
    own = F.col("run_id") == run_id
    out = runs.join(counts.select("run_id", F.col("n").alias("_n")), "run_id", "left")
    return out.withColumn("image_count", F.when(own, F.coalesce("_n", F.lit(0))).otherwise(F.col("image_count")).cast(runs.schema["image_count"].dataType)).withColumn("finished_at", F.when(own, now).otherwise(F.col("finished_at"))).select(*runs.columns)


# Individuals and entities ------------------------------------------------------------------------------------------


def provisional_individuals(crops: DataFrame, now: Column, clock: int, origin: str) -> DataFrame:
    """A provisional individual for every crop (crop_id, reserve_id) that enrols: reserve, ``-P-`` and 8 hex digits of the crop's id."""
    name = F.concat(F.coalesce("reserve_id", F.lit("")), F.lit("-P-"), F.left(F.sha2(F.col("crop_id").cast("string"), 256), F.lit(8)))
    rows = crops.select(name.alias("ind_id"), "reserve_id", F.lit(True).alias("provisional"), now.alias("first_seen"), now.alias("last_seen"))
    return rows.withColumns({"row_hash": row_hash("ind_id", "reserve_id", "provisional"), "lamport": F.lit(clock + 1).cast("long"), "origin": F.lit(origin)})


def entity_list(entities: DataFrame, individuals: DataFrame, reserve_id) -> DataFrame:
    """Sides of a reserve's individuals, by individual, then side."""
    return entities.join(individuals.filter(F.col("reserve_id") == reserve_id).select("ind_id"), "ind_id", "left_semi").orderBy("ind_id", "side")


def entities_from_crops(assignments: DataFrame, crops: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that the live assignments of sided crops imply and that are not there yet, and assignments with their entity filled in."""
    sided = crops.filter(F.col("side").isin("L", "R")).select("crop_id", F.col("side").alias("_side"))
    placed = assignments.join(sided, "crop_id", "left").withColumn("_entity", F.concat_ws("-", F.col("ind_id").cast("string"), "_side"))
    found = placed.filter("superseded_by is null and _side is not null and ind_id is not null").groupBy(F.col("_entity").alias("entity_id"), "ind_id", F.col("_side").alias("side")).agg(F.count("*").alias("crop_count"))
    filled = placed.withColumn("entity_id", F.coalesce("entity_id", F.when(F.col("_side").isNotNull() & F.col("ind_id").isNotNull(), F.col("_entity"))))
    return inserted_only(entities, found, ["entity_id"]), filled.select(*assignments.columns)


def confirmed_association(associations: DataFrame, assignments: DataFrame, confirmed: DataFrame, user: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Associations of ``confirmed`` (assoc_id, primary_ind) confirmed, and the other individual's live assignments given to the primary one."""
    chosen = associations.join(confirmed, "assoc_id")
    merges = chosen.select(F.when(F.col("primary_ind") == F.col("l_ind_id"), F.col("r_ind_id")).otherwise(F.col("l_ind_id")).alias("source"), F.col("primary_ind").alias("target"))
    return _decided(associations, confirmed, "CONFIRMED", user, now), merged_individuals(assignments, merges)


def rejected_association(associations: DataFrame, rejected: DataFrame, user: str, now: Column) -> DataFrame:
    """Associations of ``rejected`` (assoc_id) closed; both individuals stay."""
    return _decided(associations, rejected, "REJECTED", user, now)


def _decided(associations: DataFrame, ids: DataFrame, status: str, user: str, now: Column) -> DataFrame:
    return set_many(associations, ids.select("assoc_id", F.lit(status).alias("status"), F.lit(user).alias("confirmed_by"), now.alias("confirmed_at")), "assoc_id")


# Crops and review --------------------------------------------------------------------------------------------------


SIDES = ("L", "R", "unknown")


def recorded_crops(crops: DataFrame, new: DataFrame) -> DataFrame:
    """``crops`` and new rows of them (of a part of their columns, the others null); a known crop_id, or a side other than L, R and unknown, is an error."""
    if not new.filter(~F.coalesce(F.col("side").isin(*SIDES), F.lit(False))).isEmpty():
        raise ValueError(f"a side is one of {SIDES}")
    whole = new.select(*[F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in crops.schema])
    return inserted_strictly(crops, whole, ["crop_id"])


def terminal_crops(detections: DataFrame, side_source: Column) -> DataFrame:
    """Crops of detections (det_id, side, side_confidence) that end before matching: without a usable rectangle, quality 0 and no vector; unknown where no side is known."""
    number = F.concat(F.lit("crop_"), F.left(F.sha2(F.concat_ws("|", F.lit("terminal"), F.col("det_id").cast("string")), 256), F.lit(12)))
    side = F.when(F.col("side").isin("L", "R"), F.col("side")).otherwise("unknown")
    return detections.select(number.alias("crop_id"), "det_id", side.alias("side"), F.lit(False).alias("rect_ok"), F.lit(0.0).alias("quality"), "side_confidence", side_source.alias("side_source"))


def with_embeddings(crops: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """``crops`` with the vectors (crop_id, embedding) of a model; a vector that is null leaves a crop as it was."""
    found = vectors.filter("embedding is not null").select("crop_id", "embedding", F.lit(model).alias("embed_model_version"))
    return set_many(crops, found, "crop_id")


def with_species(detections: DataFrame, said: DataFrame) -> DataFrame:
    """``detections`` with species, species_conf, species_source and, where ``said`` (det_id, ...) has it, species_model_version."""
    return set_many(detections, said, "det_id")


def activity_of(activity: DataFrame, station_id) -> DataFrame:
    """A station's intervals of activity, the earliest first."""
    return activity.filter(F.col("station_id") == F.lit(station_id)).orderBy("start_date", "activity_id")


def merged_with_entities(assignments: DataFrame, crops: DataFrame, entities: DataFrame, merges: DataFrame, individuals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Assignments (with entity_id) after merges of individuals, and the entities that follow from them, with their crops counted anew.

    Entities that nothing belongs to any more stay.  What ``merged_individuals`` calls an error is one here.
    """
    moved = merged_individuals(assignments, merges, individuals)
    # What live assignments belong to follows from where they are now.
    moved = checkpointed(moved.withColumn("entity_id", F.when(F.col("superseded_by").isNotNull(), F.col("entity_id"))))
    found, filled = entities_from_crops(moved, crops, entities.limit(0).select("entity_id", "ind_id", "side", "crop_count"))
    whole = found.select(*[F.col(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in entities.schema])
    return filled, upserted(entities, whole, ["entity_id"], ["crop_count"])


def crop_context(crops: DataFrame, detections: DataFrame, images: DataFrame) -> DataFrame:
    """crop_id with its side, its detection's box, and its image's path, run, reserve, station and time; crops whose detection or image is gone are left out."""
    own = crops.select("crop_id", "det_id", "side").join(detections.select("det_id", "image_id", "x", "y", "w", "h"), "det_id")
    return own.join(images.select("image_id", "orig_path", "run_id", "reserve_id", "station_id", "captured_at"), "image_id")


def crop_paths(crops: DataFrame, detections: DataFrame, images: DataFrame, files: DataFrame) -> DataFrame:
    """crop_id, shown: the crop's own file if it exists (files: path), else the frame it was cut from if that exists, else null."""
    have = files.select(F.col("path").alias("_at")).distinct()
    rows = crops.select("crop_id", "det_id", "path").join(detections.select("det_id", "image_id"), "det_id", "left").join(images.select("image_id", "orig_path"), "image_id", "left")
    for c in ("path", "orig_path"):
        rows = rows.join(have.select("_at", F.lit(True).alias(f"has_{c}")), F.col(c) == F.col("_at"), "left").drop("_at")
    return rows.select("crop_id", F.when(F.col("has_path"), F.col("path")).when(F.col("has_orig_path"), F.col("orig_path")).alias("shown"))


def open_items(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("state") == "open").alias("n"))


def closed_items(queue: DataFrame, crops: DataFrame) -> DataFrame:
    """Open and claimed items of the crops (crop_id) are done; no assignment is made."""
    hit = crops.select("crop_id").distinct().withColumn("_hit", F.lit(True))
    done = F.col("_hit").isNotNull() & F.col("state").isin("open", "claimed")
    return queue.join(hit, "crop_id", "left").withColumn("state", F.when(done, "done").otherwise(F.col("state"))).select(*queue.columns)


def dismissed_items(queue: DataFrame, items: DataFrame) -> DataFrame:
    """Items (queue_id) without a decision to make are done; an unknown one is an error."""
    if not items.join(queue.select("queue_id"), "queue_id", "left_anti").isEmpty():
        raise KeyError("no such item in the queue")
    return set_many(queue, items.select("queue_id", F.lit("done").alias("state")), "queue_id")


def quarantined_files(quarantine: DataFrame, images: DataFrame) -> DataFrame:
    """Where a quarantined frame lies now, with the status its serving depends on."""
    return quarantine.join(images.select("image_id", "status", "captured_at", "station_id"), "image_id", "left")


def served(requests: DataFrame, images: DataFrame, allowed_roles: tuple[str, ...]) -> DataFrame:
    """request_id, image_id and granted: frames of persons go to the allowed roles alone; unknown frames to nobody."""
    rows = requests.join(images.select("image_id", "status"), "image_id", "left")
    person = F.lower("status") == "person"
    return rows.select("request_id", "image_id", person.alias("person"), (F.col("status").isNotNull() & (~person | F.col("role").isin(*allowed_roles))).alias("granted"))


def access_counts(restricted: DataFrame, log: DataFrame) -> DataFrame:
    """Attempts to reach each restricted frame, refused ones too, added to its counter."""
    tried = log.groupBy("image_id").agg(F.count("*").alias("_n"))
    return restricted.join(tried, "image_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).select(*restricted.columns)


# Stations ----------------------------------------------------------------------------------------------------------


def added_stations(stations: DataFrame, activity: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New stations with defaults (name, zone core, 5 km to a village, active from now) and their first deployment."""
    have = set(new.columns)
    given = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    full = new.withColumns({"name": given("name", F.col("station_id").cast("string")), "zone": given("zone", F.lit("core")), "village_dist_km": given("village_dist_km", F.lit(5.0)), "active_from": given("active_from", now), "active_to": given("active_to", F.lit(None).cast("timestamp")), "status": given("status", F.lit("active"))})
    rows = full.select(*[F.col(c) if c in full.columns else F.lit(None).cast(stations.schema[c].dataType).alias(c) for c in stations.columns])
    first = full.select(F.concat(F.lit("act_"), F.col("station_id").cast("string")).alias("activity_id"), "station_id", F.col("active_from").alias("start_date"), F.col("active_to").alias("end_date"))
    return inserted_strictly(stations, rows, ["station_id"]), activity.unionByName(first)


def changed_stations(stations: DataFrame, changes: DataFrame) -> DataFrame:
    """The columns of ``changes`` set for its stations; an unknown station is an error."""
    if not changes.join(stations.select("station_id"), "station_id", "left_anti").isEmpty():
        raise KeyError("no such station")
    return set_many(stations, changes, "station_id")


def removed_stations(stations: DataFrame, activity: DataFrame, images: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations and their deployments without those of ``gone`` (station_id); a station with images is not removed: that is an error."""
    if not images.join(gone.select("station_id"), "station_id", "left_semi").isEmpty():
        raise ValueError("stations with images cannot be removed")
    return tuple(t.join(gone.select("station_id"), "station_id", "left_anti") for t in (stations, activity))


def boundaries(reserves: DataFrame, columns: tuple[str, ...] = ("boundary_geojson", "core_geojson", "buffer_geojson", "corridor_geojson")) -> DataFrame:
    """Boundaries as variants; text that is no JSON is a variant string, null stays null."""
    as_text = lambda c: F.when(F.col(c).isNotNull(), F.variant_get(F.parse_json(F.to_json(F.array(c))), "$[0]", "variant"))
    return reserves.withColumns({c: F.coalesce(F.try_parse_json(c), as_text(c)) for c in columns})


# Runs, jobs and accounts -------------------------------------------------------------------------------------------


def telemetry(rows: DataFrame, run_id) -> DataFrame:
    """A run's measurements, newest first; counts by status from JSON, none if it is malformed."""
    counts = F.coalesce(F.from_json("status_counts", "map<string,long>"), F.create_map().cast("map<string,long>"))
    return rows.filter(F.col("run_id") == run_id).withColumn("status_counts", counts).orderBy(F.col("recorded_at").desc())


def checkpointed_jobs(jobs: DataFrame, marks: DataFrame) -> DataFrame:
    """Each job's newest mark (job_id, at, done, cursor): written with the batch it describes, so a job resumes after its cursor."""
    last = marks.groupBy("job_id").agg(F.max(F.struct("at", "done", "cursor")).alias("m"))
    return set_many(jobs, last.select("job_id", F.col("m.at").alias("checkpoint_at"), F.col("m.done").alias("done"), F.col("m.cursor").alias("cursor")), "job_id")


def after_cursor(items: DataFrame, key: str, cursor) -> DataFrame:
    """What a resumed job has yet to do, in the order of ``key``."""
    return items if cursor is None else items.filter(F.col(key) > cursor)


def reaped_jobs(jobs: DataFrame, now: Column, silent_seconds: int = 600) -> DataFrame:
    """Running jobs whose last mark is too old are paused, to be resumed."""
    silent = (F.col("state") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("checkpoint_at") > silent_seconds)
    return jobs.withColumn("state", F.when(silent, "paused").otherwise(F.col("state")))


def ended_jobs(jobs: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """Jobs of ``ends`` (job_id, state, error) get that state, the end, and 2,000 characters of error at most; cancelling needs a job that has not ended."""
    new = ends.select("job_id", F.col("state").alias("_state"), F.left("error", F.lit(2000)).alias("_error"))
    out = jobs.join(new, "job_id", "left")
    may = F.col("_state").isNotNull() & ((F.col("_state") != "cancelled") | F.col("state").isin("queued", "running", "paused"))
    return out.withColumns({"state": F.when(may, F.col("_state")).otherwise(F.col("state")), "error": F.when(may, F.coalesce("_error", "error")).otherwise(F.col("error")), "finished_at": F.when(may, now).otherwise(F.col("finished_at"))}).select(*jobs.columns)


def worth_keeping(tables: dict[str, DataFrame]) -> bool:
    """Whether live tables hold anything that a backup must not lose."""
    return any(not tables[name].isEmpty() for name in ("individuals", "images") if name in tables)


def data_mode(marker: DataFrame) -> str:
    """live or seeded, as the newest marker (mode, at) says; live without a valid one."""
    last = marker.filter(F.col("mode").isin("live", "seeded")).agg(F.max_by("mode", "at")).first()[0]
    return last or "live"


def changed_accounts(users: DataFrame, sessions: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Accounts created or changed (username, role, disabled); sessions of disabled ones are revoked."""
    out = upserted(users, changes, ["username"], ["role", "disabled"])
    off = out.filter("disabled").select("username", F.lit(True).alias("_off"))
    ended = sessions.join(off, "username", "left").withColumn("revoked_at", F.coalesce("revoked_at", F.when(F.col("_off"), now)))
    return out, ended.select(*sessions.columns)


def node_name(spark, key: str = "spark.tracklake.node") -> str:
    """This node's name: made once and kept in the session's settings."""
    name = spark.conf.get(key, None)
    if name is None:
        import uuid

        name = f"node-{uuid.uuid4().hex[:12]}"
        spark.conf.set(key, name)
    return name
