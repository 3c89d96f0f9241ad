"""Lists and pages that a survey's screens show, and the tables behind a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("L", "R")


def runs_listed(runs: DataFrame, reserve: str | None = None, limit: int = 100) -> DataFrame:
    """Runs, of one reserve if it is given, newest first."""
    own = runs if reserve is None else runs.filter(F.col("reserve_id") == reserve)
    return own.orderBy(F.col("started_at").desc(), "run_id").limit(limit)


def by_name(df: DataFrame, name: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """All rows in the order of their names, without the hidden columns (such as password hashes)."""
    return df.drop(*hidden).orderBy(name)


def images_of_status(images: DataFrame, stations: DataFrame, status: str) -> DataFrame:
    """Images of a status with the name of their station, null where it is unknown."""
    names = stations.select("station_id", F.col("name").alias("station_name"))
    return images.filter(F.col("status") == status).join(names, "station_id", "left")


def page_of(df: DataFrame, order: list, offset: int, limit: int, most: int = 500) -> DataFrame:
    """A page in a total order, each row with the total number of rows and whether more follow; the limit is held between 1 and ``most``."""
    offset, limit = max(0, offset), max(1, min(most, limit))
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.col("total") > offset + limit)


def catalogue_of_side(entities: DataFrame, side: str) -> DataFrame:
    """The entities of one side; any other side than L or R is an error, before anything is read."""
    if side not in SIDES:
        raise ValueError(f"side is L or R, not {side!r}")
    return entities.filter(F.col("side") == side)


def acknowledged_last(alerts: DataFrame, *order) -> DataFrame:
    """Alerts in an order, those that were acknowledged after all others."""
    return alerts.orderBy(F.col("acknowledged_at").isNotNull(), *order)


def quarantine_sample(quarantine: DataFrame, images: DataFrame, limit: int = 24) -> DataFrame:
    """The frames in quarantine with the lowest confidence, with where and when they were taken."""
    held = quarantine.filter("restored_at is null").join(images.select("image_id", "station_id", "captured_at", "is_night"), "image_id")
    return held.orderBy("conf", "image_id").limit(limit)


def quarantine_manifest(manifest: DataFrame, moved: DataFrame) -> DataFrame:
    """The manifest with the moved frames; those of known images are replaced, so that a repeated move changes nothing."""
    return manifest.join(moved.select("image_id").distinct(), "image_id", "left_anti").unionByName(moved.dropDuplicates(["image_id"]))


def occupancy_listed(occupancy: DataFrame, individuals: DataFrame) -> DataFrame:
    """Home ranges of known individuals, the largest first, those without an area last."""
    return occupancy.join(individuals.select("ind_id", "provisional"), "ind_id").orderBy(F.col("area_km2").desc_nulls_last(), "ind_id")


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), "job_id").limit(limit)


def jobs_of_run(jobs: DataFrame, run_id) -> DataFrame:
    return jobs.filter(F.col("run_id") == F.lit(run_id)).orderBy(F.col("created_at").desc(), "job_id")


def active_jobs(jobs: DataFrame, states: tuple[str, ...] = ("queued", "running", "paused")) -> DataFrame:
    return jobs.filter(F.col("state").isin(*states)).orderBy("created_at", "job_id")


def failed_items(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items that were given up, with the run and kind of their job."""
    return items.filter("state = 'dead'").join(jobs.select("job_id", "run_id", "kind"), "job_id")


def side_leakage(scores: DataFrame) -> DataFrame:
    """What a catalogue that pools both sides would do: total queries, best matches that are the entity itself, and those that are the same individual's other side.

    ``scores``: query_id, query_entity, query_ind, query_side, entity_id, ind_id, side, score, without a query's own vector.
    """
    best = scores.groupBy("query_id").agg(F.max_by(F.struct("query_entity", "query_ind", "query_side", "entity_id", "ind_id", "side"), F.struct("score", F.col("entity_id"))).alias("b")).select("b.*")
    own = F.col("entity_id") == F.col("query_entity")
    other = ~own & (F.col("ind_id") == F.col("query_ind")) & (F.col("side") != F.col("query_side"))
    return best.agg(F.count("*").alias("total"), F.count_if(own).alias("correct_entity_hits"), F.count_if(other).alias("opposite_flank_hits"))


def explained(runs: DataFrame, occupancy: DataFrame, alerts: DataFrame) -> DataFrame:
    """run_id and explanation: why a run's map or list of alerts is empty, or what was found."""
    seen = occupancy.groupBy("run_id").agg(F.count_if(F.col("event_count") > 0).alias("found"))
    raised = alerts.groupBy("run_id").agg(F.count_if(~F.col("suppressed")).alias("raised"), F.count_if("suppressed").alias("held"))
    earlier = runs.groupBy("reserve_id").agg(F.min("started_at").alias("first_at"))
    df = runs.join(seen, "run_id", "left").join(raised, "run_id", "left").join(earlier, "reserve_id").na.fill(0, ["found", "raised", "held"])
    count = lambda c: F.col(c).cast("string")
    ranges = F.concat(F.lit("Home ranges of "), count("found"), F.lit(" individuals"))
    text = (
        F.when(F.col("found") == 0, "Nobody was identified in this run, so there is no home range; identify its animal frames first.")
        .when(F.col("started_at") == F.col("first_at"), F.concat(ranges, F.lit("; no alerts, as this is the first cycle and there is none to compare with.")))
        .when(F.col("raised") + F.col("held") == 0, F.concat(ranges, F.lit("; nothing deviated enough from earlier cycles for an alert.")))
        .otherwise(F.concat(ranges, F.lit("; "), count("raised"), F.lit(" alerts raised, "), count("held"), F.lit(" held back with a reason.")))
    )
    return df.select("run_id", text.alias("explanation"))


def map_bundle(run_id, stations: DataFrame, occupancy: DataFrame, prior: DataFrame, events: DataFrame, alerts: DataFrame, periods: DataFrame) -> dict[str, DataFrame]:
    """The tables behind a run's map: stations with their states, its home ranges, earlier centroids, events, alerts and its cycle."""
    own = lambda df: df.filter(F.col("run_id") == F.lit(run_id))
    return {"stations": stations, "occupancy": own(occupancy), "prior_centroids": own(prior), "events": own(events), "alerts": own(alerts), "cycle": own(periods)}


def image_truth(images: DataFrame, annotations: DataFrame, empty: int = 30) -> DataFrame:
    """image_id, station_id, captured_at and is_animal of annotated images: all but those whose only category is the empty one.

    ``images``: id, file_name, location, date_captured; ``annotations``: image_id, category_id.  An image without any
    annotation counts as one with an animal.
    """
    cats = annotations.groupBy(F.col("image_id").alias("id")).agg(F.min("category_id").alias("low"), F.max("category_id").alias("high"))
    alone = F.coalesce((F.col("low") == empty) & (F.col("high") == empty), F.lit(False))
    return images.join(cats, "id", "left").select(F.col("id").alias("image_id"), F.col("location").cast("string").alias("station_id"), F.coalesce("date_captured", F.lit("")).alias("captured_at"), (~alone).alias("is_animal"))


def reserves_of(runs: DataFrame, run_ids: DataFrame) -> DataFrame:
    """All runs of the reserves of some runs, oldest first: what is computed anew after a correction."""
    hit = runs.join(run_ids.select("run_id").distinct(), "run_id", "left_semi").select("reserve_id").distinct()
    return runs.join(hit, "reserve_id", "left_semi").orderBy("started_at", "run_id")


#: Passwords that anyone would guess.
WEAK_PASSWORDS = ("password", "tiger", "reserve", "12345678", "123456789", "qwertyuiop", "changeme", "letmein", "welcome")


def weak_password(password: Column, username: Column, least: int = 10, weak: tuple[str, ...] = WEAK_PASSWORDS) -> Column:
    """Reasons why a password is weak; an empty list if there is none.  ``weak`` words count with signs around them too."""
    low = F.lower(password)
    bare = F.regexp_replace(low, r"^\p{Punct}+|\p{Punct}+$", "")
    reasons = [
        F.when(F.char_length(password) < least, "too short"),
        F.when(low.isin(*weak) | bare.isin(*weak), "too common"),
        F.when((F.char_length(username) > 0) & F.contains(low, F.lower(username)), "holds the user name"),
    ]
    return F.array_compact(F.array(*reasons))


def recovery_code(code: Column) -> Column:
    """A code as it is compared: upper case, without blanks and hyphens."""
    return F.regexp_replace(F.upper(F.trim(code)), "[ -]", "")


def images_of_run(images: DataFrame, run_id) -> DataFrame:
    """A run's images by station and time."""
    return images.filter(F.col("run_id") == F.lit(run_id)).orderBy("station_id", "captured_at", "image_id")


def audit_tail(log: DataFrame, limit: int = 200) -> DataFrame:
    """The newest entries of the audit log."""
    return log.orderBy(F.col("log_id").desc()).limit(limit)


def recent_failures(items: DataFrame, limit: int = 25) -> DataFrame:
    """The newest failed items, of all jobs."""
    return items.filter("state = 'failed'").orderBy(F.col("updated_at").desc(), "job_id", "item_id").limit(limit)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of every reserve."""
    return runs.groupBy("reserve_id").agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id")).alias("r")).select("r.*")
