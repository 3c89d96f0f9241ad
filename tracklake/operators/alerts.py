"""Movement alerts across cycles, with suppression by survey effort.

Each rule is a projection of one wide frame with a row for every run and individual: the current occupancy, the three
rows before it (of those that exist, so cycles without a row are skipped), its new stations, the coverage and the identity
confidence.  No row carries its whole past, so the frame grows with the runs and not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.config import SETTINGS
from tracklake.functions import geo
from tracklake.functions.text import short_id
from tracklake.operators import effort
from tracklake.operators.effort import in_reserves
from tracklake.operators.occupancy import occupancy
from tracklake.operators.sessions import burst_sessions, cycle_periods
from tracklake.storage import checkpointed

A = SETTINGS.alerts


def transits(events: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    """Moves between consecutive events at different stations: from_station, km, hours, kmh."""
    order = Window.partitionBy(*keys).orderBy("started_at", "station_id", "event_no")
    w = events.withColumn("from_station", F.lag("station_id").over(order)).withColumn("left_at", F.lag("ended_at").over(order))
    a = stations.select(F.col("station_id").alias("from_station"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = stations.select("station_id", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    moved = w.filter(F.col("from_station") != F.col("station_id")).join(a, "from_station").join(b, "station_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = F.greatest(F.lit(0.01), (micros("started_at") - micros("left_at")) / 3_600_000_000.0)
    km = geo.distance_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return moved.withColumn("km", km).withColumn("hours", hours).withColumn("kmh", F.col("km") / F.col("hours")).drop("a_lat", "a_lon", "b_lat", "b_lon")


def history(occupancy: DataFrame, runs: DataFrame, stations: DataFrame, confidences: DataFrame, coverages: DataFrame, individuals: DataFrame | None = None) -> DataFrame:
    """The wide frame.

    ``occupancy``: run_id, ind_id, station_set, centroid_lat, centroid_lon, event_count.  ``runs``: run_id, started_at,
    and reserve_id where there are several reserves.  ``confidences``: run_id, ind_id, id_conf.  ``coverages``: run_id,
    ind_id, coverage.  Individuals are carried into every run of their reserve from their first row on, so that absences
    show; with ``individuals`` (ind_id) only those that still exist are.  last, last2 and last3 are the rows before, from
    the nearest on; fresh are the stations that the individual was never at before, with their zones.  n_earlier counts
    the reserve's earlier runs: there are no alerts in the first.
    """
    earlier_runs = F.count("*").over(Window.partitionBy("reserve_id").orderBy("started_at").rowsBetween(Window.unboundedPreceding, -1))
    numbered = in_reserves(runs).select("run_id", "reserve_id", "started_at", earlier_runs.alias("n_earlier"))
    if individuals is not None:
        occupancy = occupancy.join(individuals.select("ind_id").distinct(), "ind_id", "left_semi")
    dated = occupancy.join(numbered, "run_id")
    first = dated.groupBy("reserve_id", "ind_id").agg(F.min("started_at").alias("first_at"))
    # Runs are few and their number is that of the survey's cycles; individuals meet those of their own reserve.
    spread = first.join(numbered, "reserve_id").filter(F.col("started_at") >= F.col("first_at")).select("reserve_id", "ind_id", "run_id", "started_at", "n_earlier")
    # Zones, the nearest village and first visits of a row's stations; a station is new just in the run of its first visit.
    used = dated.select("run_id", "reserve_id", "started_at", "ind_id", F.posexplode("station_set").alias("at", "station_id")).join(stations.select("station_id", "zone", "village_dist_km"), "station_id", "left")
    visit = Window.partitionBy("reserve_id", "ind_id", "station_id")
    used = used.withColumn("is_new", F.col("started_at") == F.min("started_at").over(visit))
    about = used.groupBy("run_id", "ind_id").agg(
        F.avg(F.when(F.col("zone").isNotNull(), (F.col("zone") == "buffer").cast("int"))).alias("buffer_share"),
        F.min("village_dist_km").alias("nearest_km"),
        F.array_sort(F.collect_list(F.when(F.col("is_new"), F.struct("at", "station_id", "zone")))).alias("fresh"),
    )
    rows = spread.join(occupancy.withColumn("_present", F.lit(True)), ["run_id", "ind_id"], "left").join(confidences, ["run_id", "ind_id"], "left").join(coverages, ["run_id", "ind_id"], "left").join(about, ["run_id", "ind_id"], "left")
    past = Window.partitionBy("reserve_id", "ind_id").orderBy("started_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_row", F.when(F.col("_present"), F.struct("centroid_lat", "centroid_lon", "event_count", "buffer_share", "nearest_km")))
    # Rows that exist, however many runs back: a run without one is skipped.
    back = lambda n: F.expr(f"lag(_row, {n}) IGNORE NULLS OVER (PARTITION BY reserve_id, ind_id ORDER BY started_at)")
    rows = rows.withColumns({"last": back(1), "last2": back(2), "last3": back(3), "n_prior": F.count("_row").over(past)})
    return rows.withColumn("conf_last", F.last(F.when(F.col("event_count") > 0, F.struct("id_conf")), ignorenulls=True).over(past)["id_conf"]).drop("_row", "_present")


def _candidate(kind: str, severity: str, when: Column, strength: Column, suppress: Column | None = None, reason: Column | None = None, key: Column | None = None, confidence: Column | None = None) -> Column:
    """What a rule says of a row of the frame: a struct where it raises an alert, else null."""
    held = F.coalesce(suppress, F.lit(False)) if suppress is not None else F.lit(False)
    said = F.struct(
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        F.coalesce(key.cast("string"), F.lit("")).alias("key") if key is not None else F.lit("").alias("key"),
        strength.cast("double").alias("strength"),
        (confidence if confidence is not None else F.col("id_conf")).alias("id_conf"),
        held.alias("suppressed"),
        (F.when(held, reason) if reason is not None else F.lit(None).cast("string")).alias("suppress_reason"),
    )
    return F.when((F.col("n_earlier") > 0) & when, said)


def _raised(h: DataFrame, *candidates: Column) -> DataFrame:
    """The alerts of some rules, in one pass over the frame."""
    each = h.select("run_id", "ind_id", "coverage", F.explode(F.array_compact(F.array(*candidates))).alias("a"))
    return each.select("run_id", "ind_id", "a.type", "a.severity", "a.key", "a.strength", "a.id_conf", "coverage", "a.suppressed", "a.suppress_reason")


def _centroid_shift() -> Column:
    km = geo.distance_km(F.col("last.centroid_lat"), F.col("last.centroid_lon"), F.col("centroid_lat"), F.col("centroid_lon"))
    limit = F.when(F.col("last.buffer_share") > 0.5, A.buffer_shift_km).otherwise(A.core_shift_km)
    few = F.least("event_count", "last.event_count")
    strength = F.least(F.lit(0.95), 0.55 + 0.25 * (km - limit) / limit)
    moved = (F.col("event_count") > 0) & (F.col("last.event_count") > 0) & (km > limit)
    return _candidate("centroid_shift", "watch", moved, strength, few < A.min_events_for_centroid, F.concat(F.lit("only "), few.cast("string"), F.lit(" events, below the minimum")))


def centroid_shift(h: DataFrame) -> DataFrame:
    """The centroid moved further than the zone of the previous row allows."""
    return _raised(h, _centroid_shift())


def new_station(h: DataFrame, stations: DataFrame, days: DataFrame, runs: DataFrame) -> DataFrame:
    """First capture at a station outside the buffer; suppressed where the station or the individual could not have been seen there before."""
    each = h.filter("n_earlier > 0 and n_prior > 0").select("run_id", "ind_id", "reserve_id", "started_at", "id_conf", "coverage", F.explode("fresh").alias("f")).filter("f.zone <> 'buffer'").withColumn("station_id", F.col("f.station_id"))
    active = days.filter("days > 0").join(in_reserves(runs).select("run_id", "reserve_id", F.col("started_at").alias("d_start")), "run_id").select("station_id", "reserve_id", F.col("run_id").alias("d_run"), "d_start")
    met = each.join(active, ["station_id", "reserve_id"], "left").withColumn("before", F.col("d_start") < F.col("started_at"))
    seen = h.filter("event_count > 0").select(F.col("run_id").alias("d_run"), "ind_id", F.lit(True).alias("detected"))
    met = met.join(seen, ["d_run", "ind_id"], "left")
    keys = ["run_id", "ind_id", "station_id"]
    found = met.groupBy(*keys).agg(F.count_if("before").alias("active_before"), F.count_if(F.col("before") & F.col("detected")).alias("watched"), F.first("id_conf").alias("id_conf"), F.first("coverage").alias("coverage"))
    installed = F.col("active_before") < 1
    reason = F.when(installed, "station was installed this cycle").otherwise("individual was not detected while the station was active")
    alert = _candidate("new_station", "info", F.lit(True), F.lit(0.6), installed | (F.col("watched") == 0), reason, F.col("station_id"))
    return _raised(found.withColumn("n_earlier", F.lit(1)), alert)


def _first_fresh(zone: str) -> Column:
    """The first of a row's new stations that lies in a zone; null without one."""
    return F.get(F.filter("fresh", lambda f: f["zone"] == zone), F.lit(0))["station_id"]


def _buffer_ward() -> Column:
    at = _first_fresh("buffer")
    return _candidate("buffer_ward", "act", at.isNotNull(), 0.85 * F.when(F.col("ratio") > A.buffer_spike, A.buffer_damping).otherwise(1.0), key=at)


def _with_ratio(h: DataFrame, buffer_ratio: DataFrame) -> DataFrame:
    return h.join(buffer_ratio.select("run_id", "ratio"), "run_id", "left")


def buffer_ward(h: DataFrame, stations: DataFrame, buffer_ratio: DataFrame) -> DataFrame:
    """First capture in the buffer, history or not; weaker where the buffer was watched much more than before (run_id, ratio)."""
    return _raised(_with_ratio(h, buffer_ratio), _buffer_ward())


def _absence() -> Column:
    # The last cycles with a row.
    recent = F.array(*[F.col(f"last{n if n > 1 else ''}.event_count") for n in range(1, A.absence_cycles + 1)])
    gone = (F.col("n_prior") >= A.absence_cycles) & F.forall(recent, lambda n: n > 0) & (F.coalesce("event_count", F.lit(0)) == 0)
    covered = F.coalesce("coverage", F.lit(0.0))
    return _candidate("absence", "watch", gone, F.lit(0.7), covered < A.min_coverage, F.concat(F.lit("coverage "), covered.cast("string"), F.lit(" is too low")), confidence=F.col("conf_last"))


def absence(h: DataFrame) -> DataFrame:
    """Present in each of the last cycles with a row, absent now."""
    return _raised(h, _absence())


def _directional_trend() -> Column:
    at = lambda r: [F.col(f"{r}.centroid_lat"), F.col(f"{r}.centroid_lon")]
    now = [F.col("centroid_lat"), F.col("centroid_lon")]
    first, second = geo.distance_km(*at("last2"), *at("last")), geo.distance_km(*at("last"), *now)
    turn = geo.angle_between(geo.bearing(*at("last2"), *at("last")), geo.bearing(*at("last"), *now))
    moved = (F.col("n_prior") >= 2) & (first >= A.min_leg_km) & (second >= A.min_leg_km)
    return _candidate("directional_trend", "watch", moved, F.lit(0.75), turn > A.max_angle_deg, F.lit("movement is not in one direction"))


def directional_trend(h: DataFrame) -> DataFrame:
    """Three centroids in a row, both legs of a kilometre or more, in about one direction."""
    return _raised(h, _directional_trend())


def _decreasing_village_distance() -> Column:
    near = (F.col("nearest_km") < F.col("last.nearest_km")) & (F.col("nearest_km") <= A.village_warn_km)
    return _candidate("decreasing_village_distance", "act", near, F.lit(0.85))


def decreasing_village_distance(h: DataFrame) -> DataFrame:
    """A station nearer to a village than those of the row before, and near."""
    return _raised(h, _decreasing_village_distance())


def _activity_collapse() -> Column:
    recent = F.array_compact(F.array(*[F.col(f"{r}.event_count") for r in ("last", "last2", "last3")]))
    mean = F.try_divide(F.aggregate(recent, F.lit(0.0), lambda acc, n: acc + n), F.size(recent))
    fallen = (F.col("n_prior") > 0) & (mean >= A.collapse_min_mean) & (F.col("event_count") > 0) & (F.col("event_count") <= A.collapse_ratio * mean)
    return _candidate("activity_collapse", "watch", fallen, F.lit(0.75), F.coalesce("coverage", F.lit(0.0)) < A.min_coverage, F.lit("survey coverage dropped"))


def activity_collapse(h: DataFrame) -> DataFrame:
    """Far fewer events than in the last three rows, but some."""
    return _raised(h, _activity_collapse())


def _new_corridor() -> Column:
    at = _first_fresh("corridor")
    return _candidate("new_corridor", "watch", (F.col("n_prior") > 0) & at.isNotNull(), F.lit(0.8), key=at)


def new_corridor(h: DataFrame, stations: DataFrame) -> DataFrame:
    """First capture in a corridor of an individual with history."""
    return _raised(h, _new_corridor())


def _travel_time_anomaly() -> Column:
    key = F.concat_ws("_", F.col("move.from_station").cast("string"), F.col("move.station_id").cast("string"))
    return _candidate("travel_time_anomaly", "watch", (F.col("n_prior") > 0) & F.col("move").isNotNull(), F.lit(0.85), key=key)


def _with_moves(h: DataFrame, moves: DataFrame) -> DataFrame:
    fast = moves.filter((F.col("kmh") > A.max_speed_kmh) & (F.col("km") > A.min_transit_km))
    return h.join(fast.groupBy("run_id", "ind_id").agg(F.min(F.struct("started_at", "event_no", "from_station", "station_id")).alias("move")), ["run_id", "ind_id"], "left")


def travel_time_anomaly(h: DataFrame, moves: DataFrame) -> DataFrame:
    """The first move of a run that no animal can have made; ``moves`` from ``transits`` by run and individual."""
    return _raised(_with_moves(h, moves), _travel_time_anomaly())


def _identity_confidence_collapse() -> Column:
    fallen = (F.col("n_prior") > 0) & (F.col("conf_last") >= A.confidence_from) & (F.col("conf_last") - F.col("id_conf") >= A.confidence_drop)
    return _candidate("identity_confidence_collapse", "watch", fallen, F.lit(0.8))


def identity_confidence_collapse(h: DataFrame) -> DataFrame:
    """Identified with far less confidence than when last seen."""
    return _raised(h, _identity_confidence_collapse())


def finalised(candidates: DataFrame, t_low: float = SETTINGS.t_low) -> DataFrame:
    """Confidence, suppression by weak identity and a fixed id."""
    trust = F.least(F.coalesce("id_conf", F.lit(1.0)), F.col("strength")) * F.least(F.lit(1.0), F.coalesce("coverage", F.lit(1.0)))
    weak = ~F.col("suppressed") & F.coalesce(F.col("id_conf") < t_low, F.lit(False))
    reason = F.when(weak, F.lit("identity confidence is below the review threshold")).otherwise(F.col("suppress_reason"))
    alert_id = short_id(F.col("run_id"), F.col("ind_id"), F.col("type"), F.col("key"), prefix="al_")
    return candidates.select(
        alert_id.alias("alert_id"), "run_id", "ind_id", "type", "severity", "key", F.round(trust, 3).alias("confidence"), F.coalesce("coverage", F.lit(1.0)).alias("coverage"), (F.col("suppressed") | weak).alias("suppressed"), reason.alias("suppress_reason")
    )


def alerts(h: DataFrame, stations: DataFrame, days: DataFrame, runs: DataFrame, moves: DataFrame, buffer_ratio: DataFrame) -> DataFrame:
    """All ten rules, finalised.  Nine look at a row of the frame, in one pass; new stations meet the days on which they were active."""
    h = checkpointed(h)
    rows = _with_moves(_with_ratio(h, buffer_ratio), moves)
    rules = [_centroid_shift(), _buffer_ward(), _absence(), _directional_trend(), _decreasing_village_distance(), _activity_collapse(), _new_corridor(), _travel_time_anomaly(), _identity_confidence_collapse()]
    return finalised(_raised(rows, *rules).unionByName(new_station(h, stations, days, runs)))


def survey_alerts(captures: DataFrame, stations: DataFrame, activity: DataFrame, runs: DataFrame, gap_seconds: float = SETTINGS.burst_gap_seconds) -> DataFrame:
    """All alerts of a survey from its captures (image_id, run_id, ind_id, station_id, captured_at, confidence), for all reserves and runs at once.

    Events, home ranges, effort and coverage are found on the way, each once.  Stations, activity and runs have a
    reserve_id where there are several reserves; a capture without individual, station or time takes no part.
    """
    runs, stations, activity = checkpointed(in_reserves(runs).select("run_id", "reserve_id", "started_at")), checkpointed(in_reserves(stations)), in_reserves(activity)
    known = captures.filter("ind_id is not null and station_id is not null")
    events = checkpointed(
        burst_sessions(known, gap_seconds).groupBy("run_id", "ind_id", "station_id", "event_no")
        .agg(F.min("captured_at").alias("started_at"), F.max("captured_at").alias("ended_at"))
    )
    periods = checkpointed(cycle_periods(runs, A.default_cycle_days))
    days = checkpointed(effort.station_days(activity, periods))
    used = checkpointed(events.groupBy("run_id", "ind_id", "station_id").agg(F.countDistinct("event_no").alias("event_count")))
    occupied = occupancy(used, stations, days.select("station_id", "run_id", "days"), used.limit(0)).filter("event_count > 0").select("run_id", "ind_id", "station_set", "centroid_lat", "centroid_lon", "event_count")
    trust = known.groupBy("run_id", "ind_id").agg(F.round(F.avg("confidence"), 3).alias("id_conf"))
    own = runs.select("run_id", "reserve_id", F.col("started_at").alias("own_at"))
    later = runs.select(F.col("run_id").alias("later_run"), F.col("reserve_id").alias("later_reserve"), "started_at")
    follows = own.join(later, (F.col("reserve_id") == F.col("later_reserve")) & (F.col("started_at") > F.col("own_at"))).select("run_id", "later_run")
    earlier = used.join(follows, "run_id").select(F.col("later_run").alias("run_id"), "ind_id", "station_id").distinct()
    coverages = effort.coverage(earlier, days, periods)
    buffers = stations.filter("zone = 'buffer'").select("station_id", "reserve_id").join(runs.select("run_id", "reserve_id"), "reserve_id").select("run_id", F.lit(-1).cast("long").alias("ind_id"), "station_id")
    ratio = effort.coverage(buffers, days, periods).select("run_id", F.col("coverage").alias("ratio"))
    frame = history(occupied, runs, stations, trust, coverages)
    return alerts(frame, stations, days, runs, transits(events, stations, ["run_id", "ind_id"]), ratio)
