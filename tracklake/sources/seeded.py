"""Seeded reserves of any size: every value follows from the seed and the row's own number, whatever the partitions.

Each reserve has a few stations and individuals whose captures play fixed parts, one for each alert rule that a survey
has to raise or to hold back, and any number of others that live elsewhere in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CYCLE_DAYS = 30
START = "2026-01-01"
KM = 1 / 111.32  # degrees of latitude

#: Stations with a part: name, km north and east of the reserve's middle, zone, km to the next village, first and last active day of the last three cycles.
CAST_STATIONS = [
    ("HOME1", 0.0, 0.0, "core", 12.0, None, None), ("HOME2", 0.1, 0.1, "core", 12.0, None, None), ("EDGE", 0.6, 0.2, "buffer", 1.0, None, None), ("HILL", 4.2, 0.0, "core", 10.0, None, None),
    ("HILL2", 4.2, 1.0, "core", 10.0, None, None), ("QUIET1", -5.5, -5.0, "core", 14.0, None, None), ("QUIET2", -5.4, -4.9, "core", 14.0, None, None), ("POND", 1.1, 1.0, "core", 13.0, None, None),
    ("BROKEN1", -11.0, -10.0, "core", 14.0, None, 64), ("BROKEN2", -10.9, -9.9, "core", 14.0, None, 64), ("LATE", 2.2, 2.1, "core", 13.0, 60, None), ("EDGE2", 0.7, 0.3, "buffer", 0.8, None, None),
]
#: Parts: individual, cycle of the last three, stations (places in the list above), events, identity confidence.
PARTS = [
    (0, 0, [0, 1], 6, 0.95), (0, 1, [0, 1], 6, 0.95), (0, 2, [2], 3, 0.95),  # into the buffer
    (1, 1, [0, 1], 6, 0.95), (1, 2, [3], 6, 0.95),  # its centre moves
    (2, 0, [5, 6], 4, 0.95), (2, 1, [5, 6], 4, 0.95),  # gone, with cameras working
    (3, 0, [0, 1], 5, 0.95), (3, 1, [0, 1], 5, 0.95), (3, 2, [7], 3, 0.95),  # at a new station
    (4, 0, [8, 9], 4, 0.95), (4, 1, [8, 9], 4, 0.95),  # gone, with cameras broken
    (5, 0, [0, 1], 5, 0.95), (5, 1, [0, 1], 5, 0.95), (5, 2, [10], 2, 0.95),  # at a station that was not there before
    (6, 1, [0, 1], 5, 0.95), (6, 2, [4], 2, 0.95),  # its centre moves, by few events
    (7, 2, [11], 2, 0.44),  # into the buffer, but who is it
    (8, 0, [5, 6], 12, 0.95), (8, 1, [5, 6], 14, 0.95), (8, 2, [5, 6], 2, 0.95),  # hardly seen any more
]
N_CAST = 1 + max(p[0] for p in PARTS)


def draw(seed: int, what: str, *numbers: Column) -> Column:
    """A number from 0 to 1, the same for the same seed, purpose and numbers."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *numbers), F.lit(1 << 48)) / float(1 << 48)


def _rows(rows: list[tuple], names: list[str]) -> Column:
    """A fixed list of rows as one array of structs."""
    value = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v).cast("double") if v is None or isinstance(v, float) else F.lit(v)
    kinds = lambda v, name: value(v).cast("double") if name in ("from_day", "to_day") else value(v)
    return F.array(*[F.struct(*[kinds(v, n).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])


def seeded_reserves(spark: SparkSession, reserves: int = 1, stations: int = 36, individuals: int = 24, cycles: int = 3, visits: int = 6, seed: int = 42, partitions: int | None = None) -> dict[str, DataFrame]:
    """reserves, runs, stations, activity, individuals and captures of seeded reserves, with all foreign keys.

    ``stations`` and ``individuals`` are those of a reserve, at least the cast; the others are seen ``visits`` times a cycle at most.
    """
    if cycles < 3 or stations <= len(CAST_STATIONS) or individuals < N_CAST:
        raise ValueError(f"at least 3 cycles, {len(CAST_STATIONS) + 1} stations and {N_CAST} individuals")
    every = lambda n: spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    of = lambda each: F.floor(F.col("id") / each).cast("long")
    named = lambda r: F.concat(F.lit("reserve-"), F.lpad(r.cast("string"), 6, "0"))
    at = lambda days: F.timestamp_micros((F.unix_micros(F.to_timestamp(F.lit(START))) + days * 86_400_000_000).cast("long"))
    middle = lambda r: (12.0 + 14.0 * draw(seed, "lat", r), 74.0 + 10.0 * draw(seed, "lon", r))
    r = F.col("r")
    lat, lon = middle(r)
    place = lambda north, east: ((lat + north * KM).alias("lat"), (lon + east * KM / F.cos(F.radians(lat))).alias("lon"))
    base = (cycles - 3) * CYCLE_DAYS

    names = ["name", "north", "east", "zone", "village_dist_km", "from_day", "to_day"]
    cast = every(reserves).withColumnRenamed("id", "r").select("r", F.posexplode(_rows(CAST_STATIONS, names)).alias("s", "c")).select("r", "s", "c.*")
    rest = every(reserves * (stations - len(CAST_STATIONS))).select(of(stations - len(CAST_STATIONS)).alias("r"), (F.col("id") % (stations - len(CAST_STATIONS)) + len(CAST_STATIONS)).cast("int").alias("s"))
    near = draw(seed, "village", r, F.col("s"))
    # The others stand on a grid well to the east of the cast, three km apart.
    rest = rest.select(
        "r",
        "s",
        F.concat(F.lit("GRID"), F.col("s").cast("string")).alias("name"),
        (3.0 * (F.col("s") % 6) - 9).alias("north"),
        (20 + 3.0 * F.floor(F.col("s") / 6)).alias("east"),
        F.when(near < 0.6, "core").when(near < 0.8, "corridor").otherwise("buffer").alias("zone"),
        F.round(0.5 + 12 * near, 1).alias("village_dist_km"),
        F.lit(None).cast("double").alias("from_day"),
        F.lit(None).cast("double").alias("to_day"),
    )
    placed = cast.unionByName(rest).withColumn("station_id", r * stations + F.col("s"))
    began = F.when(F.col("from_day").isNull(), 0).otherwise(base + F.col("from_day"))

    parts = ["i", "cycle", "at", "events", "confidence"]
    played = every(reserves).withColumnRenamed("id", "r").select("r", F.explode(_rows(PARTS, parts)).alias("p")).select("r", "p.*").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("events") - 1)))
    played = played.select(
        "r",
        F.col("i").cast("long").alias("i"),
        (F.col("cycle") + cycles - 3).cast("long").alias("cycle"),
        F.col("n").cast("long").alias("n"),
        F.element_at("at", F.col("n") % F.size("at") + 1).cast("long").alias("s"),
        ((F.col("n") + 1) * (CYCLE_DAYS - 2.0) / (F.col("events") + 1)).alias("day"),
        F.col("confidence").cast("double").alias("confidence"),
    )
    others, grid = individuals - N_CAST, stations - len(CAST_STATIONS)
    wild = every(reserves * others * cycles * visits).select(
        of(others * cycles * visits).alias("r"),
        (of(cycles * visits) % max(1, others) + N_CAST).alias("i"),
        (of(visits) % cycles).alias("cycle"),
        (F.col("id") % visits).alias("n"),
    )
    home = F.floor(draw(seed, "home", r, F.col("i")) * grid)
    roam = F.floor(draw(seed, "roam", r, F.col("i"), F.col("cycle"), F.col("n")) * 3)
    wild = wild.filter(draw(seed, "seen", r, F.col("i"), F.col("cycle"), F.col("n")) < 0.8).select(
        "r",
        "i",
        "cycle",
        "n",
        ((home + roam) % grid + len(CAST_STATIONS)).cast("long").alias("s"),
        (CYCLE_DAYS * draw(seed, "day", r, F.col("i"), F.col("cycle"), F.col("n"))).alias("day"),
        F.round(0.6 + 0.4 * draw(seed, "sure", r, F.col("i"), F.col("cycle"), F.col("n")), 3).alias("confidence"),
    )
    captures = played.unionByName(wild).select(
        F.concat_ws("-", F.lit("img"), r.cast("string"), F.col("i").cast("string"), F.col("cycle").cast("string"), F.col("n").cast("string")).alias("image_id"),
        named(r).alias("reserve_id"),
        (r * cycles + F.col("cycle")).cast("int").alias("run_id"),
        (r * stations + F.col("s")).alias("station_id"),
        (r * individuals + F.col("i")).alias("ind_id"),
        at(F.col("cycle") * CYCLE_DAYS + F.col("day")).alias("captured_at"),
        F.when(draw(seed, "side", r, F.col("i"), F.col("cycle"), F.col("n")) < 0.5, "L").otherwise("R").alias("side"),
        "confidence",
    )
    return {
        "reserves": every(reserves).select(named(F.col("id")).alias("reserve_id"), F.concat(F.lit("Seeded reserve "), F.col("id").cast("string")).alias("name"), F.lit(32643).alias("utm_epsg")),
        "runs": every(reserves * cycles).select(F.col("id").cast("int").alias("run_id"), named(of(cycles)).alias("reserve_id"), at((F.col("id") % cycles) * CYCLE_DAYS).alias("started_at")),
        "stations": placed.select("station_id", named(r).alias("reserve_id"), F.concat_ws("-", F.lit("S"), r.cast("string"), "name").alias("name"), *place(F.col("north"), F.col("east")), "zone", "village_dist_km"),
        "activity": placed.select(F.col("station_id").alias("activity_id"), "station_id", named(r).alias("reserve_id"), at(began).alias("start_date"), F.when(F.col("to_day").isNotNull(), at(base + F.col("to_day"))).alias("end_date")),
        "individuals": every(reserves * individuals).select(F.col("id").alias("ind_id"), named(of(individuals)).alias("reserve_id"), (F.col("id") % individuals >= N_CAST).alias("provisional")),
        "captures": captures,
    }
