"""Stations, home ranges and packages in exchange formats, and signed bundles between nodes."""

from __future__ import annotations

import hashlib
import hmac
import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators.segments import numbered
from tracklake.storage import checkpointed

# The names that a station's columns may have.
ALIASES = {
    "station_id": ["station_id", "id"],
    "name": ["name", "station"],
    "lat": ["lat", "latitude"],
    "lon": ["lon", "lng", "longitude"],
    "zone": ["zone"],
    "village_dist_km": ["village_dist_km", "village_km"],
    "folder_hint": ["folder_hint"],
    "camera_make": ["camera_make", "make"],
    "camera_model": ["camera_model", "model"],
    "camera_serial": ["camera_serial", "serial"],
    "grid_cell": ["grid_cell"],
}
ZONES = ["core", "buffer", "corridor"]


#: Fixed value: the published profile of camera trap packages.
PACKAGE_PROFILE = "https://raw.githubusercontent.com/tdwg/camtrap-dp/1.0/camtrap-dp-profile.json"


def _stations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and errors from rows with the raw text columns of ALIASES and their number ``row``, from 1."""
    lat, lon, village = (F.col(c).try_cast("double") for c in ("lat", "lon", "village_dist_km"))
    nowhere = F.coalesce((lat == 0) | (lon == 0) | ~lat.between(-90, 90) | ~lon.between(-180, 180), F.lit(True))
    error = F.when(F.col("station_id").isNull(), "no id").when(nowhere, "no valid position").when(F.col("village_dist_km").isNotNull() & village.isNull(), "no valid distance")
    zone = F.when(F.lower("zone").isin(*ZONES), F.lower("zone")).otherwise("core")
    judged = rows.withColumn("error", error)
    good = judged.filter("error is null").select(
        "station_id",
        F.coalesce("name", "station_id").alias("name"),
        lat.alias("lat"),
        lon.alias("lon"),
        zone.alias("zone"),
        F.coalesce(village, F.lit(5.0)).alias("village_dist_km"),
        F.coalesce("folder_hint", "station_id").alias("folder_hint"),
        "camera_make",
        "camera_model",
        "camera_serial",
        "grid_cell",
    )
    return good, judged.filter("error is not null").select("row", "error")


def stations_from_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stations of a CSV with a header (several spellings) and a table of rows in error: their number among the data rows and why.

    Positions at 0 and distances that are no numbers are errors, unknown zones core.
    """
    table = spark.read.option("header", "true").csv(path)
    # Blocks of a file may be read in any order: rows are numbered by where their block begins.
    placed = table.select("*", F.lit(0).alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    raw = numbered(placed, "_file", ["_start", "_at"])
    known = {c.strip().lower(): c for c in raw.columns}

    def pick(names: list[str]) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{known[n]}`")), F.lit("")) for n in names if n in known]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return _stations(raw.select(*[pick(names).alias(c) for c, names in ALIASES.items()], F.col("_i").alias("row")))


def stations_from_geojson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stations of the point features of a GeoJSON file; other features are skipped."""
    schema = "features array<struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    each = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.posexplode("features").alias("at", "f")).filter("f.geometry.type = 'Point'")
    at = F.from_json("f.geometry.coordinates", "array<double>")
    from_map = lambda names: F.coalesce(*[F.col("f.properties")[n] for n in names])
    values = {c: from_map(names) for c, names in ALIASES.items() if c not in ("lat", "lon", "station_id")}
    made = F.concat(F.lit("st_"), F.substring(F.sha2("f.geometry.coordinates", 256), 1, 8))
    rows = each.select(F.coalesce(from_map(ALIASES["station_id"]), F.col("f.id"), made).alias("station_id"), F.get(at, F.lit(1)).cast("string").alias("lat"), F.get(at, F.lit(0)).cast("string").alias("lon"), *[v.alias(c) for c, v in values.items()], (F.col("at") + 1).cast("long").alias("row"))
    return _stations(rows)


def _feature(geometry: Column, properties: Column, name: Column | None = None) -> Column:
    own = [] if name is None else [name.alias("id")]
    return F.to_json(F.struct(F.lit("Feature").alias("type"), *own, geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


#: What a full station feature tells besides; columns that the table lacks are null.
CAMERA_COLUMNS = ("folder_hint", "camera_make", "camera_model", "camera_serial")


def station_features(stations: DataFrame, full: bool = False) -> DataFrame:
    """One GeoJSON feature a row, to be written as lines; ``full`` ones have an id and the camera columns."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    told = ["station_id", "name", "zone", "village_dist_km"]
    if not full:
        return stations.select(_feature(point, F.struct(*told)).alias("feature"))
    camera = [F.col(c) if c in stations.columns else F.lit(None).cast("string").alias(c) for c in CAMERA_COLUMNS]
    return stations.select(_feature(point, F.struct(*told, *camera), F.col("station_id")).alias("feature"))


def range_features(occupancy: DataFrame, with_positions: bool) -> DataFrame:
    """Home ranges with a hull as features; without positions the geometry is null and no centroid is told."""
    pairs = F.split(F.regexp_extract("hull_wkt", r"\(\((.*)\)\)", 1), ", ")
    ring = F.transform(pairs, lambda p: F.transform(F.split(p, " "), lambda x: x.cast("double")))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    told = ["run_id", "ind_id", "area_km2", "event_count"] + (["centroid_lat", "centroid_lon"] if with_positions else [])
    geometry = shape if with_positions else F.lit(None).cast("string")
    return occupancy.filter("hull_wkt is not null").select(_feature(geometry, F.struct(*told)).alias("feature"))


def range_rows(occupancy: DataFrame, with_positions: bool) -> DataFrame:
    """Rows of the CSV of home ranges; without positions the centroid and the stations are blank, the area stays."""
    hidden = lambda c: c if with_positions else F.lit("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return occupancy.select(
        text("run_id").alias("run_id"), text("ind_id").alias("ind_id"), hidden(F.array_join(F.col("station_set").cast("array<string>"), "|")).alias("station_set"), hidden(text("centroid_lat")).alias("centroid_lat"), hidden(text("centroid_lon")).alias("centroid_lon"),
        text("area_km2").alias("area_km2"), text("event_count").alias("event_count"), text("effort_days").alias("effort_days"), text("insufficient_reason").alias("insufficient_reason"),
    )


# Fixed values of the package: observation types by label, the species' scientific name.  Any other label is unclassified.
OBSERVATION_TYPES = {"animal": "animal", "person": "human", "vehicle": "vehicle"}
SCIENTIFIC = {"tiger": "Panthera tigris"}


def _mapped(column: str, table: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def camera_trap_package(stations: DataFrame, activity: DataFrame, media: DataFrame, detections: DataFrame, run_end: Column | None = None, include_locations: bool = True) -> dict[str, DataFrame]:
    """deployments, media and observations tables of a package, with all columns of the format.

    ``activity`` may have note; ``media`` has image_id, station_id, captured_at, status and path; ``detections`` image_id,
    det_id, label, species, conf, assign_confidence and perhaps event_id, ind_id and assign_method.  A deployment without
    end lasts to ``run_end``.  Without locations there are no coordinates.  Media and observations without a deployment
    are left out; blank and quarantined frames are observations.  What a row does not tell is null, an empty field of the CSV.
    """
    from tracklake.operators.effort import deployment_of

    told = lambda df, c, kind="string": F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    place = lambda c: F.col(c) if include_locations else F.lit(None).cast("double")
    end = F.coalesce("end_date", run_end) if run_end is not None else F.col("end_date")
    deployments = activity.join(stations.select("station_id", "name", "lat", "lon"), "station_id").select(
        F.col("activity_id").alias("deploymentID"),
        F.col("station_id").alias("locationID"),
        F.col("name").alias("locationName"),
        place("lat").alias("latitude"),
        place("lon").alias("longitude"),
        F.col("start_date").alias("deploymentStart"),
        end.alias("deploymentEnd"),
        told(activity, "note").alias("deploymentComments"),
    )
    placed = deployment_of(media, activity).filter("activity_id is not null")
    shown = placed.select(
        F.col("image_id").alias("mediaID"),
        F.col("activity_id").alias("deploymentID"),
        F.col("captured_at").alias("timestamp"),
        F.col("path").alias("filePath"),
        (F.coalesce("status", F.lit("")) != "person").alias("filePublic"),
        F.element_at(F.split("path", r"[/\\\\]"), -1).alias("fileName"),
        F.lit("image/jpeg").alias("fileMediatype"),
    )
    seen = detections.join(placed.select("image_id", F.col("activity_id").alias("deploymentID"), F.col("captured_at").alias("at")), "image_id")
    chance = F.coalesce(F.nullif("assign_confidence", F.lit(0.0)), F.nullif("conf", F.lit(0.0)))
    observed = seen.select(
        F.col("det_id").cast("string").alias("observationID"),
        "deploymentID",
        F.col("image_id").alias("mediaID"),
        told(seen, "event_id").alias("eventID"),
        F.col("at").alias("eventStart"),
        F.col("at").alias("eventEnd"),
        F.lit("media").alias("observationLevel"),
        _mapped("label", OBSERVATION_TYPES, F.lit("unclassified")).alias("observationType"),
        _mapped("species", SCIENTIFIC, F.nullif("species", F.lit(""))).alias("scientificName"),
        F.lit(1).alias("count"),
        told(seen, "ind_id").alias("individualID"),
        F.when(told(seen, "assign_method") == "human", "human").otherwise("machine").alias("classificationMethod"),
        chance.alias("classificationProbability"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    blanks = placed.filter(F.col("status").isin("blank", "quarantined")).select(
        F.concat(F.lit("blank_"), F.col("image_id").cast("string")).alias("observationID"),
        F.col("activity_id").alias("deploymentID"),
        F.col("image_id").alias("mediaID"),
        none("string").alias("eventID"),
        F.col("captured_at").alias("eventStart"),
        F.col("captured_at").alias("eventEnd"),
        F.lit("media").alias("observationLevel"),
        F.lit("blank").alias("observationType"),
        none("string").alias("scientificName"),
        none("int").alias("count"),
        none("string").alias("individualID"),
        F.lit("machine").alias("classificationMethod"),
        none("double").alias("classificationProbability"),
    )
    return {"deployments": deployments, "media": shown, "observations": observed.unionByName(blanks)}


def package_descriptor(reserve_id: str, reserve: str, run_id: object, cycle: str | None = None, created: datetime | None = None) -> dict:
    """What a package says about itself: its name, title and the folders of its tables."""
    tables = [{"name": name, "path": name, "profile": "tabular-data-resource"} for name in ("deployments", "media", "observations")]
    return {
        "name": f"tracklake-{reserve_id}-{run_id}".lower(),
        "profile": PACKAGE_PROFILE,
        "created": (created or datetime.now()).isoformat(timespec="seconds"),
        "title": f"Camera traps of {reserve}, {cycle or run_id}",
        "resources": tables,
        "sources": [{"title": "tracklake"}],
    }


def write_package(tables: dict[str, DataFrame], folder: str, descriptor: dict | None = None) -> None:
    """The tables as CSV folders, an empty table without header; the descriptor as a line of text in ``datapackage``."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", str(not df.isEmpty()).lower()).csv(f"{folder}/{name}")
    if descriptor is not None:
        session = next(iter(tables.values())).sparkSession
        session.range(1).select(F.lit(json.dumps(descriptor))).coalesce(1).write.mode("overwrite").text(f"{folder}/datapackage")


class SchemaNotAvailable(NotImplementedError):
    """A connector whose format has not been published."""


def export_mstripes(*_: object) -> None:
    raise SchemaNotAvailable("the M-STrIPES format has no public schema")


# Bundles -----------------------------------------------------------------------------------------------------------

#: Rows of a leaf of a bundle's tree, about; children of a node.
ROWS_PER_LEAF, CHILDREN = 1_000, 16


def _mac(secret: bytes, text: Column) -> Column:
    """HMAC-SHA256 of a text; the secret stands in no plan."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([hmac.new(secret, t.encode(), hashlib.sha256).hexdigest() for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def tree_of(rows: DataFrame, table: str, key: list[str], secret: bytes, leaves: int) -> DataFrame:
    """level, node, n (rows below) and digest of the tree of a table's rows.

    A leaf (level 0) is one of ``leaves`` equal ranges of the SHA-256 of the keys; its digest is over the keys and the
    MACs of whole rows in their order, equal rows counted.  A node above is over its CHILDREN children's numbers and
    digests.  Every digest is an HMAC and says which table, level and node it stands for, so that without the secret
    none can be made for other rows, nor moved to another place.
    """
    place = F.conv(F.substring(F.sha2(_json(key), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    each = rows.select((place * leaves / F.lit(1 << 48).cast("decimal(20,0)")).cast("long").alias("node"), _json(key).alias("key"), _mac(secret, _json(rows.columns)).alias("mac"))
    counted = each.groupBy("node", "key", "mac").agg(F.count("*").alias("n"))
    own = lambda level, body: _mac(secret, F.concat_ws("|", F.lit(json.dumps(table)), F.lit(str(level)), F.col("node").cast("string"), body))
    listed = F.to_json(F.sort_array(F.collect_list(F.struct("key", "mac", "n"))))
    level, nodes = 0, counted.groupBy("node").agg(F.sum("n").alias("n"), listed.alias("body"))
    out = None
    while True:
        nodes = checkpointed(nodes.select(F.lit(level).alias("level"), "node", "n", own(level, F.col("body")).alias("digest")))
        out = nodes if out is None else out.unionByName(nodes)
        if leaves == 1:
            return out
        level, leaves = level + 1, -(-leaves // CHILDREN)
        below = F.to_json(F.sort_array(F.collect_list(F.struct(F.col("node").alias("child"), "digest"))))
        nodes = nodes.groupBy(F.floor(F.col("node") / CHILDREN).cast("long").alias("node")).agg(F.sum("n").alias("n"), below.alias("body"))


def _root(tree: DataFrame) -> str:
    """The digest at the top; none for a table without rows."""
    top = tree.orderBy(F.col("level").desc(), "node").first()
    return top["digest"] if top else ""


def damaged_leaves(signed: DataFrame, found: DataFrame) -> DataFrame:
    """node, signed_rows and found_rows of the leaves that differ: from the top down, only below nodes that differ."""
    levels = max(df.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for df in (signed, found))
    parents = None
    for level in range(levels, -1, -1):
        side = lambda df, name: df.filter(F.col("level") == level).select("node", F.col("digest").alias(f"{name}_digest"), F.col("n").alias(f"{name}_rows"))
        both = side(signed, "signed").join(side(found, "found"), "node", "full").filter(~F.col("signed_digest").eqNullSafe(F.col("found_digest")))
        if parents is not None:
            both = both.join(parents.select(F.col("node").alias("_up")), F.floor(F.col("node") / CHILDREN) == F.col("_up"), "left_semi")
        parents = checkpointed(both)
    return parents.select("node", F.coalesce("signed_rows", F.lit(0)).alias("signed_rows"), F.coalesce("found_rows", F.lit(0)).alias("found_rows"))


def write_bundle(tables: dict[str, DataFrame], since: int, folder: str, secret: bytes, keys: dict[str, list[str]]) -> str:
    """Rows changed since a clock value, as Parquet with their trees, and the signature over all roots.  Each table has lamport and a key."""
    roots = {}
    for name, df in sorted(tables.items()):
        df.filter(F.col("lamport") > since).write.mode("overwrite").parquet(f"{folder}/{name}")
        written = df.sparkSession.read.parquet(f"{folder}/{name}")
        leaves = max(1, written.count() // ROWS_PER_LEAF)
        tree = tree_of(written, name, keys[name], secret, leaves)
        tree.write.mode("overwrite").parquet(f"{folder}/_trees/{name}")
        roots[name] = [leaves, _root(tree)]
    df.sparkSession.range(1).select(F.lit(json.dumps(roots, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/_trees/_roots")
    return signature(roots, since, secret)


def signature(roots: dict, since: int, secret: bytes) -> str:
    said = json.dumps({"since": since, "tables": roots}, sort_keys=True).encode()
    return hmac.new(secret, said, hashlib.sha256).hexdigest()


def audited_bundle(spark: SparkSession, folder: str, names: list[str], since: int, signed: str, secret: bytes, keys: dict[str, list[str]]) -> DataFrame:
    """table, node, signed_rows and found_rows of the key ranges in which a bundle's rows are not the signed ones; none for a sound bundle.

    An error where what is signed itself was altered: the roots, or a tree that does not lead to its root.
    """
    roots = json.loads(spark.read.text(f"{folder}/_trees/_roots").first()[0])
    if not signed or set(roots) != set(names) or not hmac.compare_digest(signature(roots, since, secret), signed):
        raise ValueError("the bundle's signature does not hold")
    out = spark.createDataFrame([], "table string, node long, signed_rows long, found_rows long")
    for name in sorted(names):
        leaves, root = roots[name]
        found = tree_of(spark.read.parquet(f"{folder}/{name}"), name, keys[name], secret, leaves)
        if _root(found) != root:
            tree = spark.read.parquet(f"{folder}/_trees/{name}")
            if _root(tree) != root:
                raise ValueError(f"the tree of {name} was altered")
            out = out.unionByName(damaged_leaves(tree, found).select(F.lit(name).alias("table"), "node", "signed_rows", "found_rows"))
    return out


def read_bundle(spark: SparkSession, folder: str, names: list[str], since: int, signed: str, secret: bytes, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The tables of a bundle that is sound; else an error that names the damaged ranges."""
    bad = [f"{r['table']} range {r['node']} ({r['signed_rows']} rows signed, {r['found_rows']} found)" for r in audited_bundle(spark, folder, names, since, signed, secret, keys).orderBy("table", "node").limit(20).collect()]
    if bad:
        raise ValueError(f"rows were altered: {'; '.join(bad)}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
