"""Merkle fixity audit of archived records (WARC).

A manifest has one line for each record: the archive file it is in, its offset and length there, and the SHA-256 of its
bytes.  A leaf of the tree is a range of RANGE_BYTES offsets of one file, its digest taken over the offset, length,
record and digest of every line that starts there, in the order of offsets.  Each level above covers FANOUT ranges of
the level below, up to whole files, and then FANOUT files, up to one root.  So records that are altered, lost, added,
or found at other offsets than before change every node above them.

An audit compares two replicas from the root down.  Each level joins only the children of nodes that differ, so sound
branches are never read again; at the bottom the lines of differing ranges are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import checkpointed, numbered

FANOUT = 16
RECORDS_PER_FILE = 256
RANGE_BYTES = 1 << 16
HEADER = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{id}>\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/html\r\nContent-Length: {length}\r\n\r\n"
NO_ID = -1
#: Hex digits of a digest that deal the pages of one number into parts.
PART_DIGITS = 3


def record_bytes(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC resource record: header, payload, two line ends."""
    out = F.lit(HEADER)
    body = F.coalesce(payload, F.lit(""))
    for name, value in (("{id}", record_id.cast("string")), ("{length}", F.octet_length(body).cast("string")), ("{uri}", F.coalesce(uri, F.lit("")))):
        out = F.replace(out, F.lit(name), value)
    return F.concat(out, body, F.lit("\r\n\r\n")).cast("binary")


def manifest(pages: DataFrame) -> DataFrame:
    """record, copy, file, offset, length and digest of every page (page_id, url, html).

    Pages without id have the number NO_ID.  Several pages of one number are told apart by ``copy``, their place in the
    order of their digests.  Null texts are empty.  No pages, no lines.
    """
    record = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID))
    content = pages.select(record.alias("record"), record_bytes(record, F.col("url"), F.col("html")).alias("bytes"))
    lines = content.select("record", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("digest"))
    # Equal records are counted before they meet, so a record that is repeated very often is one row here.
    counted = lines.groupBy("record", "length", "digest").agg(F.count("*").alias("copies"))
    placed = counted.withColumn("file", F.floor(F.col("record") / RECORDS_PER_FILE).cast("long")).withColumn("part", F.left("digest", F.lit(PART_DIGITS)))
    # Sums by part first: a number that very many different pages share is dealt by their digests, not one group.
    keys = ["file", "record", "part"]
    parts = placed.groupBy(*keys).agg(F.sum(F.col("length") * F.col("copies")).alias("part_length"), F.sum("copies").alias("part_copies"))
    before = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    starts = parts.select(
        *[F.col(k).alias(f"p_{k}") for k in keys],
        before("part_length", Window.partitionBy("file").orderBy("record", "part")).alias("part_start"),
        before("part_copies", Window.partitionBy("file", "record").orderBy("part")).alias("part_first"),
    )
    same = [F.col(k) == F.col(f"p_{k}") for k in keys]
    inside = Window.partitionBy(*keys).orderBy("digest")
    summed = placed.withColumn("own_start", before(F.col("length") * F.col("copies"), inside)).withColumn("own_first", before("copies", inside)).join(starts, same)
    first_start, first_copy = F.col("part_start") + F.col("own_start"), F.col("part_first") + F.col("own_first")
    each = numbered(summed, "copies", "i")
    return each.select("record", (first_copy + F.col("i")).alias("copy"), "file", (first_start + F.col("i") * F.col("length")).alias("offset"), "length", "digest")


def _digest(lines: Column) -> Column:
    """SHA-256 over the texts of a list in their order."""
    return F.sha2(F.array_join(lines, "\n"), 256)


def range_nodes(lines: DataFrame) -> DataFrame:
    """The leaves: file, node (number of the offset range) and digest over the lines that start in it, by offset."""
    said = F.concat_ws(":", "length", "record", "digest")
    keyed = lines.select("file", F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node"), F.left("digest", F.lit(1)).alias("part"), "offset", said.alias("said"))
    # A sound range has few lines, as records do not overlap.  A broken index may put any number at one place: they are
    # dealt by offset and digest first, so that their list is no single group.
    some = keyed.groupBy("file", "node", "offset", "part").agg(_digest(F.array_sort(F.collect_list("said"))).alias("some"))
    return some.groupBy("file", "node").agg(_digest(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part", "some"))), lambda x: F.concat_ws(":", x["offset"], x["part"], x["some"]))).alias("digest"))


def _parents(nodes: DataFrame, of: str) -> DataFrame:
    """One level up: FANOUT ranges of a file, or (of = ``file``) FANOUT files, with one digest."""
    up = nodes.withColumn("child", F.col(of)).withColumn(of, F.floor(F.col(of) / FANOUT).cast("long"))
    children = F.array_sort(F.collect_list(F.struct("child", "digest")))
    return up.groupBy("file", "node").agg(_digest(F.transform(children, lambda c: F.concat_ws(":", c["child"], c["digest"]))).alias("digest"))


def levels_over(*manifests: DataFrame) -> list[str]:
    """What is joined at each level above the leaves: ranges until every file is one node, then files until numbers of one sign are one."""
    most = [m.agg(F.max("offset"), F.max(F.greatest(F.col("file"), -1 - F.col("file")))).first() for m in manifests]
    out = []
    for i, (name, unit) in enumerate((("node", RANGE_BYTES), ("file", 1))):
        top = max((r[i] or 0) for r in most) // unit
        while top:
            out.append(name)
            top //= FANOUT
    return out


def tree(lines: DataFrame, levels: list[str]) -> list[DataFrame]:
    """Levels from the ranges up; each is written once."""
    out = [checkpointed(range_nodes(lines))]
    for of in levels:
        out.append(checkpointed(_parents(out[-1], of)))
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("file", "node", F.col("digest").alias("da")), b.select("file", "node", F.col("digest").alias("db"))
    return left.join(right, ["file", "node"], "full").filter(~F.col("da").eqNullSafe(F.col("db"))).select("file", "node")


def _below(nodes: DataFrame, open_nodes: DataFrame, of: str) -> DataFrame:
    """The nodes whose parent is open."""
    parents = open_nodes.select(F.col("file").alias("p_file"), F.col("node").alias("p_node"))
    up = {"file": F.col("file"), "node": F.col("node")}
    up[of] = F.floor(F.col(of) / FANOUT)
    return nodes.join(parents, (up["file"] == F.col("p_file")) & (up["node"] == F.col("p_node")), "left_semi")


def differing_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """file and node of the offset ranges in which two manifests differ, found from the roots down."""
    levels = levels_over(a, b)
    trees = tree(a, levels), tree(b, levels)
    open_nodes = checkpointed(_differing(trees[0][-1], trees[1][-1]))
    for i in range(len(levels) - 1, -1, -1):
        open_nodes = checkpointed(_differing(*[_below(t[i], open_nodes, levels[i]) for t in trees]))
    return open_nodes


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """record, file_a, offset_a, length_a, digest_a, the same of b, and status of every line in which two manifests differ.

    status: moved (the same bytes at another offset or in another file), changed (other bytes), missing (only in a) or
    added (only in b).  Lines of one record and digest are matched by place, the rest of a record in the order of places;
    so of several copies it is the surplus ones that are missing or added.  Equal manifests, also empty ones, give no row.
    """
    ranges = differing_ranges(a, b).select(F.col("file").alias("r_file"), F.col("node").alias("r_node"))
    inside = (F.col("file") == F.col("r_file")) & (F.floor(F.col("offset") / RANGE_BYTES) == F.col("r_node"))
    found = [m.join(ranges, inside, "left_semi").select("record", "file", "offset", "length", "digest") for m in (a, b)]
    # Lines that are equal in both go first: the rest alone are matched.
    every = found[0].withColumn("n", F.lit(1)).unionByName(found[1].withColumn("n", F.lit(-1)))
    line = ["record", "file", "offset", "length", "digest"]
    rest = checkpointed(every.groupBy(*line).agg(F.sum("n").alias("n")).filter("n <> 0"))
    sides = []
    for side, sign in (("a", 1), ("b", -1)):
        own = numbered(rest.withColumn("n", F.col("n") * sign), "n", "copy")
        named = own.select("record", F.col("digest").alias("same"), *[F.col(c).alias(f"{c}_{side}") for c in line[1:]], "copy")
        sides.append(named.withColumn("nth", F.row_number().over(Window.partitionBy("record", "same").orderBy(f"file_{side}", f"offset_{side}", "copy"))).drop("copy"))
    full = checkpointed(sides[0].join(sides[1], ["record", "same", "nth"], "full"))
    moved = full.filter("digest_a is not null and digest_b is not null")
    singles = []
    for side, other in (("a", "b"), ("b", "a")):
        alone = full.filter(f"digest_{other} is null").select("record", *[f"{c}_{side}" for c in line[1:]])
        singles.append(alone.withColumn("nth", F.row_number().over(Window.partitionBy("record").orderBy(f"file_{side}", f"offset_{side}", f"digest_{side}"))))
    others = singles[0].join(singles[1], ["record", "nth"], "full")
    columns = ["record", *[f"{c}_{side}" for side in "ab" for c in line[1:]]]
    status = F.when(F.col("digest_a").isNull(), "added").when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a") == F.col("digest_b"), "moved").otherwise("changed")
    return moved.select(*columns).unionByName(others.select(*columns)).withColumn("status", status)


def _draw(record: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("fault:"), record.cast("string"))), 1, 4), 16, 10).cast("int")


def faulty_replica(pages: DataFrame) -> DataFrame:
    """The manifest of a copy of the pages with faults at places that depend on a hash of the page number.

    Of 128 records one or two are altered in place by a byte, one is lost, one stands behind the end of its file, and one
    has a second copy of other bytes behind that, under a number of its own.
    """
    record = F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID))
    first = F.when(F.left("html", F.lit(1)) == "x", "y").otherwise("x")
    altered = F.when((_draw(record) % 64 == 1) & F.ascii("html").between(1, 127), F.concat(first, F.substr("html", F.lit(2)))).otherwise(F.col("html"))
    lines = manifest(pages.withColumn("html", altered))
    ends = lines.groupBy(F.col("file").alias("e_file")).agg(F.max(F.col("offset") + F.col("length")).alias("end"))
    draw = _draw(F.col("record")) % 128
    known = lines.join(ends, F.col("file") == F.col("e_file")).withColumn("draw", draw).filter("draw <> 2")
    stray = known.filter("draw = 4 and record >= 0").select((-2 - F.col("record")).alias("record"), "copy", "file", (F.col("offset") + 2 * F.col("end")).alias("offset"), "length", F.sha2("digest", 256).alias("digest"))
    offset = F.when(F.col("draw") == 3, F.col("offset") + F.col("end")).otherwise(F.col("offset"))
    return known.withColumn("offset", offset).select(*lines.columns).unionByName(stray.select(*lines.columns))


def report(pages: DataFrame) -> DataFrame:
    """The whole manifest of ``pages`` with the outcome of an audit against a replica with faults, and the replica's added lines.

    record, file, offset, length, digest, status (sound, changed, moved, missing, added).
    """
    lines = checkpointed(manifest(pages))
    found = checkpointed(audit(lines, checkpointed(faulty_replica(pages))))
    place = ["record", "file", "offset", "length", "digest"]
    faults = found.filter("status <> 'added'").select(*[F.col("record" if c == "record" else f"{c}_a").alias(f"f_{c}") for c in place], "status")
    same = F.lit(True)
    for c in place:
        same = same & (F.col(c) == F.col(f"f_{c}"))
    judged = lines.join(faults, same, "left").select(*place, F.coalesce("status", F.lit("sound")).alias("status"))
    added = found.filter("status = 'added'").select("record", *[F.col(f"{c}_b").alias(c) for c in place[1:]], "status")
    return judged.unionByName(added)
