"""Near copies for the pipeline: texts whose five-word shingles have a Jaccard similarity of 0.8 or more, and op5's links.

Candidates: 16 bands of 4 minima of hashes each.  Two texts of similarity s share a band with probability
1 - (1 - s^4)^16: 0.9998 at 0.8.  Every candidate pair is checked on its whole shingle sets (64-bit hashes), in Spark.

A band with many texts is not compared all with all.  First each text meets two leaders of each of its bands, and
components of those links follow.  In a band with at most one more text all pairs have met so.  The texts of
larger bands that still hold several components then meet by their rarest shingles: in one order of all shingles (rare
first), two sets of similarity 0.8 share one of the first fifth of each, at places that leave room for the overlap they need.  A copy with so many edits that it links to nothing has edits of its
own there, and meets hardly anyone, however large its group.  Pairs within a component need no check.

Shingle sets are made only for texts that need them: those of pairs that the parities of their sets leave possible, and
those of bands that may be compared by rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tracklake.llm import simhash
from tracklake.llm.common import checkpointed, packed, private, text_or_empty
from tracklake.llm.components import components

SHINGLE = 5
BANDS, ROWS = 16, 4
LEADERS = 2
PARITIES = 8
#: Rows of ids or digests that are broadcast against the texts; beyond that the same join is shuffled.
MAX_BROADCAST_ROWS = 100_000

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's five-word shingles, with op5's words.  Fewer words: the whole sequence is one."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, "<u8")
    parts = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, simhash.SEED) for p in parts), dtype="<u8"))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number for each band, other numbers for other bands; none for a text without words."""
    if not len(hashes):
        return np.empty(0, "<u8")
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[None, at : at + (1 << 12)] * _FACTORS + _OFFSETS).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(29)
    return out


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITIES classes of shingles whether a set holds an odd number of them, as bits."""
    odd = np.bincount((hashes & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_READ = StructType([StructField("fp", LongType()), StructField("n", LongType()), StructField("bands", ArrayType(LongType())), StructField("odd", ArrayType(LongType()))])


@F.pandas_udf(_READ)
def _read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        sets = [shingles(t) for t in batch]
        yield pd.DataFrame({
            "fp": np.array([simhash.fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64),
            "n": [len(s) for s in sets],
            "bands": [bands(s).view(np.int64) for s in sets],
            "odd": [parities(s) for s in sets],
        })


@F.pandas_udf(ArrayType(LongType()))
def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles(t).view(np.int64) for t in batch])


@F.pandas_udf(ArrayType(LongType()))
def _parities(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in sets:
        yield pd.Series([parities(np.asarray(s, np.int64).view(np.uint64)) for s in batch])


def _digest() -> Column:
    """What a text is told by: its SHA-256, null as empty."""
    return F.unhex(F.sha2(text_or_empty().cast("binary"), 256))


def _may_be_close(n: Column, m: Column) -> Column:
    """Sets of n and m elements can have a similarity of 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _parities_allow(n: Column, odd: Column, m: Column, other: Column) -> Column:
    """At that similarity at most (n + m) / 9 shingles are in one set alone, and each class in which parities differ has one of these."""
    differ = sum((F.bit_count(odd[i].bitwiseXOR(other[i])) for i in range(PARITIES)), F.lit(0))
    return 9 * differ <= n + m


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` (written already), to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def _sets_of(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """key and s (its text's shingle set) for the distinct ``keys`` (key, digest); sets are made for these texts alone."""
    texts = docs.select(_digest().alias("digest"), "text").join(_few(checkpointed(keys)), "digest").groupBy("key").agg(F.first("text").alias("text"))
    return checkpointed(texts.select("key", _sets("text").alias("s")))


def _both(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice, with x_ and y_ before the names: plans so alike that Spark shuffles them once."""
    one, two = (rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns]) for p in "xy")
    return one, two


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets have a similarity of 0.8 or more."""
    left, right = _both(sets)
    both = F.size(F.array_intersect("x_s", "y_s"))
    met = pairs.join(left, F.col("a") == F.col("x_key")).join(right, F.col("b") == F.col("y_key"))
    return met.filter(9 * both >= 4 * (F.size("x_s") + F.size("y_s"))).select("a", "b")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys of ``nodes`` (key, n, odd) that their parities leave possible."""
    left, right = _both(nodes.select("key", "n", "odd"))
    met = pairs.join(left, F.col("a") == F.col("x_key")).join(right, F.col("b") == F.col("y_key"))
    return met.filter(_parities_allow(F.col("x_n"), F.col("x_odd"), F.col("y_n"), F.col("y_odd"))).select("a", "b")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _rare_meetings(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys of ``apart`` (key, component; a key once) of different components that may have a similarity of 0.8: none that has is missing.

    Of two sets of n and m shingles with that similarity, 4/9 (n + m) are common, and the first common one in any order of
    all shingles stands at a place with that many left from it on, in both.  It is among the first n - 0.8 n + 1 of each.
    Shingles of one text alone come first in the order; they are counted, not sorted.
    """
    rows = checkpointed(sets.join(apart, "key").select("key", "component", "s", F.size("s").alias("n"), _parities("s").alias("odd")))
    tokens = rows.select("key", F.explode("s").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    own = Window.partitionBy("key")
    ordered = tokens.join(counts, "token").withColumns({"shared": F.count("*").over(own), "nth": F.row_number().over(own.orderBy("c", "token"))})
    first = ordered.join(rows.drop("s"), "key").withColumn("at", F.col("n") - F.col("shared") + F.col("nth") - 1).filter(F.col("at") <= (F.col("n") / 5).cast("int"))
    known, other = _both(checkpointed(first.select("key", "component", "n", "at", "token", "odd")))
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    room = _may_be_close(F.col("x_n"), F.col("y_n")) & (9 * left >= 4 * (F.col("x_n") + F.col("y_n")))
    room = room & _parities_allow(F.col("x_n"), F.col("x_odd"), F.col("y_n"), F.col("y_odd"))
    met = known.join(other, (F.col("x_token") == F.col("y_token")) & (F.col("x_key") < F.col("y_key")) & (F.col("x_component") != F.col("y_component")) & room)
    return met.select(F.col("x_key").alias("a"), F.col("y_key").alias("b")).distinct()


def linked(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, component for the ``key``s of ``nodes`` (one row a text of ``docs``: key, digest, fp, n shingles, bands, odd) that have links."""
    members = nodes.select("key", "n", F.explode("bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    members = checkpointed(members.join(crowded, "band"))
    first = [F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("h"), F.col("key").alias("lead"), F.col("n").alias("lead_n"))) for i in range(LEADERS)]
    leads = members.groupBy("band").agg(F.array(*first).alias("leads"))
    # Pairs without a leader are left where two texts or more lead nothing.
    open_ = F.col("c") > F.size(F.array_distinct(F.transform("leads", lambda x: x["lead"]))) + 1
    members = checkpointed(members.join(leads, "band").select("key", "n", "band", "leads", open_.alias("open")))
    met = members.select("key", "n", F.explode("leads").alias("l")).select("key", "n", "l.lead", "l.lead_n").filter("key <> lead").filter(_may_be_close(F.col("n"), F.col("lead_n")))
    met = checkpointed(_possible(met.select(*_pair("key", "lead")).distinct(), nodes))
    needed = met.select(F.explode(F.array("a", "b")).alias("key")).union(members.filter("open").select("key")).distinct()
    sets = _sets_of(nodes.select("key", "digest").join(needed, "key"), docs)
    near = _checked(met, sets)
    # op5's links: equal fingerprints through their smallest key, others by anchors.
    same = checkpointed(packed(nodes.groupBy("fp").agg(F.min("key").alias("node")), nodes.count()))
    alike = nodes.join(same, "fp").filter("key <> node").select(F.col("key").alias("a"), F.col("node").alias("b"))
    known = checkpointed(near.union(alike).union(simhash.links(same)))
    found = components(known)

    placed = members.filter("open").select("key", "band").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band")
    apart = placed.join(mixed, "band", "left_semi").select("key", "component").distinct()
    more = checkpointed(_checked(_rare_meetings(apart, sets), sets))
    # Components so far are stars: they stand for the links that they come from.
    return found if more.isEmpty() else components(more.union(found))


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, one without id only where no row has one.

    Texts without words (null too) are one group.  Of a group's rows of its smallest id the one of the smallest SHA-256
    stays; of rows of one id and one text that whose other columns, as JSON, come first: the same one whatever the
    partitions.  Rows of one id whose texts are no near copies all stay.  Very long texts are read whole.  Extra columns
    are kept, whatever their names.  An empty table gives an empty table.
    """
    read = checkpointed(docs.select("doc_id", _digest().alias("digest"), _read("text").alias("r")).select("doc_id", "digest", "r.*"))
    count = read.count()
    # Texts are told apart by their digests, and numbered once, so that what follows compares short numbers.
    one = read.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("fp", "n", "bands", "odd")])
    nodes = checkpointed(packed(one, count).withColumn("key", F.monotonically_increasing_id()))
    placed = nodes.select("key", "digest").join(linked(nodes, docs).select(F.col("node").alias("key"), "component"), "key", "left").select("digest", F.coalesce("component", "key").alias("component"))
    rows = checkpointed(packed(read.groupBy("digest", "doc_id").count().join(packed(placed, count), "digest"), count))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best"))
    first = F.col("digest").eqNullSafe(F.col("best.digest")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    digest, named = private("digest", docs), private("id", docs)
    these = lambda which: which.select(F.col("digest").alias(digest), F.col("doc_id").alias(named))
    same = (_digest() == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(named))
    judged = rows.join(best, "component").withColumn("first", first)
    rest = docs.join(_few(checkpointed(these(judged.filter("not first")))), same, "left_anti")
    repeated = these(checkpointed(judged.filter("first and count > 1").select("digest", "doc_id")))
    if repeated.isEmpty():
        return rest
    # Only rows that repeat meet in a shuffle, one of each stays; for a group's many copies the first is found map-side.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "doc_id")], F.col("text").isNull()))
    many = rest.join(repeated, same, "left_semi").withColumn(digest, _digest()).groupBy(digest, "doc_id").agg(F.min_by(F.struct(*columns), order).alias(named))
    return rest.join(repeated, same, "left_anti").unionByName(many.select(*[F.col(named).getField(c).alias(c) for c in docs.columns]))
