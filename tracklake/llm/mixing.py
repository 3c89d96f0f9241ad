"""Mixing sources to target weights with exact word budgets.

Targets: the sources share ``share`` times all words by weight; a source never
gets more than ``cap`` times its own words, and what it cannot take goes to the
others by weight.  With ``r = cap * size / weight``, the sources in ascending
order of ``r`` are full up to some point and from there on get
``level * weight``, so one pass over the (small) table of sources in that order
gives the fixed point of the repeated resharing.

Taking: every document has a hash-random key.  Within a source the key range is
cut into buckets, one for each ``ROWS_PER_BUCKET`` documents.  Words are summed
by bucket, the buckets' sums are summed along the key range, and a window in
each bucket completes the running sum: no task holds a whole source.  A source's
budget is its whole epochs and a rest; a document gets all of its words in each
whole epoch and, in the last one, the words that lie before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import SPACE, checkpointed, numbered, private, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
ROWS_PER_BUCKET = 256
MAX_BUCKETS = 1 << 14
SEED = "mix-1"


def row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row, every column of it."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, random key and hashes of every distinct row, with the number n of its occurrences; a null text has no words.

    The key comes from the id and the text, so rows without id are spread like any others; equal rows are counted before
    they meet, so a row that occurs very often is one row from there on.
    """
    text = text_or_empty()
    key = F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    each = docs.select(
        "doc_id",
        "source",
        F.size(F.array_remove(F.split(text, SPACE), "")).cast("long").alias("size"),
        F.sha2(key, 256).alias("mix_key"),
        row_hash(docs).alias("row_hash"),
    )
    return each.groupBy(*each.columns).agg(F.count("*").alias("n"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row a source: source_size, rows, target.  Null is a source of its own, the last in order."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("source_rows"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = sources.withColumn("weight", F.element_at(weights, (F.row_number().over(ordered) - 1) % len(WEIGHTS) + 1))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    steps = (
        weighed.withColumn("budget_all", SHARE * F.sum("source_size").over(everything))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full_before", CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget_all") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("full", CAP * F.col("source_size") <= F.col("level") * F.col("weight"))
        .withColumn("rest_level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("full"), CAP * F.col("source_size")).otherwise(F.col("rest_level") * F.col("weight"))
    return steps.select("source", "source_size", "source_rows", target.cast("double").alias("target"))


def _decided(docs: DataFrame) -> DataFrame:
    """Every distinct row with source_size, target, epochs (whole ones) and rest (words that it may take in the last one, over all its occurrences)."""
    sizes = checkpointed(word_sizes(docs))
    targets = source_targets(sizes)
    wanted = F.least(F.lit(MAX_BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("source_rows") / ROWS_PER_BUCKET))).cast("long")
    place = (F.conv(F.substring("mix_key", 1, 6), 16, 10).cast("long") * F.col("n_buckets") / F.lit(1 << 24)).cast("long")
    by_source = targets.withColumn("n_buckets", wanted)
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    placed = sizes.alias("s").join(by_source.alias("t"), same).select("s.*", "source_size", "target", "n_buckets").withColumn("bucket", place).withColumn("words", F.col("size") * F.col("n"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("words").alias("bucket_size"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("bucket_size").over(along), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("mix_key", "doc_id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("upto", F.sum("words").over(inside))
    joined = summed.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    start = F.col("bucket_start") + F.col("upto") - F.col("words")
    rest = F.greatest(F.lit(0), F.least(F.col("words"), budget - epochs * F.col("source_size") - start))
    return joined.select("doc_id", "source", "row_hash", "size", "n", "source_size", "target", epochs.cast("long").alias("epochs"), rest.cast("long").alias("rest"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) for every row.

    Repeated rows are counted as often as they occur, and the words of a budget's end go to the first of them.  Ties of
    the key are broken by doc_id, size and the whole row.  Sources without words have target 0.  An empty table gives an
    empty table.  Very long texts are read whole.
    """
    each = numbered(_decided(docs), "n", "nth")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("nth") * F.col("size")))
    return each.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated for each whole epoch; the document in which a budget ends also once cut after its last taken word.

    Extra columns stay, whatever their names.  Rows that are equal in every column are put out as often as all of them together are taken.
    """
    hash_, id_, n_, whole_, part_, row_, nth_ = (private(c, docs) for c in ("hash", "id", "n", "whole", "part", "row", "nth"))
    some = F.col("size") > 0
    whole = F.when(some, F.col("n") * F.col("epochs") + F.floor(F.col("rest") / F.col("size"))).otherwise(0)
    part = F.when(some, F.col("rest") % F.col("size")).otherwise(0)
    decisions = checkpointed(_decided(docs).select(F.col("row_hash").alias(hash_), F.col("doc_id").alias(id_), F.col("n").alias(n_), whole.cast("long").alias(whole_), part.cast("int").alias(part_)).filter(f"{whole_} > 0 OR {part_} > 0"))
    same = (row_hash(docs) == F.col(hash_)) & F.col("doc_id").eqNullSafe(F.col(id_))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    taken = docs.join(decisions.filter(f"{n_} = 1"), same).drop(n_, hash_, id_)
    many = decisions.filter(f"{n_} > 1")
    if not many.isEmpty():  # equal rows become one, map-side first, and then as many as are taken
        first = docs.join(many, same).groupBy(hash_, id_, whole_, part_).agg(F.first(F.struct(*columns)).alias(row_))
        rows = first.select(*[F.col(row_).getField(c).alias(c) for c in docs.columns], whole_, part_)
        taken = taken.unionByName(rows)
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each ends with a word
    whole_rows = numbered(taken, whole_, nth_).select(*columns)
    cut = taken.filter(F.col(part_) > 0).withColumn("text", F.array_join(F.slice(pieces, 1, F.col(part_)), "")).select(*columns)
    return whole_rows.unionByName(cut)
