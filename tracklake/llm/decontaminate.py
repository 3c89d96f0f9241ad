"""Benchmark decontamination by exact n-gram windows.

The windows of the benchmark's items form a set that is broadcast as a hash
table when it is small enough (its size is counted first; beyond
``MAX_BROADCAST_WINDOWS`` the same join is left to a shuffle).  Every position
of every document is one probe: the hash of the window that starts there.  A
hit counts only if the window's words are the same.  Only hits leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import numbered, private

WINDOW = 10
MAX_BROADCAST_WINDOWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The same for text in its own case, where A-Z are word characters.
CASED_SEPARATOR = SEPARATOR.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")


def words(text: Column) -> Column:
    """The lower-cased words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"[{SEPARATOR}]+"), "")


def _hashes(words_column: str) -> Column:
    return F.transform(words_column, lambda w: F.xxhash64(w))


def _window_text(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, length), " ")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """hash, text, length and sorted item_ids of every distinct window of the items."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).withColumn("hashes", _hashes("words"))
    items = items.withColumn("win_len", F.least(F.size("words"), F.lit(WINDOW))).filter("win_len > 0")
    starts = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("win_len"))))
    windows = starts.select(
        F.xxhash64(F.slice("hashes", F.col("at") + 1, F.col("win_len"))).alias("win_hash"),
        _window_text(F.col("at"), F.col("win_len")).alias("win_text"),
        "win_len",
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
    )
    return windows.groupBy("win_hash", "win_text", "win_len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, hits (array of start and length in words), items and copies, for every distinct (doc_id, text).

    Items without words have no windows.  Equal windows of several items count for each of them.  A null text has no
    words, a null doc_id is an id of its own.  An empty benchmark leaves every document clean.
    """
    windows = benchmark_windows(benchmark)
    known = windows.agg(F.count("*").alias("n"), F.collect_set("win_len").alias("lengths")).first()
    lengths = sorted(known["lengths"] or []) or [WINDOW]
    small = known["n"] <= MAX_BROADCAST_WINDOWS
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    # The number of words goes with a row, so that the words end where hits are compared: the aggregation keeps its rows, and would keep all documents.
    base = base.withColumns({"hashes": _hashes("words"), "n_words": F.size("words").cast("long")})
    last = F.greatest(F.lit(-1), F.size("words") - lengths[0])
    probes = base.withColumn("at", F.explode(F.sequence(F.lit(-1), last)))  # -1 keeps the document itself
    if len(lengths) > 1:
        probes = probes.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths])))
        fits = (F.col("at") >= 0) & (F.col("at") + F.col("length") <= F.size("words"))
        probes = probes.filter(fits | ((F.col("at") < 0) & (F.col("length") == lengths[0])))
    else:
        probes = probes.withColumn("length", F.lit(lengths[0]))
    window = F.slice("hashes", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("length"))
    probes = probes.withColumn("probe", F.when(F.col("at") >= 0, F.xxhash64(window)))
    same = (F.col("probe") == F.col("win_hash")) & (F.col("length") == F.col("win_len"))
    if not small:
        return _contamination_by_shuffle(base, probes.filter("at >= 0").select("doc_id", "text_hash", "at", "length", "probe").join(windows, same))
    found = probes.join(F.broadcast(windows), same, "left")
    # Compared after the join, so that the words are put together for the few equal hashes only.
    verified = F.when(F.col("win_text").isNotNull(), _window_text(F.col("at"), F.col("length")) == F.col("win_text"))
    hits = found.filter((F.col("at") < 0) | F.coalesce(verified, F.lit(False)))
    one = F.col("win_text").isNotNull()
    return hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(one, F.struct(F.col("at").alias("start"), "length")))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(one, F.col("items")))))).alias("items"),
        F.count_if(F.col("at") < 0).cast("long").alias("copies"),
    )


def _contamination_by_shuffle(base: DataFrame, equal_hashes: DataFrame) -> DataFrame:
    """As ``contamination``, where the windows are too many to broadcast: probes are shuffled without their documents, and equal hashes are compared where the documents are."""
    hit = F.struct(F.col("at").alias("start"), "length", "win_text", "items")
    maybe = equal_hashes.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(hit).alias("maybe"))
    rows = base.select("doc_id", "text_hash", "words").join(maybe, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    true = F.filter(F.coalesce("maybe", F.array().cast(maybe.schema["maybe"].dataType)), lambda h: _window_text(h["start"], h["length"]) == h["win_text"])
    slim = rows.withColumn("true", true).select(
        "doc_id",
        "text_hash",
        F.size("words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.transform("true", lambda h: F.struct(h["start"].alias("start"), h["length"].alias("length"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("true", lambda h: h["items"])))).alias("items"),
    )
    return slim.groupBy("doc_id", "text_hash", "n_words", "hits", "items").agg(F.count("*").alias("copies"))


def words_hit(hits: str = "hits") -> Column:
    """Number of words in the union of the sorted hits."""
    step = lambda acc, h: F.struct(
        F.greatest(acc["upto"], h["start"] + h["length"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0), h["start"] + h["length"] - F.greatest(acc["upto"], h["start"]))).alias("n"),
    )
    return F.aggregate(hits, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), step, lambda acc: acc["n"]).cast("long")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every row of ``docs``, repeated ones too: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Texts are read whole, however long.  Extra columns of both tables are ignored, whatever their names.  An empty table
    gives an empty table.
    """
    rows = numbered(contamination(docs, benchmark).withColumn("n_hit", words_hit()), "copies", "copy")
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents") -> DataFrame:
    """``docs`` without the contaminated documents, or (mode ``spans``) without the words that were hit and what stands before each of them.

    Extra columns stay, whatever their names.  Repeated rows are treated alike.  Very long texts are read whole.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    id_, hash_, hits_ = (private(n, docs) for n in ("id", "hash", "hits"))
    dirty = contamination(docs, benchmark).filter(F.size("hits") > 0).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("hits").alias(hits_))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_))
    if mode == "documents":
        return docs.join(dirty, same, "left_anti")
    pieces = F.split("text", f"(?<=[^{CASED_SEPARATOR}])(?=[{CASED_SEPARATOR}])")  # each ends with a word, but what follows the last word
    left = F.array_join(F.filter(pieces, lambda p, i: ~F.exists(hits_, lambda h: (h["start"] <= i) & (i < h["start"] + h["length"]))), "")
    text = F.when(F.col(hits_).isNull(), F.col("text")).otherwise(left)
    return docs.join(dirty, same, "left").withColumn("text", text).select(*docs.columns)


