r"""How filters overlap: which of five quality filters removes what, in every order in which they can be applied.

A document's failures are five bits.  Four come from its text alone, read from Arrow's buffers by NumPy: byte classes by
a table of 256 entries, and prefix sums over them, give words, capitals, symbols and code points of all texts of a batch
at once.  Distinct words come from hashes of 48 bits, sorted within each document; neighbours of equal hash are verified
byte by byte, and a document in which two unlike words share a hash is counted from its words themselves.  The fifth bit,
an exact copy of a smaller id's text, is found by SHA-256 digests over the whole table.

Documents are then only counted by part and bits (32 numbers a part): every order and step is a sum over those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracklake.llm.common import checkpointed, text_or_empty

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
#: Bytes of text that are scanned at a time; a longer text is scanned alone.
SLICE = 1 << 21
#: Longer words are hashed one by one.
LONG_WORD = 64

_SPACE, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] |= _SPACE
    table[ord("A") : ord("Z") + 1] |= _CAPITAL
    table[list(SYMBOLS)] |= _SYMBOL
    table[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT  # not a continuation byte: a code point begins
    return table


CLASSES = _classes()


def _sums(flags: np.ndarray) -> np.ndarray:
    """Prefix sums with a zero in front."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _chunk(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next 8 bytes of words as numbers, zeros behind a word's end."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))[at]
    return eight & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))))


def word_hashes(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash for each word; 8 zero bytes stand behind the buffer's text."""
    factor, out = np.uint64(0x9E3779B97F4A7C15), lengths.astype(np.uint64)
    active = np.arange(len(starts))
    for at in range(0, LONG_WORD, 8):
        if at:
            active = active[lengths[active] > at]
        if not len(active):
            break
        own = (out[active] ^ _chunk(padded, starts[active] + at, lengths[active] - at)) * factor
        out[active] = own ^ (own >> np.uint64(29))
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = np.uint64(hash(padded[starts[i] : starts[i] + lengths[i]].tobytes()) & 0xFFFFFFFFFFFFFFFF)
    return out * factor


def same_words(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] are equal byte by byte."""
    out = lengths[a] == lengths[b]
    active = np.flatnonzero(out)
    for at in range(0, LONG_WORD, 8):
        if at:
            active = active[lengths[a[active]] > at]
        if not len(active):
            break
        x, y = a[active], b[active]
        out[active] = alike = _chunk(padded, starts[x] + at, lengths[x] - at) == _chunk(padded, starts[y] + at, lengths[y] - at)
        active = active[alike]
    for i in active[lengths[a[active]] > LONG_WORD] if len(active) else ():
        n = lengths[a[i]]
        out[i] = np.array_equal(padded[starts[a[i]] : starts[a[i]] + n], padded[starts[b[i]] : starts[b[i]] + n])
    return out


def measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of the texts ``data[bounds[i]:bounds[i + 1]]`` (UTF-8)."""
    first, last = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    padded = np.concatenate((data[bounds[0] : bounds[-1]], np.zeros(8, np.uint8)))
    classes = CLASSES[padded[:-8]]
    count = lambda bit: (s := _sums(classes & bit != 0))[last] - s[first]
    inside = classes & _SPACE == 0
    edge = np.zeros(len(inside) + 1, bool)  # a text's words end with it
    edge[first] = edge[last] = True
    begins = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1])))
    ends = inside & (edge[1:] | np.concatenate((~inside[1:], [True])))
    sums = _sums(begins)
    n_words = sums[last] - sums[first]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    doc = np.repeat(np.arange(len(first)), n_words)
    key = (doc.astype(np.uint64) << np.uint64(48)) | (word_hashes(padded, starts, lengths) >> np.uint64(16))
    order = np.argsort(key, kind="stable")
    equal = np.flatnonzero(key[order][1:] == key[order][:-1])
    n_distinct = n_words - np.bincount(doc[order[equal]], minlength=len(first))
    unlike = equal[~same_words(padded, starts, lengths, order[equal], order[equal + 1])]
    for i in np.unique(doc[order[unlike]]):
        n_distinct[i] = len(set(padded[first[i] : last[i]].tobytes().split()))
    return {"words": n_words, "distinct": n_distinct, "capitals": count(_CAPITAL), "symbols": count(_SYMBOL), "points": count(_POINT)}


def failures(texts: pa.Array) -> np.ndarray:
    """The bits of the filters A to D of each text; null is empty.  UTF-8 is read where Arrow holds it."""
    if not len(texts):
        return np.zeros(0, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.fill_null("").buffers() if texts.null_count else texts.buffers()
    at = 0 if texts.null_count else texts.offset
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    out, i = np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1)
        j = min(j, i + 0xFFFF, len(texts))  # 16 bits number the texts of a slice
        m = measure(data, bounds[i : j + 1])
        failed = (m["words"] < MIN_WORDS, 100 * m["distinct"] < DISTINCT_PERCENT * m["words"], 100 * m["capitals"] > CAPITAL_PERCENT * m["points"], m["symbols"] > 0)
        out[i:j] = sum(f.astype(np.int64) << k for k, f in enumerate(failed))
        i = j
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(failures(batch.column("text")))], [*(n for n, _ in rest), "failed"])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, part (source; null: empty), digest (SHA-256 of the text) and failed (bits of A to D) of every row."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    kept = [f for f in rows.schema if f.name != "text"]
    return rows.mapInArrow(_scan, StructType([*kept, StructField("failed", LongType())]))


def with_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and failed (bits of A to E) of every row of ``docs`` (doc_id, text, source).

    Digests with several ids are few; their smallest ids meet the rows in a join whose large groups Spark may split.
    """
    rows = checkpointed(scanned(docs))
    copied = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last")).select(F.col("digest").alias("copied"), "first")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(copied, F.col("digest") == F.col("copied"), "left").select("doc_id", "part", (F.col("failed") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("failed"))


def counted(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and n, good and toxic as arrays of 32: documents by their failures.  An id with several labels is good if one says so, and so for toxic."""
    named = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    rows = failed.join(named, F.col("doc_id") == F.col("labelled"), "left")
    groups = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum(F.coalesce("is_good", F.lit(0))).alias("good"), F.sum(F.coalesce("is_toxic", F.lit(0))).alias("toxic"))
    by_bits = lambda c: F.array(*[F.sum(F.when(F.col("failed") == i, F.col(c)).otherwise(0)) for i in range(1 << len(FILTERS))]).alias(c)
    return groups.groupBy("part").agg(by_bits("n"), by_bits("good"), by_bits("toxic"))


def _sum_where(counts: str, holds) -> Column:
    """Sum of the counts whose bits satisfy ``holds``."""
    return F.aggregate(F.transform(F.col(counts), lambda n, i: F.when(holds(i), n).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step with counts of kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    Null texts are empty; a null source is the part "".  Repeated rows count as often as they stand; rows of one id are
    no copies of each other, as neither id is smaller.  A row without doc_id fails E never, makes no row fail it, and has
    no labels.  Very long texts are read whole.  An empty table gives an empty table; extra columns are ignored.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
    rows = counted(with_failures(docs), labels).withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1))))
    rows = rows.withColumn("earlier", F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit(F.substring(F.col("filter_order"), i, F.lit(1)))).otherwise(0)))
    own, earlier = F.col("own"), F.col("earlier")
    fails = lambda i: i.bitwiseAND(own) != 0
    gone = lambda i: i.bitwiseAND(earlier) != 0
    here = lambda i: fails(i) & ~gone(i)
    # A filter removes a document in those orders in which it comes first of all that the document fails.
    shares = F.transform("n", lambda n, i: F.when(fails(i), n * (F.lit(len(orders)) / F.bit_count(i)).cast("long")).otherwise(0))
    return rows.select(
        "part",
        "filter_order",
        "step",
        _sum_where("n", lambda i: ~fails(i) & ~gone(i)).alias("kept"),
        _sum_where("n", here).alias("removed"),
        _sum_where("n", lambda i: fails(i) & gone(i)).alias("redundant"),
        _sum_where("n", lambda i: i == own).alias("unique_fails"),
        _sum_where("good", here).alias("good_lost"),
        _sum_where("toxic", here).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )
