"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits; each is 1 if it is set in over half of the XXH64 values (seed 42) of a text's 3-word shingles.

Search: two fingerprints that differ in at most 2 bits differ in at most 1 bit in one of their two 32-bit halves.  The
anchors of a half are the words of the Hamming code of length 31 (any value of the remaining bit): every half lies
within 1 bit of exactly one anchor, its home.  A half that differs from it by one bit lies within 1 + 1 bits of that
home.  So each fingerprint goes, for each half, to its home and to all anchors within 2 bits (17 at most), and is
compared, per anchor, with those at home there.  Every link is found, and exactly once: from the smaller of its two
fingerprints, in the first half if that differs by at most one bit.

Equal fingerprints are one node, so copies are never paired.  Components run over fingerprints, whether or not a row with
that one has an id; a component then gets the smallest id of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracklake.llm.common import checkpointed
from tracklake.llm.components import components

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
CODE_LENGTH = 31


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, unsigned.  No words: 0.  Fewer words than a shingle: the whole sequence is one."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # lower() changes A-Z alone; split() knows ASCII white space alone
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints as signed 64-bit numbers."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


def _half(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _syndrome(half: Column) -> Column:
    """0 for a word of the code; else the number (1 to 31) of the bit whose flip gives one.  Bit i of a half has the number i + 1; the last bit is free."""
    out = F.lit(0)
    for check in range(5):
        mask = sum(1 << i for i in range(CODE_LENGTH) if (i + 1) >> check & 1)
        out = out + (F.bit_count(half.bitwiseAND(F.lit(mask))) % 2) * (1 << check)
    return out


def _flip(half: Column, number: Column) -> Column:
    """The half with the bit of this number flipped; number 0 flips none."""
    return F.when(number > 0, half.bitwiseXOR(_bit(number))).otherwise(half)


def _bit(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << i) for i in range(CODE_LENGTH + 1)]), F.greatest(number, F.lit(1)))


def anchors_near(half: Column) -> Column:
    """All anchors within 2 bits of a half.

    A word of the code is the only one within 2 bits with its own last bit; with the last bit flipped it is 1 bit away.
    Any other half has its home at 1 bit, that home with the last bit flipped at 2 bits, and 15 more at 2 bits: for each
    pair of numbers i, j with i xor j = syndrome.
    """
    last = F.lit(1 << CODE_LENGTH)
    syndrome = _syndrome(half)
    home = _flip(half, syndrome)
    pairs = F.filter(F.sequence(F.lit(1), F.lit(CODE_LENGTH)), lambda i: (syndrome > 0) & (i < i.bitwiseXOR(syndrome)) & (i.bitwiseXOR(syndrome) > 0))
    others = F.transform(pairs, lambda i: half.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(syndrome))))
    return F.concat(F.array(home, home.bitwiseXOR(last)), others)


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``node`` whose fingerprints ``fp`` (distinct) differ in 1 or 2 bits; each pair once."""
    at_home, replicas = [], []
    for which in (0, 1):
        half = _half(F.col("fp"), which)
        near = nodes.withColumn("half", half)
        at_home.append(near.select(F.lit(which).alias("which"), _flip(F.col("half"), _syndrome(F.col("half"))).alias("anchor"), F.col("fp").alias("fp_a"), F.col("node").alias("a")))
        replicas.append(near.select(F.lit(which).alias("r_which"), F.explode(anchors_near(F.col("half"))).alias("r_anchor"), F.col("fp").alias("fp_b"), F.col("node").alias("b")))
    differ = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    first_half = F.bit_count(_half(F.col("fp_a").bitwiseXOR(F.col("fp_b")), 0))
    # In the second half only if the first one differs by 2 or more: else the first has found the pair.
    once = (F.col("fp_a") < F.col("fp_b")) & ((F.col("which") == 0) & (first_half <= 1) | (F.col("which") == 1) & (first_half > 1))
    same = (F.col("which") == F.col("r_which")) & (F.col("anchor") == F.col("r_anchor")) & once & (differ <= MAX_DISTANCE)
    return at_home[0].union(at_home[1]).join(replicas[0].union(replicas[1]), same).select("a", "b")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", fingerprints("text").alias("fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row of ``docs``.

    Texts without words (null too) have fingerprint 0 and are linked like any other; very long texts are read whole.
    Rows may repeat.  A row without doc_id takes part by its fingerprint, links through it hold, and it gets its
    component's smallest id; where no row of a component has an id, component_id is null.  An empty table gives an empty
    table.  Extra columns are ignored, whatever their names.
    """
    marked = checkpointed(with_fingerprints(docs))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes.select("fp", F.col("fp").alias("node"))))
    # Of the fingerprints, only those with links have a row in ``found``.
    placed = nodes.join(found, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), "first", F.coalesce("component", "fp").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "component").select("_fp", "component_id")
    return marked.join(named, F.col("fp") == F.col("_fp"), "left").drop("_fp")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

