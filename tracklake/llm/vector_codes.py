"""Product codes of vectors in whole numbers: each part of a vector becomes the index of its nearest codebook entry.

Components become ``floor(256 x)``, so that distances are whole numbers and every engine finds the same codes.  The
nearest entry is screened by one float32 matrix product a part.  What float32 may have lost is bounded: for numbers of
dimension d, |computed - exact| <= g |x| |c| with g = (d + 2) u / (1 - (d + 2) u), u = 2^-24, however the product is
summed (conversion of both factors included).  Every entry whose interval reaches below the least upper end is evaluated
again in int64; the smallest distance wins, of equal ones the lower index.

Codebooks are fitted on all vectors: tasks send sums and counts by part and entry (``parts * entries`` rows a task at
most), Spark adds them, and the driver gets the ``parts * entries`` totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tracklake.llm.common import checkpointed, private

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components stay below this as whole numbers, so that int64 holds all distances and float32 all products.
MOST = 1 << 27
#: Vectors that are compared at a time.
BLOCK = 4096
#: Sums of errors by label are broadcast up to so many labels of fixed width; beyond, Spark deals the join out.
BROADCAST_LABELS = 100_000
_U = 2.0**-24


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest of ``entries`` for each row of ``x`` (both int64), and how many distances were evaluated again."""
    d = x.shape[1]
    gamma = (d + 2) * _U / (1 - (d + 2) * _U)
    dot = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    squares = (entries * entries).sum(axis=1).astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1).astype(np.float64))[:, None] * np.sqrt(squares)[None]
    score = squares[None] - 2 * dot  # the distance without |x|^2, the same for all entries
    slack = 2 * gamma * norms * (1 + 2.0**-40) + 2.0**-48 * (squares[None] + 2 * np.abs(dot))
    open_ = score - slack <= (score + slack).min(axis=1, keepdims=True)
    index = open_.argmax(axis=1)
    row, entry = np.nonzero(open_ & (open_.sum(axis=1) > 1)[:, None])
    if len(row):
        exact = ((x[row] - entries[entry]) ** 2).sum(axis=1)
        best = np.lexsort((entry, exact, row))
        first = np.concatenate(([True], row[best][1:] != row[best][:-1]))
        index[row[best][first]] = entry[best][first]
    return index, ((x - entries[index]) ** 2).sum(axis=1), len(row)


def whole_numbers(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(SCALE * x) of an Arrow list array without nulls."""
    lengths = np.diff(np.asarray(vectors.offsets))
    if (lengths != dim).any():
        raise ValueError(f"vectors must all have {dim} components")
    scaled = np.floor(np.asarray(vectors.flatten()).astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= MOST:
        raise ValueError(f"components times {SCALE} must stay below {MOST}")
    return scaled.astype(np.int64).reshape(len(vectors), dim)


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position]: whole numbers.  No entries where there were no vectors."""

    entries: np.ndarray

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every row's parts."""
        width = self.entries.shape[2]
        index, error = (np.empty((len(rows), len(self.entries)), np.int64) for _ in range(2))
        for at in range(0, len(rows), BLOCK):
            for p, own in enumerate(self.entries):
                index[at : at + BLOCK, p], error[at : at + BLOCK, p], _ = nearest(rows[at : at + BLOCK, p * width : (p + 1) * width], own)
        return index, error

    def sha256(self) -> str:
        """Digest of all entries' decimal components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is no null and holds neither nulls nor numbers that are not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.filter(F.col(column).isNotNull() & ~F.exists(column, bad))


def _first_entries(vectors: DataFrame, column: str, key: str, parts: int, entries: int) -> np.ndarray:
    rows = vectors.filter(F.col(key).isNotNull()).select(key, column).orderBy(key, column).limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    dim = len(rows[0][1])
    if dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")
    own = whole_numbers(pa.array([r[1] for r in rows], pa.list_(pa.float64())), dim)
    return own.reshape(len(rows), parts, dim // parts).transpose(1, 0, 2).copy()


def _sums(vectors: DataFrame, column: str, books: Codebooks) -> DataFrame:
    """part, entry, n and sums (componentwise) of the parts that are nearest to an entry; a row a task, part and used entry."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = StructType([StructField("part", LongType()), StructField("entry", LongType()), StructField("n", LongType()), StructField("sums", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        parts, k, width = own.entries.shape
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            rows = whole_numbers(batch.column(0), own.dim)
            index, _ = own.assign(rows)
            for p in range(parts):
                n[p] += np.bincount(index[:, p], minlength=k)
                np.add.at(sums[p], index[:, p], rows[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"]
        )

    return vectors.select(column).mapInArrow(run, schema)


def fit(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of usable ``vectors``: they start as the parts of the rows of the smallest keys (then vectors; rows without key are none of them).

    Each round assigns all parts and replaces every used entry by floor(sum / count).  At most ``entries`` of 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    books = Codebooks(_first_entries(vectors, column, key, parts, entries))
    for _ in range(rounds if books.dim else 0):
        width, moved = books.entries.shape[2], books.entries.copy()
        totals = _sums(vectors, column, books).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        for r in totals.collect():  # parts * entries rows at most
            moved[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        books = Codebooks(moved)
    return books


def encoded(vectors: DataFrame, books: Codebooks, column: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """Usable ``vectors`` with a code (two hex digits a part) and its error in place of the vector; other columns stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    names = [c for c in vectors.columns if c not in (column, code, error)]
    rows = vectors.select(*names, column)
    schema = StructType([*(f for f in rows.schema if f.name != column), StructField(code, StringType()), StructField(error, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if own.dim:
                index, errors = own.assign(whole_numbers(batch.column(len(names)), own.dim))
                codes = [r.tobytes().hex() for r in index.astype(np.uint8)]
                errors = errors.sum(axis=1)
            else:  # no row with a key: nothing to be near to
                codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def decoded(codes: DataFrame, books: Codebooks, code: str = "code", column: str = "decoded") -> DataFrame:
    """``codes`` with the vector that each code stands for (entries / SCALE); null for a null code."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value.entries / SCALE
        parts = np.arange(len(own))
        for batch in batches:
            yield pd.Series([None if c is None else own[parts, np.frombuffer(bytes.fromhex(c), np.uint8)].ravel() for c in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return codes.withColumn(column, F.pandas_udf(run, ArrayType(DoubleType()))(code))


def _with_totals(rows: DataFrame, label: str, error: str, total: str) -> DataFrame:
    """``rows`` with the sum of errors over their label; nulls are one label."""
    key = private("label", rows)
    totals = checkpointed(rows.groupBy(F.col(label).alias(key)).agg(F.sum(error).alias(total)))
    fixed_width = dict(rows.dtypes)[label] in ("tinyint", "smallint", "int", "bigint", "boolean", "date")
    if fixed_width and totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    return rows.join(totals, rows[label].eqNullSafe(F.col(key)), "left").drop(key)


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of ``vectors`` (vec_id, embedding, label).

    Repeated rows give repeated rows and count as often; a row without vec_id is coded, but starts no entry (code and
    error are null where no row has one).  Fewer usable rows than entries give fewer entries.  Vectors of unequal lengths, of a length that parts do
    not divide, or with components of MOST / SCALE and more are an error.  An empty table gives an empty table.  Extra
    columns are ignored.
    """
    rows = usable(vectors.select("vec_id", "embedding", "label"))
    books = fit(rows)
    coded = checkpointed(encoded(rows, books))
    return _with_totals(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
