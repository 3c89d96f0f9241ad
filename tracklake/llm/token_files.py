"""Token ids in binary files, each id in as few bits as the vocabulary needs.

A file holds the documents of one range of ids, in order.  Its layout, all numbers little-endian:

- 16 bytes: the magic ``TRACKID1``, bits an id (uint32), ids a block (uint32);
- blocks of equally many ids (the last may hold fewer).  A block is a bit string: id i takes the bits from i * width on,
  lowest first.  Each begins at a byte, so any block can be unpacked alone, 8 ids (width bytes) a row of a numpy matrix;
- the documents: an Arrow stream of record batches with doc_id and n (its ids);
- the block offsets (uint64 each) and CRC-32s (uint32 each);
- 48 bytes: position of the documents and of the offsets, number of blocks, of ids and of documents (uint64), the magic.

Texts are encoded where they are read; ids alone (16 or 32 bits each) are shuffled, to ranges of (doc_id, hash of the
text) that a sample of these balances by bytes, and sorted there.  Rows that are equal in both, however many, are spread
over all ranges that end with them.  A task writes one file under a name of its own and moves it into place when it is
whole: one that is repeated writes the same file.  Files are read
and written through pyarrow's file systems, in a folder that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tracklake.llm.common import checkpointed, removed, shared_folder, text_or_empty

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 1
MAGIC = b"TRACKID1"
BLOCK_IDS = 1 << 16
#: A file's bytes and documents, about.
FILE_BYTES, FILE_DOCS = 128 << 20, 4_000_000
#: Bytes of text an id, as a guess of the files' number; bytes that a row counts beside its text; rows sampled for a range of ids.
BYTES_AN_ID, OVERHEAD, PER_RANGE = 4, 16, 40
#: Bytes of text that are encoded at a time; a longer text is encoded alone.
SLICE = 1 << 22
#: Word pieces that a worker keeps with their ids, and pieces that are encoded as one text.
MOST_KNOWN, JOINED = 400_000, 20_000
#: A run of letters that no normalisation joins with what follows, and the signs behind it.
_SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<signs>[!-/:-@\[-`{-~]*)$"


# ---- bits -----------------------------------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """The ids as a bit string of ``bits`` each, lowest bit first, padded to a whole byte."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    rows = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    rows.ravel()[: len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint8)  # 8 ids take ``bits`` bytes
    for k in range(8):
        for byte in range(k * bits // 8, ((k + 1) * bits + 7) // 8):
            shift = 8 * byte - k * bits
            part = rows[:, k] >> np.uint64(shift) if shift >= 0 else rows[:, k] << np.uint64(-shift)
            out[:, byte] |= (part & np.uint64(0xFF)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids (uint32) of a bit string."""
    rows = np.zeros((-(-n // 8), bits), np.uint8)
    own = np.frombuffer(data, np.uint8)[: rows.size]
    rows.ravel()[: len(own)] = own
    out = np.zeros((len(rows), 8), np.uint64)
    for k in range(8):
        for byte in range(k * bits // 8, ((k + 1) * bits + 7) // 8):
            shift, part = 8 * byte - k * bits, rows[:, byte].astype(np.uint64)
            out[:, k] |= part << np.uint64(shift) if shift >= 0 else part >> np.uint64(-shift)
    return (out.ravel()[:n] & np.uint64((1 << bits) - 1)).astype(np.uint32)


# ---- files ----------------------------------------------------------------------------------------------------------


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class FileWriter:
    """Writes one file; ``add`` takes documents in order.  Nothing stands under the file's name before ``close``."""

    def __init__(self, uri: str, bits: int, id_type: pa.DataType):
        self.fs, self.path = _opened(uri)
        self.bits, self.schema = bits, pa.schema([("doc_id", id_type), ("n", pa.int64())])
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC + np.array([bits, BLOCK_IDS], "<u4").tobytes())
        self.rest: list[np.ndarray] = []
        self.held = self.n_ids = self.n_docs = 0
        self.offsets, self.checks = [], []
        self.documents = pa.BufferOutputStream()
        self.stream = pa.ipc.new_stream(self.documents, self.schema)

    def _block(self, ids: np.ndarray) -> None:
        data = packed(ids, self.bits)
        self.offsets.append(self.out.tell())
        self.checks.append(zlib.crc32(data))
        self.out.write(data)

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.stream.write_batch(pa.record_batch([doc_ids, pa.array(lengths, pa.int64())], schema=self.schema))
        self.n_ids, self.n_docs = self.n_ids + len(ids), self.n_docs + len(lengths)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            ids = np.concatenate(self.rest)
            whole = len(ids) - len(ids) % BLOCK_IDS
            for at in range(0, whole, BLOCK_IDS):
                self._block(ids[at : at + BLOCK_IDS])
            self.rest, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        documents = self.out.tell()
        self.stream.close()
        self.out.write(self.documents.getvalue())
        index = self.out.tell()
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.checks, "<u4").tobytes())
        self.out.write(np.array([documents, index, len(self.offsets), self.n_ids, self.n_docs], "<u8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)


class FileReader:
    """Reads a file's documents, any range of its ids, or its blocks in order."""

    def __init__(self, uri: str):
        filesystem, path = _opened(uri)
        self.file = filesystem.open_input_file(path)
        head, tail = self.file.read_at(16, 0), self.file.read_at(48, self.file.size() - 48)
        if head[:8] != MAGIC or tail[40:] != MAGIC:
            raise ValueError(f"no token file: {uri}")
        self.bits, self.block_ids = (int(x) for x in np.frombuffer(head[8:], "<u4"))
        self._documents, self._index, self.n_blocks, self.n_ids, self.n_docs = (int(x) for x in np.frombuffer(tail[:40], "<u8"))
        data = self.file.read_at(12 * self.n_blocks, self._index)
        self.offsets, self.checks = np.frombuffer(data[: 8 * self.n_blocks], "<u8"), np.frombuffer(data[8 * self.n_blocks :], "<u4")

    def close(self) -> None:
        self.file.close()

    def documents(self) -> Iterator[pa.RecordBatch]:
        """doc_id and n, batch by batch."""
        yield from pa.ipc.open_stream(pa.BufferReader(self.file.read_at(self._index - self._documents, self._documents)))

    def block(self, i: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - i * self.block_ids)
        data = self.file.read_at(-(-n * self.bits // 8), int(self.offsets[i]))
        if zlib.crc32(data) != self.checks[i]:
            raise ValueError(f"block {i} is damaged")
        return unpacked(data, n, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` on, before ``stop``; only their blocks are read."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // self.block_ids
        some = np.concatenate([self.block(i) for i in range(first, (stop - 1) // self.block_ids + 1)])
        return some[start - first * self.block_ids : stop - first * self.block_ids]


# ---- encoding -------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of texts under a vocabulary that drops white space and never joins words.

    Each distinct word of a slice of texts is encoded once.  A word of plain letters and signs behind them is two pieces;
    pieces are kept, and new ones are encoded many at a time: where every token that ends a piece says so (``suffix``),
    their ids are told apart by these.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.size = self.tokenizer.get_vocab_size()
        suffix = json.loads(data)["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of pieces, each a run of letters or of signs."""
        lengths, ids = [], []
        for at in range(0, len(pieces), JOINED):
            some = pieces[at : at + JOINED]
            own = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[own])
            if len(last) != len(some):
                n, own = self._singly(some)
            else:
                n = np.diff(np.concatenate(([-1], last)))
            lengths.append(n)
            ids.append(own)
        return np.concatenate(lengths), np.concatenate(ids)

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([len(x) for x in found], np.int64), np.array([y for x in found for y in x], np.uint32)

    def _numbers(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of plain pieces and of other words among the known ones."""
        if len(self.known) > MOST_KNOWN:
            self._forget()
        for words, encode in ((plain, self._together), (odd, self._singly)):
            new = list(dict.fromkeys(w for w in words if w not in self.known))
            if new:
                lengths, ids = encode(new)
                self.known.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
                self.lengths, self.ids = np.concatenate((self.lengths, lengths)), np.concatenate((self.ids, ids))
        of = self.known
        return np.array([of[w] for w in plain], np.int64), np.array([of[w] for w in odd], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text (null: none), and all ids in order."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        n_words = np.diff(np.asarray(split.offsets))
        words = pc.dictionary_encode(split.flatten())
        distinct, which = words.dictionary, np.asarray(words.indices)
        if not len(distinct):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        simple = pc.extract_regex(distinct, _SIMPLE)
        is_simple = np.asarray(simple.is_valid())
        letters, signs = (pc.dictionary_encode(pc.fill_null(pc.struct_field(simple, k), "")) for k in (0, 1))
        plain = letters.dictionary.to_pylist() + signs.dictionary.to_pylist()
        numbers, others = self._numbers([p.lower() for p in plain if p], distinct.filter(pa.array(~is_simple)).to_pylist())
        # Known numbers of each distinct word's first and second part; -1 is no part.
        of_plain = np.full(len(plain), -1, np.int64)
        of_plain[[i for i, p in enumerate(plain) if p]] = numbers
        first, second = of_plain[np.asarray(letters.indices)], of_plain[len(letters.dictionary) + np.asarray(signs.indices)]
        first[~is_simple] = others
        if not len(self.lengths):  # blank texts alone
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        parts = np.stack((first[which], second[which]), axis=1).ravel()
        lengths = np.where(parts < 0, 0, self.lengths[parts])
        starts = np.concatenate(([0], np.cumsum(self.lengths)))[parts]
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)]
        bounds = np.concatenate(([0], np.cumsum(n_words))) * 2
        return total[bounds[1:]] - total[bounds[:-1]], ids


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    return Encoder(data)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE bytes of text."""
    total = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE, "right")) - 1)
        yield i, j
        i = j


def _binary(lengths: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Each text's ids as bytes, one Arrow array over one buffer."""
    offsets = np.concatenate(([0], np.cumsum(lengths * ids.itemsize)))
    if offsets[-1] >= 1 << 31:
        raise ValueError("a text has more than 2 GB of ids")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])


def _order(doc_id, key: int) -> tuple:
    """Null ids first."""
    return (False, key) if doc_id is None else (True, doc_id, key)


def range_of(bounds: list[tuple], order: tuple, nth: int) -> int:
    """The range of a row: that before the first bound above it; rows that equal bounds take turns in the ranges beside these."""
    low, high = bisect_left(bounds, order), bisect_right(bounds, order)
    return low + nth % (high - low + 1)


def encoded(docs: DataFrame, data: bytes, end_id: int, size: int, bounds: list[tuple]) -> DataFrame:
    """doc_id, key (hash of the text), n, ids (bytes of uint16 or uint32) and range of every row, with ``end_id`` behind its ids."""
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    shared = docs.sparkSession.sparkContext.broadcast((data, bounds))
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text"))
    schema = StructType([*rows.schema.fields[:2], StructField("n", LongType()), StructField("ids", BinaryType()), StructField("range", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bounds, nth = _encoder(shared.value[0]), shared.value[1], TaskContext.get().partitionId()
        for batch in batches:
            for i, j in slices(batch.column(2)):
                some = batch.slice(i, j - i)
                lengths, ids = own.encode(some.column(2))
                n = lengths + 1
                out = np.full(len(ids) + len(n), end_id, kind)
                place = np.arange(len(ids)) + np.repeat(np.arange(len(n)), lengths)
                out[place] = ids
                orders = map(_order, some.column(0).to_pylist(), some.column(1).to_pylist())
                ranges = [range_of(bounds, order, nth + k) for k, order in enumerate(orders)] if bounds else [0] * len(n)
                nth += len(n)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n), _binary(n, out), pa.array(ranges, pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)


def range_bounds(docs: DataFrame, n: int, total: int) -> list[tuple]:
    """n - 1 bounds of ranges of about equally many bytes (of ``total``, with OVERHEAD a row), from a sample of ids and hashes, PER_RANGE a range."""
    if n == 1:
        return []
    weight = F.octet_length(text_or_empty()) + OVERHEAD
    sample = docs.filter(F.rand(7) * total < PER_RANGE * n * weight).select("doc_id", F.xxhash64(text_or_empty()).alias("key")).collect()
    found = sorted(_order(*r) for r in sample)
    return [found[len(found) * i // n] for i in range(1, n)] if found else []


# ---- jobs -----------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) to files in ``folder`` and returns their list: file, path, n_docs, n_ids and start (ids before it).

    Documents stand in ascending doc_id (null first), rows of one id by a hash of their text.  A null text has no ids but
    the end; very long texts are encoded whole; rows may repeat; an empty table gives no files.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    data = Path(tokenizer).read_bytes()
    size = max(Encoder(data).size, end_id + 1)
    bits = bits_for(size)
    kind = "<u2" if bits <= 16 else "<u4"
    rows, text = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_or_empty())), F.lit(0))).first()
    likely = (text // BYTES_AN_ID + rows) * bits // 8
    n_files = max(1, -(-likely // FILE_BYTES), -(-rows // FILE_DOCS), min(spark.sparkContext.defaultParallelism, likely >> 20))
    bounds = range_bounds(docs, n_files, text + OVERHEAD * rows)
    filesystem, path = _opened(f"{folder}/files")
    filesystem.create_dir(path)
    schema = StructType([StructField("file", LongType()), StructField("path", StringType()), StructField("n_docs", LongType()), StructField("n_ids", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId(), None
        uri = f"{folder}/files/{number:06d}.ids"
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or FileWriter(uri, bits, batch.column(0).type)
            column = batch.column(2)
            own = np.frombuffer(column.buffers()[2] or b"", kind)
            offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset :] // own.itemsize
            out.add(batch.column(0), np.asarray(batch.column(1)), own[offsets[0] : offsets[batch.num_rows]])
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, uri, out.n_docs, out.n_ids)], schema.names)

    placed = encoded(docs, data, end_id, size, bounds).repartitionById(len(bounds) + 1, "range").sortWithinPartitions("doc_id", "key")
    files = placed.select("doc_id", "n", "ids").mapInArrow(run, schema).collect()  # a row a file
    start, listed = 0, []
    for r in sorted(files):
        listed.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(listed, StructType([*schema.fields, StructField("start", LongType())]))


def read(files: DataFrame, id_type: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as uint32) of every document in the files, a task a file."""
    schema = StructType([StructField("doc_id", id_type), *(StructField(c, LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, at, block, number = FileReader(uri), 0, np.zeros(0, "<u4"), -1
                for some in own.documents():
                    lengths = np.asarray(some.column(1))
                    crcs = np.zeros(len(lengths), np.int64)
                    for i, length in enumerate(lengths.tolist()):
                        crc, end = 0, at + length
                        while at < end:
                            if at // own.block_ids != number:
                                number = at // own.block_ids
                                block = own.block(number).astype("<u4")
                            part = block[at - number * own.block_ids : end - number * own.block_ids]
                            crc, at = zlib.crc32(part, crc), at + len(part)
                        crcs[i] = crc
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(start + np.cumsum(lengths) - lengths), some.column(1), pa.array(crcs)], schema.names)
                    start += int(lengths.sum())
                own.close()

    return files.select("path", "start").repartitionByRange(n, "start").mapInArrow(run, schema)


def folder_for(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


def report(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from files that are written and then removed; ``write`` says what odd rows give."""
    spark, folder = docs.sparkSession, folder_for(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    found = checkpointed(read(write(rows, folder, tokenizer), rows.schema["doc_id"].dataType))
    removed(spark, folder)
    return found
