"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the mean of the hashed embeddings of its pieces (the word, its beginnings of 3 to 6 letters, its
last 4), so that inflected forms of a marker share pieces.  Filters of widths 1, 2 and 3 run over a whole text; each
filter's largest response feeds a logistic output.

Training goes ``EPOCHS`` times through all labelled rows outside the held-out third.  One embedding coordinate starts as the piece's smoothed
log odds; the rest starts at random from a fixed seed.  While there are at most ``MAX_PER_CLASS`` rows of each label and
``MAX_SAMPLE_BYTES`` of text, the driver trains on them.  More rows are trained on in blocks, by rounds: in each round
every block moves on from the common model through its own rows, and the moves are averaged (iterative parameter mixing).
The thresholds by language are calibrated by one in ``FOLD`` rows, before the model learns from them: for each language the
score that best separates its labels there; they are reported as ``flagged`` and never enter a score.  Then the driver trains
anew on all rows, or training goes on in blocks of the rows that were set aside.

The model is a few hundred KB, whatever the corpus, and is broadcast.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tracklake.llm.common import bounded_texts, checkpointed, private, text_or_empty

BUCKETS, DIM = 1 << 15, 8
WIDTHS, FILTERS = (1, 2, 3), 6
#: Labelled rows of a label, and bytes of text, up to which the driver trains; beyond them rows are trained on in blocks.
MAX_PER_CLASS = 2_500
MAX_SAMPLE_BYTES = 64 << 20
FOLD = 5
EPOCHS, RATE, SEED = 6, 0.05, 7
#: About the rows and bytes of a block; times that a round goes through a block; rounds, so that a row is gone through ``EPOCHS`` times.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_EPOCHS = 4_000, 32 << 20, 2
ROUNDS = EPOCHS // BLOCK_EPOCHS
#: Bits of a bitmap of ids (4 KB, the size that Spark's bitmaps have); bits an id; bits at most.
MAP_BITS, BITS_PER_ID, MAX_BITS = 1 << 15, 8, 1 << 27
#: Moves are summed as whole numbers of this part of one, so that their order does not matter.
UNIT = 1 << 24
FLAG_AT = 0.7
STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¿¡«»…"
HELD_OUT = 1
#: A piece's bucket is the CRC of its kind's letter and its own letters.
BEGINS, ENDS, WHOLE = (zlib.crc32(kind) for kind in (b"p", b"s", b"w"))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from training: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == HELD_OUT, F.lit(False))


def pieces(word: str) -> list[int]:
    """Buckets of a word's pieces; a word of punctuation alone has its own."""
    bare = word.strip(STRIP) or word
    raw = bare.encode("utf-8", "replace")
    begins = range(3, max(3, min(len(bare), 6)) + 1)
    if len(raw) == len(bare):
        parts, end = [raw[:n] for n in begins], raw[-4:]
    else:
        parts, end = [bare[:n].encode("utf-8", "replace") for n in begins], bare[-4:].encode("utf-8", "replace")
    return [*[zlib.crc32(p, BEGINS) % BUCKETS for p in parts], zlib.crc32(end, ENDS) % BUCKETS, zlib.crc32(raw, WHOLE) % BUCKETS]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


#: Of the rows that hold the filters (``Model.joined``): the filter's number and the place within the filter.
FILTER_OF = np.concatenate([np.tile(np.arange(FILTERS), w) + i * FILTERS for i, w in enumerate(WIDTHS)])
PLACE_OF = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])


def responses(joined: np.ndarray, biases: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Model.responses`` of filters as rows; all products are made at once, and a filter's lie side by side."""
    short = max(WIDTHS) - len(vectors)
    if short > 0:
        vectors = np.vstack([vectors, np.zeros((short, DIM), vectors.dtype)])
    products, row, best, where = joined @ vectors.T, 0, [], []
    for w in WIDTHS:
        n = len(vectors) - w + 1
        total = products[row : row + FILTERS, :n]
        for k in range(1, w):
            total = total + products[row + k * FILTERS : row + (k + 1) * FILTERS, k : k + n]
        at = total.argmax(axis=1)
        best.append(total[np.arange(FILTERS), at])
        where.append(at)
        row += w * FILTERS
    return np.concatenate(best) + biases, np.concatenate(where)


@dataclass
class Model:
    """Embeddings, and for each width the filters (width, DIM, FILTERS) and their biases; then the output weights."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    bias: float

    def joined(self) -> np.ndarray:
        """The filters as rows: by width, by place within the filter, by filter."""
        return np.concatenate([f.transpose(0, 2, 1).reshape(-1, DIM) for f in self.filters])

    def responses(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response over all places, and that place.  A text is padded to the widest filter."""
        return responses(self.joined(), np.concatenate(self.biases), vectors)

    def score(self, vectors: np.ndarray) -> float:
        best, _ = self.responses(vectors)
        return float(1 / (1 + np.exp(-(np.maximum(best, 0) @ self.output + self.bias))))


class Pieces:
    """The pieces of numbered words, as numbers in one array."""

    def __init__(self) -> None:
        self.flat, self.ends = array("i"), array("q", [0])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def add(self, word: str) -> None:
        self.flat.extend(pieces(word))
        self.ends.append(len(self.flat))

    def __getitem__(self, word: int) -> np.ndarray:
        return np.frombuffer(self.flat, np.int32)[self.ends[word] : self.ends[word + 1]]

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all ``words``, one word after the other, and how many each of them has."""
        ends = np.frombuffer(self.ends, np.int64)
        lengths = ends[words + 1] - ends[words]
        within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return np.frombuffer(self.flat, np.int32)[within + np.repeat(ends[words], lengths)], lengths

    def stored(self, most: int) -> Iterator[tuple[bytes, bytes]]:
        """The pieces of ``most`` words at a time, and how many each word has; ``put`` takes them again."""
        flat, ends = np.frombuffer(self.flat, np.int32), np.frombuffer(self.ends, np.int64)
        for at in range(0, len(self), most):
            own = ends[at : at + most + 1]
            yield flat[own[0] : own[-1]].astype(np.uint16).tobytes(), np.diff(own).astype(np.uint8).tobytes()

    def put(self, flat: bytes, lengths: bytes) -> None:
        self.flat.frombytes(np.frombuffer(flat, np.uint16).astype(np.int32).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(np.frombuffer(lengths, np.uint8), dtype=np.int64)).tobytes())

    def vectors(self, words: np.ndarray, embedding: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros((0, DIM), np.float32)
        rows, lengths = self.of(words)
        return (np.add.reduceat(embedding[rows], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]).astype(np.float32)


class Numbers(dict):
    """The numbers of words; a new word gets the next one and its pieces."""

    def __init__(self, own: Pieces) -> None:
        super().__init__()
        self.own = own

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.own.add(word)
        return i


class Vocabulary:
    """Numbers of distinct words and, by number, their pieces; grows while it is used.

    Who goes through a partition starts anew beyond ``MOST`` words, so that a task does not hold all words of its texts.
    """

    MOST = 200_000

    def __init__(self) -> None:
        self.pieces = Pieces()
        self.number = Numbers(self.pieces)

    def ids(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    @property
    def full(self) -> bool:
        return len(self.number) > self.MOST


def encoded(texts: Iterable[str | None]) -> tuple[list[np.ndarray], Pieces]:
    """The texts as numbers of words; the words themselves are not kept."""
    vocabulary = Vocabulary()
    return [vocabulary.ids(t) for t in texts], vocabulary.pieces


class Scorer:
    """Scores texts one after the other; the vectors of the words met are kept as far as ``Vocabulary`` keeps words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._anew()

    def _anew(self) -> None:
        self.vocabulary, self.table, self.known = Vocabulary(), np.zeros((1024, DIM), np.float32), 0

    def __call__(self, text: str | None) -> float:
        if self.vocabulary.full:
            self._anew()
        ids, n = self.vocabulary.ids(text), len(self.vocabulary.pieces)
        if n > len(self.table):
            self.table = np.vstack([self.table[: self.known], np.zeros((2 * n - self.known, DIM), np.float32)])
        self.table[self.known : n] = self.vocabulary.pieces.vectors(np.arange(self.known, n), self.model.embedding)
        self.known = n
        return self.model.score(self.table[ids])


def holds(own: np.ndarray, word_pieces: Pieces) -> np.ndarray:
    """For each piece whether the text holds it."""
    out = np.zeros(BUCKETS, bool)
    out[word_pieces.of(own)[0]] = True
    return out


def pieces_seen(docs: list[np.ndarray], labels: np.ndarray, word_pieces: Pieces) -> np.ndarray:
    """For each label the number of texts that hold a piece."""
    seen = np.zeros((2, BUCKETS))
    for own, y in zip(docs, labels, strict=True):
        seen[int(y)] += holds(own, word_pieces)
    return seen


def start(seen: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> Model:
    """The model before training, from ``pieces_seen`` and the number of texts of each label."""
    n = np.maximum(n, 1)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    trust = 1 - np.exp(-seen.sum(axis=0) / 4)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(odds * trust, -4, 4) / 2
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w, f in zip(WIDTHS, filters, strict=True):
        f[:, 0, : FILTERS // 2] += 1.0 / w
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    return Model(embedding, filters, biases, np.full(FILTERS * len(WIDTHS), 0.2, np.float32), -1.0)


def train(texts: list[str | None], labels: np.ndarray) -> Model:
    """The same rows give the same model."""
    rng = np.random.default_rng(SEED)
    docs, word_pieces = encoded(texts)
    model = start(pieces_seen(docs, labels, word_pieces), np.bincount(labels.astype(int), minlength=2), rng)
    return trained_on(model, docs, labels, word_pieces, rng, EPOCHS)


def trained_on(model: Model, docs: list[np.ndarray], labels: np.ndarray, word_pieces: Pieces, rng: np.random.Generator, epochs: int) -> Model:
    """``model``, which is changed, after stochastic gradient descent with momentum-free Adagrad steps."""
    embedding, filters, biases, output, bias = model.embedding, model.joined(), np.concatenate(model.biases), model.output, model.bias
    grown_f, grown_b, grown_e, grown_o, grown_c = *(np.full_like(x, 1e-2) for x in (filters, biases, embedding, output)), 1e-2
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            own = docs[d]
            distinct, place = np.unique(own, return_inverse=True)
            vectors = word_pieces.vectors(distinct, embedding)
            best, where = responses(filters, biases, vectors[place] if len(own) else vectors)
            active = np.maximum(best, 0)
            miss = 1 / (1 + np.exp(-(active @ output + bias))) - labels[d]
            back = miss * output * (best > 0)
            step = miss * active + 1e-4 * output
            grown_o += step**2
            output -= RATE * step / np.sqrt(grown_o)
            grown_c += miss**2
            bias -= RATE * miss / np.sqrt(grown_c)
            grown_b += back**2
            biases -= RATE * back / np.sqrt(grown_b)
            # Rows of filters that have a word under them and something to learn.
            at = where[FILTER_OF] + PLACE_OF
            rows = np.flatnonzero((back[FILTER_OF] != 0) & (at < len(own)))
            if not len(rows):
                continue
            at, share = at[rows], back[FILTER_OF[rows], None]
            to_filter = share * vectors[place[at]]
            touched, lengths = word_pieces.of(own[at])
            to_piece = np.repeat(share * filters[rows] / lengths[:, None], lengths, axis=0)
            grown_f[rows] += to_filter**2
            filters[rows] -= RATE * to_filter / np.sqrt(grown_f[rows])
            order = np.argsort(touched, kind="stable")
            first = np.flatnonzero(np.diff(touched[order], prepend=-1))
            touched, to_piece = touched[order][first], np.add.reduceat(to_piece[order], first, axis=0)
            grown_e[touched] += to_piece**2
            embedding[touched] -= RATE * to_piece / np.sqrt(grown_e[touched])
    row = 0
    for i, w in enumerate(WIDTHS):
        model.filters[i] = filters[row : row + w * FILTERS].reshape(w, FILTERS, DIM).transpose(0, 2, 1).copy()
        row += w * FILTERS
    model.biases, model.bias = list(np.split(biases, len(WIDTHS))), float(bias)
    return model


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (of several labels the larger) of all labels outside the held-out third."""
    return labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """What the driver trains on: text, lang and toxic of at most MAX_PER_CLASS rows a label and MAX_SAMPLE_BYTES of text, none of them held out.

    ``fit`` asks for it only where these bounds leave no row out.  An id counts once, however often it occurs: with the text of the smallest digest, and of its languages the first.
    """
    known = known_labels(labels)
    order = F.xxhash64("doc_id")
    first = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(MAX_PER_CLASS) for y in (0, 1)]
    # 2 * MAX_PER_CLASS ids at most: small enough to be broadcast, so that no other text is shuffled.
    chosen = checkpointed(first[0].union(first[1]))
    langs = docs.select("doc_id", "lang").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("lang").alias("lang"))
    rows = bounded_texts(docs, chosen, MAX_SAMPLE_BYTES).join(langs, "doc_id").toPandas()
    return rows.sort_values("doc_id", ignore_index=True)


def language_thresholds(model: Model, sample: pd.DataFrame) -> dict[str, float]:
    """For each language with both labels, the middle of the threshold range that makes fewest mistakes on the sample; "" holds for the others."""
    scores = np.array([*map(Scorer(model), sample["text"])])
    out = {"": FLAG_AT}
    for lang, own in sample.groupby("lang").groups.items():
        s, y = scores[own], sample.loc[own, "toxic"].to_numpy()
        if len(set(y)) == 2:
            order = np.argsort(s)
            s, y = s[order], y[order]
            # Mistakes if the first i rows are called clean and the others toxic.
            mistakes = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
            i = np.flatnonzero(mistakes == mistakes.min())
            edges = np.concatenate(([0.0], s, [1.0]))
            out[str(lang)] = float((edges[i[0]] + edges[i[-1] + 1]) / 2)
    return out


def _few(docs: DataFrame, labels: DataFrame) -> bool:
    """Whether ``training_rows`` are all labelled rows."""
    known = known_labels(labels)
    if any(r["count"] > MAX_PER_CLASS for r in known.groupBy("toxic").count().collect()):
        return False
    size = docs.join(F.broadcast(known), "doc_id").agg(F.sum(F.octet_length("text"))).first()[0]
    return (size or 0) <= MAX_SAMPLE_BYTES


def likely(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not in ``known`` and with all whose id is: hashes of the ids are looked up in bitmaps of 16 MB at most."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("string", "bigint", "int") or dict(known.dtypes)["doc_id"] != kind:
        return docs
    bits, one = min(MAX_BITS, max(MAP_BITS, 1 << (BITS_PER_ID * known.count()).bit_length())), private("bits", docs)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    number, place = F.floor(at / MAP_BITS), at % MAP_BITS
    maps = known.groupBy(number.alias(f"{one}_number")).agg(F.bitmap_construct_agg(place).alias(one))
    byte = F.conv(F.hex(F.substring(F.col(one), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = docs.join(F.broadcast(maps), number == F.col(f"{one}_number"))
    return rows.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*docs.columns)


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, toxic and aside (the thresholds' rows) of all labelled rows outside the held-out third, an id once as in ``training_rows``."""
    known = known_labels(labels)
    rows = likely(docs.select("doc_id", text_or_empty().alias("text"), "lang"), known).join(known, "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"), F.min("lang").alias("lang"), F.max("toxic").alias("toxic"))
    return one.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(FOLD)) == 0)


#: Words whose pieces lie in one row of a block.
WORDS_A_ROW = 50_000
BLOCK_ROW = "lang string, toxic long, aside boolean, words binary, pieces binary, lengths binary"


def in_blocks(rows: DataFrame, sizes: dict[bool, Row]) -> DataFrame:
    """``rows`` as numbers of words, a block a partition, by their ids within it; the pieces of a block's words follow.

    A block has rows set aside only, or none of them.  It is encoded and written once for all rounds.
    """
    own, aside = (max(1, -(-r["n"] // BLOCK_ROWS), -(-r["size"] // BLOCK_BYTES)) if (r := sizes.get(k)) else 0 for k in (False, True))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n))).cast("int")
    block = F.when(F.col("aside"), own + place(aside)).otherwise(place(own))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BLOCK_ROW.split(", ")]
        vocabulary, of = Vocabulary(), None
        for batch in batches:
            if batch.num_rows:
                texts, lang, toxic, of = batch.columns
                words = pa.array([vocabulary.ids(t.as_py()).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([lang, toxic.cast(pa.int64()), of, words, *[pa.nulls(len(words), pa.binary())] * 2], names)
        vocabulary.number.clear()  # only the pieces are needed from here on
        for flat, lengths in vocabulary.pieces.stored(WORDS_A_ROW):
            values = [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), of[:1], pa.nulls(1, pa.binary()), pa.array([flat], pa.binary()), pa.array([lengths], pa.binary())]
            yield pa.RecordBatch.from_arrays(values, names)

    placed = rows.repartitionById(own + aside, block).sortWithinPartitions("doc_id")
    return checkpointed(placed.select("text", "lang", "toxic", "aside").mapInArrow(encode, BLOCK_ROW))


def decoded(batches: Iterable[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, list[str | None], Pieces]:
    """The texts of a block as numbers of words, their labels and languages, and the pieces of the words."""
    docs, labels, langs, own = [], [], [], Pieces()
    for batch in batches:
        for lang, y, _, words, flat, lengths in zip(*batch.columns, strict=True):
            if words.is_valid:
                docs.append(np.frombuffer(words.as_py(), np.int32))
                labels.append(y.as_py())
                langs.append(lang.as_py())
            else:
                own.put(flat.as_py(), lengths.as_py())
    return docs, np.array(labels, float), langs, own


def _seen_in_all(blocks: DataFrame) -> np.ndarray:
    """``pieces_seen`` of all rows: every task counts its own, at most two counts a piece leave it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels, _, own = decoded(batches)
        seen = pieces_seen(docs, labels, own)
        y, piece = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(piece), pa.array(seen[y, piece].astype(np.int64))], ["y", "piece", "n"])

    out = np.zeros((2, BUCKETS))
    for r in blocks.mapInArrow(count, "y long, piece long, n long").groupBy("y", "piece").agg(F.sum("n").alias("n")).collect():
        out[r["y"], r["piece"]] = r["n"]
    return out


def block_scores(blocks: DataFrame, model: Model) -> DataFrame:
    """lang, toxic and score of every row."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels, langs, own = decoded(batches)
        table = own.vectors(np.arange(len(own)), shared.value.embedding)
        scores = [shared.value.score(table[words]) for words in docs]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(labels.astype(np.int64)), pa.array(scores, pa.float64())], ["lang", "toxic", "score"])

    return blocks.mapInArrow(score, "lang string, toxic long, score double")


def _as_rows(model: Model) -> np.ndarray:
    """All of a model's numbers in rows of DIM, those of the embedding first."""
    rest = np.concatenate([*[f.ravel() for f in model.filters], *model.biases, model.output, [model.bias]])
    return np.vstack([model.embedding, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float64)


def _from_rows(rows: np.ndarray) -> Model:
    rest, at, parts = rows[BUCKETS:].ravel(), 0, []
    for shape in [*[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (FILTERS * len(WIDTHS),)]:
        n = int(np.prod(shape))
        parts.append(rest[at : at + n].reshape(shape).astype(np.float32))
        at += n
    k = len(WIDTHS)
    return Model(rows[:BUCKETS].astype(np.float32), parts[:k], parts[k : 2 * k], parts[2 * k], float(rest[at]))


def _round(blocks: DataFrame, model: Model, seed: int) -> Model:
    """``model`` moved by the mean of the moves of all blocks, each weighted by its rows; a row of the embedding by those that moved it."""
    shared = blocks.sparkSession.sparkContext.broadcast(_as_rows(model))
    names = [f"m{i}" for i in range(DIM)]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels, _, word_pieces = decoded(batches)
        if not docs:
            return
        own = trained_on(_from_rows(shared.value), docs, labels, word_pieces, np.random.default_rng(seed), BLOCK_EPOCHS)
        moved = _as_rows(own) - shared.value
        at = np.flatnonzero(moved.any(axis=1) | (np.arange(len(moved)) >= BUCKETS))
        out = np.rint(moved[at] * UNIT).astype(np.int64) * len(docs)
        yield pa.RecordBatch.from_arrays([*map(pa.array, out.T), pa.array(at), pa.array(np.full(len(at), len(docs)))], [*names, "at", "n"])

    moves = blocks.mapInArrow(move, ", ".join(f"{m} long" for m in names) + ", at long, n long")
    total = moves.groupBy("at").agg(*[F.sum(m).alias(m) for m in names], F.sum("n").alias("n")).toPandas()
    after = shared.value.copy()
    after[total["at"].to_numpy()] += total[names].to_numpy() / UNIT / total["n"].to_numpy()[:, None]
    return _from_rows(after)


def counted_thresholds(scores: DataFrame) -> dict[str, float]:
    """``language_thresholds`` of a table of any size (lang, toxic, score): scores are rounded to 4 digits and counted, so a language is 10,001 rows at most."""
    counts = scores.filter("lang is not null").groupBy("lang", F.round("score", 4).alias("s")).agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    own = Window.partitionBy("lang")
    order = own.orderBy("s")
    both = counts.withColumns({"ps": F.sum("p").over(own), "ns": F.sum("n").over(own)}).filter("ps > 0 and ns > 0")
    # A cut lies above each distinct score, and one below all.  Mistakes: toxic rows below it and clean ones above.
    cuts = both.select("lang", "s", F.lead("s", 1, 1.0).over(order).alias("up"), (F.sum("p").over(order) + F.col("ns") - F.sum("n").over(order)).alias("m"))
    lowest = both.groupBy("lang").agg(F.lit(0.0).alias("s"), F.min("s").alias("up"), F.max("ns").alias("m"))
    every = cuts.union(lowest)
    best = every.withColumn("least", F.min("m").over(own)).filter("m = least").groupBy("lang").agg(((F.min("s") + F.max("up")) / 2).alias("at"))
    return {"": FLAG_AT} | {str(r["lang"]): r["at"] for r in best.collect()}


def fit_in_blocks(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, float]] | None:
    """``fit`` for any number of labelled rows: texts stay in the tasks, the driver gets counts and means of the size of the model."""
    rows = checkpointed(labelled_rows(docs, labels))
    count = [F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum(F.octet_length("text")).alias("size")]
    sizes = {r["aside"]: r for r in rows.groupBy("aside").agg(*count).collect()}
    if False not in sizes or not 0 < sizes[False]["toxic"] < sizes[False]["n"]:
        # All rows of a label were set aside: then none is.
        rows = rows.withColumn("aside", F.lit(False))
        sizes = {False: rows.agg(*count).first()}
        if not sizes[False]["n"] or not 0 < sizes[False]["toxic"] < sizes[False]["n"]:
            return None
    blocks = in_blocks(rows, sizes)
    own, aside = blocks.filter("not aside"), blocks.filter("aside")
    n, toxic = sizes[False]["n"], sizes[False]["toxic"]
    model = start(_seen_in_all(own), np.array([n - toxic, toxic]), np.random.default_rng(SEED))
    for i in range(ROUNDS):
        model = _round(own, model, SEED + i)
    if True not in sizes:
        return model, {"": FLAG_AT}
    thresholds = counted_thresholds(block_scores(aside, model))
    for i in range(ROUNDS):
        model = _round(aside, model, SEED + ROUNDS + i)
    return model, thresholds


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, float]] | None:
    """Model and thresholds from all labelled rows outside the held-out third; None without rows of both labels.

    Every one of these rows is gone through ``EPOCHS`` times, those that set the thresholds too, after they did.
    """
    if not _few(docs, labels):
        return fit_in_blocks(docs, labels)
    sample = training_rows(docs, labels)
    if sample["toxic"].nunique() < 2:
        return None
    aside = sample.groupby("toxic").cumcount() % FOLD == FOLD - 1
    own = sample[~aside]
    thresholds = language_thresholds(train(list(own["text"]), own["toxic"].to_numpy(float)), sample[aside].reset_index(drop=True))
    return train(list(sample["text"]), sample["toxic"].to_numpy(float)), thresholds


def scored(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1).  Null and empty texts are scored as texts without words; without a model every score is 0."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Scorer(shared.value)
        for texts in batches:
            yield pa.array([own(t.as_py()) for t in texts], pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(column, F.arrow_udf(score, "double")("text"))


def language_limit(thresholds: dict[str, float]) -> Column:
    limit = F.lit(thresholds[""])
    for lang, at in sorted(thresholds.items()):
        if lang:
            limit = F.when(F.col("lang") == lang, F.lit(at)).otherwise(limit)
    return limit


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score, predicted (score of FLAG_AT and more) and flagged (its language's threshold is reached).

    Labels of other values than 0 and 1 are ignored; of several labels of one id the larger counts.  Repeated rows give
    repeated rows.  An empty table gives an empty table.  Columns of these names are replaced.
    """
    fitted = fit(docs, labels)
    model, thresholds = fitted if fitted else (None, {"": FLAG_AT})
    out = scored(docs, model)
    return out.withColumn("predicted", (F.col("score") >= FLAG_AT).cast("int")).withColumn("flagged", F.col("score") >= language_limit(thresholds))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score reaches their language's threshold (0.5 at least).

    Columns stay as they are, whatever their names.  Null and empty texts stay.  Very long texts are scored whole.
    """
    fitted = fit(docs, labels)
    if fitted is None:
        return docs
    model, thresholds = fitted
    column = private("toxicity", docs)
    kept = scored(docs, model, column).filter(F.col(column) < F.greatest(F.lit(0.5), language_limit(thresholds)))
    return kept.drop(column)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", "lang"), labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "flagged")
