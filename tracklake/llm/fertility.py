r"""Quality rules from the fertility of public tokenisers.

For every text, long or short: characters per token, share of byte-fallback tokens and entropy of its tokens under a
sentencepiece vocabulary, and characters per token under a byte-level one.  Words are encoded one by one; each distinct
word of a batch is encoded once.  Both vocabularies are read by the driver from paths that are parameters, and sent
along.

Bands: for each language (null is one of its own) and class of length (powers of two of the number of tokens, as the
entropy and the variance of short texts depend on it) the middle and the spread of each measure over *all* documents
that pass the base rules: median and median distance from it, which a third of bad texts cannot carry away.  They come
from histograms with fixed bins, summed by Spark, so any number of documents gives one small table.  Each group is
joined by ``PRIOR_ROWS`` rows' worth of its language in all lengths (spread at least as the length in all languages), and
each language by as much of all, which is what holds where documents are few.  A text is rejected when its distance from the middle, the measures' deviations in spreads taken together
(root of their squares' sum), is over ``REACH``: one measure far off or several that agree.

Base rules: fewer than 10 words, or over 20 % of the words in repeated 5-word windows, fail.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import checkpointed

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SYMBOLS = b"#*$%&|<>"
REACH = 6.0
PRIOR_ROWS = 5
#: Measures: name, width of a histogram bin, least spread.
MEASURES = (("chars_per_token", 0.005, 0.01), ("byte_share", 0.002, 0.02), ("token_entropy", 0.01, 0.03), ("chars_per_byte_token", 0.005, 0.01))
LONGEST_CLASS = 20
#: What makes the standard deviation of a normal distribution from the median distance.
TO_DEVIATION = 1.4826
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, chars_per_byte_token double"


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each segment, and the segment of each item."""
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, the words that lie in a window of WINDOW words which occurs twice or more in the document."""
    n = len(ids)
    if n < WINDOW:
        return np.zeros(n_docs, np.int64)
    whole = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
    code = doc.astype(np.int64)[: n - WINDOW + 1].copy()
    for k in range(WINDOW):  # a window's number: the pair (number so far, next word), numbered anew
        code = pd.factorize(code * (int(ids.max()) + 1) + ids[k : n - WINDOW + 1 + k])[0].astype(np.int64)
    code = code[whole]
    at = np.flatnonzero(whole)[np.bincount(code)[code] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.encode("utf-8", "replace").strip():
            n += line in seen
            seen.add(line)
    return n


class Fertility:
    """Measures of a batch of texts, with vocabularies (the bytes of their files) that are loaded once a worker."""

    def __init__(self, pieces: bytes, ranks: bytes):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        numbers = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.ranks = tiktoken.Encoding("own", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=numbers, special_tokens={})
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def measure(self, texts: list[str]) -> pd.DataFrame:
        raw = [t.encode("utf-8", "replace") for t in texts]
        words = [r.split() for r in raw]  # ASCII white space, which is just what separates words here
        n_words = np.array([len(w) for w in words], np.int64)
        _, doc = _segments(n_words)
        ids, vocabulary = pd.factorize(np.array([w for own in words for w in own], object))
        spelled = [w.decode() for w in vocabulary]
        encoded = self.pieces.encode(spelled, num_threads=1) if len(vocabulary) else []
        under_ranks = np.array([len(self.ranks.encode_ordinary(w)) for w in spelled], np.int64)
        per_word = np.array([len(e) for e in encoded], np.int64)
        flat = np.array([i for e in encoded for i in e], np.int64)
        starts, _ = _segments(per_word) if len(per_word) else (np.zeros(0, np.int64), None)
        counts = per_word[ids] if len(ids) else np.zeros(0, np.int64)
        offset, _ = _segments(counts) if len(counts) else (np.zeros(0, np.int64), None)
        position = np.arange(counts.sum()) - np.repeat(offset, counts) + np.repeat(starts[ids], counts) if len(ids) else np.zeros(0, np.int64)
        token, token_doc = flat[position], np.repeat(doc, counts)
        n_docs = len(texts)
        n_tokens = np.bincount(token_doc, minlength=n_docs)
        n_bytes = np.bincount(token_doc[self.is_byte[token]], minlength=n_docs)
        pairs = token_doc * np.int64(len(self.is_byte)) + token
        pairs.sort()
        edges = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate((edges, [len(pairs)])))
        owner = pairs[edges] // len(self.is_byte)
        share = times / n_tokens[owner]
        entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=n_docs)
        blanks = b" \t\n\x0b\x0c\r"
        word_chars = np.array([len(t) - sum(t.count(chr(c)) for c in blanks) for t in texts], np.int64)
        some = np.maximum(n_tokens, 1)
        byte_tokens = np.bincount(doc, weights=under_ranks[ids], minlength=n_docs) if len(ids) else np.zeros(n_docs)
        return pd.DataFrame(
            {
                "n_words": n_words,
                "word_chars": word_chars,
                "n_symbols": np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raw], np.int64),
                "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
                "n_repeat_words": repeated_words(ids, doc, n_docs),
                "n_tokens": n_tokens,
                "chars_per_token": word_chars / some,
                "byte_share": n_bytes / some,
                "token_entropy": np.where(n_tokens > 0, entropy, 0.0),
                "chars_per_byte_token": word_chars / np.maximum(byte_tokens, 1),
            }
        )


@lru_cache(maxsize=2)
def _tool(pieces: bytes, ranks: bytes) -> Fertility:
    return Fertility(pieces, ranks)


#: Characters of text that are measured at a time.
BATCH_CHARS = 4_000_000


def measures(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """doc_id, lang and the measures of every row.  A null text is empty: no words, no tokens, all measures 0."""
    files = docs.sparkSession.sparkContext.broadcast((Path(pieces).read_bytes(), Path(ranks).read_bytes()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = _tool(*files.value)
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"]]
            lengths = np.cumsum([len(t) for t in texts])
            cuts = np.searchsorted(lengths, np.arange(BATCH_CHARS, lengths[-1] if len(lengths) else 0, BATCH_CHARS))
            for own in np.split(np.arange(len(texts)), np.unique(cuts + 1)):
                if len(own):
                    got = tool.measure([texts[i] for i in own])
                    yield pd.concat([frame.iloc[own][["doc_id", "lang"]].reset_index(drop=True), got], axis=1)

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    kind = docs.schema["doc_id"].dataType
    out = slim.mapInPandas(run, f"doc_id string, lang string, {STATS}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def with_base_rules(measured: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def _per_measure(part: int) -> Column:
    """The width (part 1) or least spread (part 2) of a row's ``measure``."""
    out = F.lit(0.0)
    for own in MEASURES:
        out = F.when(F.col("measure") == own[0], F.lit(own[part])).otherwise(out)
    return out


def _median(histogram: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, rows and ``middle``: the weighted median of ``value`` (weights n) in each group of a histogram."""
    group = Window.partitionBy(*keys)
    ranked = histogram.withColumn("upto", F.sum("n").over(group.orderBy(value))).withColumn("total", F.sum("n").over(group))
    middle = F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col(value)))
    return ranked.groupBy(*keys).agg(F.first("total").alias("rows"), middle.alias("middle"))


def _centres(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, middle and spread of each group."""
    middles = _median(histogram, keys, "value")
    named = middles.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("middle").alias("m"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"m_{k}"))
    far = histogram.join(named, same).select(*keys, "n", F.abs(F.col("value") - F.col("m")).alias("far"))
    spreads = _median(far, keys, "far").select(*[F.col(k).alias(f"m_{k}") for k in keys], (TO_DEVIATION * F.col("middle")).alias("spread"))
    return middles.join(spreads, same).select(*keys, "rows", "middle", "spread")


def bands(measured: DataFrame) -> DataFrame:
    """lang, length_class, measure, rows, middle and spread, over all documents that pass the base rules."""
    values = F.array(*[F.struct(F.lit(name).alias("measure"), F.floor(F.col(name) / width).alias("bin")) for name, width, _ in MEASURES])
    good = measured.filter(~F.col("base_failed")).select("lang", "length_class", F.explode(values).alias("v"))
    counted = good.groupBy("lang", "length_class", "v.measure", "v.bin").agg(F.count("*").alias("n"))
    histogram = checkpointed(counted.withColumn("value", (F.col("bin") + 0.5) * _per_measure(1)))
    sum_over = lambda *keys: histogram.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    every = _centres(sum_over("measure"), ["measure"])
    by_language = _mixed(_centres(sum_over("lang", "measure"), ["lang", "measure"]), every, ["measure"])
    # Of the language in all lengths and the length in all languages, the wider spread: short texts vary more.
    by_length = _centres(sum_over("length_class", "measure"), ["length_class", "measure"]).select("length_class", "measure", F.col("spread").alias("length_spread"))
    wider = by_language.join(by_length, "measure").select("lang", "length_class", "measure", "middle", F.greatest("spread", "length_spread").alias("spread"))
    own = _mixed(_centres(histogram, ["lang", "length_class", "measure"]), wider, ["lang", "length_class", "measure"])
    return own.withColumn("spread", F.greatest("spread", _per_measure(2)))


def _mixed(groups: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` with PRIOR_ROWS rows' worth of the wider group that ``keys`` name added to each: its middle, and its squared spread."""
    named = wider.select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("middle").alias("w_middle"), F.col("spread").alias("w_spread"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    share = F.lit(PRIOR_ROWS) / (F.col("rows") + PRIOR_ROWS)
    mix = lambda a, b: a + share * (b - a)
    out = groups.join(named, same).withColumn("middle", mix(F.col("middle"), F.col("w_middle")))
    return out.withColumn("spread", F.sqrt(mix(F.col("spread") ** 2, F.col("w_spread") ** 2))).select(*groups.columns)


def judged(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """The measures of every row with base_failed, distance, outside (measures by themselves out of reach) and kept.

    Every text that passes the base rules has a distance; for the others it is null.  Rows of ``docs`` may repeat and
    then weigh as often.  A null language is a language.  Very long texts are read whole.  Extra columns are ignored.  An
    empty table gives an empty table.
    """
    length = F.least(F.lit(LONGEST_CLASS), F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1))))).cast("int")
    measured = checkpointed(with_base_rules(measures(docs, pieces, ranks)).withColumn("length_class", length))
    centre = F.map_from_entries(F.collect_list(F.struct("measure", F.struct("middle", "spread"))))
    limits = bands(measured).groupBy(F.col("lang").alias("_lang"), F.col("length_class").alias("_class")).agg(centre.alias("_centres"))
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("length_class") == F.col("_class")), "left")
    off = {name: (F.col(name) - F.col("_centres")[name]["middle"]) / F.col("_centres")[name]["spread"] for name, *_ in MEASURES}
    distance = F.when(~F.col("base_failed"), F.sqrt(sum((x * x for x in off.values()), F.lit(0.0))))
    outside = F.array_compact(F.array(*[F.when(~F.col("base_failed") & (F.abs(x) > REACH), F.lit(name)) for name, x in off.items()]))
    judgement = joined.withColumn("distance", distance).withColumn("outside", outside)
    return judgement.withColumn("kept", F.coalesce(F.col("distance") <= REACH, F.lit(False))).drop("_lang", "_class", "_centres")


def report(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """The columns of ``judged`` for every row, ``outside`` as text.  A null or empty text fails the base rules."""
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *[name for name, *_ in MEASURES], "distance"]
    return judged(docs, pieces, ranks).select(*shown, F.array_join("outside", ",").alias("outside"))
