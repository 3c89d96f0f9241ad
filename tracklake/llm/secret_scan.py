r"""Secrets by two character Markov models.

Base spans: three patterns (assignments, access keys, hex runs).  Added spans: runs of ``[A-Za-z0-9+/_=-]`` that overlap
no base span and whose log-likelihood ratio between a model of random strings and a model of ordinary identifiers
reaches a calibrated threshold.  The ratio is that of the whole run, so a longer run needs less of each character; no
kind of run is left out, and the threshold alone decides.  Runs so short that no string of their length reaches it need
not be looked at: the largest ratio of any string of n characters follows from that of n - 1.

Both models are of the second order over the characters of such runs, with a mark at both ends, and trained on labelled
samples: random strings are the values of base spans in a bounded sample of documents plus seeded random ones of the
usual alphabets and all lengths; ordinary identifiers are the runs of plain form (words, numbers, both joined by signs)
of the same documents, plus joined forms of the words (snake, kebab and camel case with version numbers).  Every other string trains, the rest
calibrates: the threshold is reached by ``FALSE_SHARE`` of the ordinary ones at most.  The sample is the
``SAMPLE_DOCS`` first documents in the order of a hash of their id, each of them whole and an id once, with
``SAMPLE_BYTES`` of text at most; its strings are found where the texts are, and only the distinct ones come to the driver.  Every text of the corpus is scanned whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import bounded_texts, checkpointed

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = "[A-Za-z0-9+/_=-]"
#: What labels a run as ordinary for training: words in one case and numbers, joined by signs.  A key without a keyword is not of this form.
PLAIN = re.compile(r"[+/_=-]*(?:[A-Za-z][a-z]*|[A-Z]+|[0-9]+)(?:[+/_=-]+(?:[A-Za-z][a-z]*|[A-Z]+|[0-9]+))*[+/_=-]*")
MIN_ASSIGN, MIN_ACCESS = 8, 16

SAMPLE_DOCS, SAMPLE_BYTES = 2_000, 64 << 20
SEED, SYNTHETIC, SHORTEST, LONGEST = 11, 12_000, 6, 64
#: Share of held-out ordinary identifiers that may reach the threshold; the least threshold (nats, about one in 10^11).
FALSE_SHARE, LEAST_RATIO = 0.001, 25.0
#: Scores of distinct runs that a worker keeps.
MOST_KNOWN = 500_000
#: Characters whose runs are held at a time.
SLICE_CHARS = 1 << 20
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = {c: i for i, c in enumerate(ALPHABET)}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base spans, by start, then kind as listed.  Offsets in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], start, end) for start, k, end in sorted(out)]


class Markov:
    """Second-order model of the characters of ALPHABET and a mark for the ends, smoothed towards lower orders."""

    def __init__(self, strings: list[str]):
        n = len(ALPHABET) + 1
        codes, _ = coded(strings)
        one = np.bincount(codes, minlength=n).astype(float)
        two = np.bincount(codes[:-1] * n + codes[1:], minlength=n * n).reshape(n, n).astype(float) if len(codes) else np.zeros((n, n))
        three = np.bincount((codes[:-2] * n + codes[1:-1]) * n + codes[2:], minlength=n**3).reshape(n, n, n).astype(float) if len(codes) else np.zeros((n, n, n))
        p1 = (one + 1) / (one.sum() + n)
        p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
        self.log = np.log((three + 8 * p2[None]) / (three.sum(axis=2, keepdims=True) + 8)).astype(np.float32)


def coded(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all strings in a row, two marks before each and one behind the last; and where each string's own begin."""
    mark = len(ALPHABET)
    flat = np.frombuffer("".join(f"\x00\x00{s}" for s in strings).encode("ascii"), np.uint8)
    table = np.full(128, mark, np.int64)
    table[[ord(c) for c in ALPHABET]] = np.arange(mark)
    lengths = np.array([len(s) + 2 for s in strings], np.int64)
    return np.append(table[flat], mark), np.cumsum(lengths) - lengths + 2


class Detector:
    """Log-likelihood ratios of runs, random against ordinary, with the threshold and the shortest length that can reach it."""

    def __init__(self, random_model: Markov, ordinary: Markov):
        self.ratio = random_model.log - ordinary.log  # log-likelihood ratio of a character after two others
        self.known: dict[str, bool] = {}
        self.reach(LEAST_RATIO)

    def reach(self, threshold: float) -> None:
        """Sets the threshold, and the length of the shortest string that reaches it (LONGEST + 1 stands for any longer one)."""
        self.threshold, self.shortest = threshold, LONGEST + 1
        mark = len(ALPHABET)
        ends = self.ratio[:, :, mark].astype(float)
        most = np.full((mark + 1, mark + 1), -np.inf)  # by the last two characters
        most[mark, mark] = 0.0
        for n in range(1, LONGEST + 1):
            grown = (most[:, :, None] + self.ratio).max(axis=0)
            grown[:, mark] = -np.inf
            most = grown
            if (most + ends).max() >= threshold - 1e-3:  # ratios are summed in another order elsewhere
                self.shortest = n
                break

    def ratios(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.zeros(0)
        codes, begins = coded(strings)
        each = self.ratio[codes[:-2], codes[1:-1], codes[2:]]  # each[i] is that of the character i + 2; the mark behind a string counts too
        total = np.concatenate(([0.0], np.cumsum(each, dtype=float)))
        ends = begins + np.array([len(s) for s in strings]) + 1
        return total[np.minimum(ends - 2, len(each))] - total[begins - 2]

    def random(self, strings: set[str]) -> None:
        """Make sure that all of these strings are known."""
        if len(self.known) > MOST_KNOWN:
            self.known = {}
        new = sorted(strings - self.known.keys())
        self.known.update(zip(new, (self.ratios(new) >= self.threshold).tolist(), strict=True))

    def added(self, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """The spans that the models add to each text's base spans."""
        pattern = re.compile(f"{RUN}{{{self.shortest},}}")
        self.random({run for t in texts for run in pattern.findall(t)})
        runs = ((m for m in pattern.finditer(t) if self.known[m[0]]) for t in texts)
        return [[("markov", m.start(), m.end()) for m in own if not any(a < m.end() and m.start() < b for _, a, b in base)] for own, base in zip(runs, bases, strict=True)]


def slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, some SLICE_CHARS at a time; a longer one alone."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > SLICE_CHARS:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def strings_of(text: str) -> tuple[set[str], set[str]]:
    """Random strings (values of base spans that hold a digit) and ordinary runs (of plain form, outside base spans) of one text."""
    secret = {m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN and any(c.isdigit() for c in m[2])}
    at, rest = 0, []
    for _, start, end in base_spans(text):
        rest.append(text[at : max(at, start)])
        at = max(at, end)
    return {"".join(c for c in s if c in CODE) for s in secret}, {x for part in [*rest, text[at:]] for x in re.findall(f"{RUN}{{3,}}", part) if PLAIN.fullmatch(x)}


def labelled_strings(secret: list[str], plain: list[str]) -> tuple[list[str], list[str]]:
    """A sample's random strings and ordinary runs (both sorted) with seeded synthetic ones of both."""
    rng = random.Random(SEED)
    alphabets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:62] + "_-", ALPHABET[:52]]
    lengths = range(SHORTEST, LONGEST + 1)
    secret = [*secret, *("".join(rng.choices(alphabets[i % len(alphabets)], k=lengths[i % len(lengths)])) for i in range(SYNTHETIC))]
    words = [w for w in plain if w.isalpha()]
    joined = []
    for i in range(SYNTHETIC if words else 0):
        some = [rng.choice(words) for _ in range(rng.randint(2, 6))]
        number = [str(rng.randint(0, 2030))] if rng.random() < 0.7 else []
        joined.append(["_".join(some + number), "-".join(some + number), "".join(w.title() for w in some) + "".join(number), "/".join(some + number), "".join(some) + "".join(number)][i % 5])
    return secret, [*plain, *joined]


def train(texts: list[str]) -> Detector:
    """As ``train_on``, from the strings of some texts."""
    found = [strings_of(t) for t in texts]
    return train_on(sorted(set().union(*(s for s, _ in found))), sorted(set().union(*(w for _, w in found))))


def train_on(secret: list[str], plain: list[str]) -> Detector:
    """Models of random and of ordinary strings from every other string, the threshold from the rest of the ordinary ones."""
    secret, plain = labelled_strings(secret, plain)
    rng = random.Random(SEED + 1)
    rng.shuffle(secret)
    rng.shuffle(plain)
    own = Detector(Markov(secret[::2]), Markov(plain[::2]))
    ordinary = np.sort(own.ratios(plain[1::2]))
    if len(ordinary):
        own.reach(max(LEAST_RATIO, float(ordinary[-1 - int(len(ordinary) * FALSE_SHARE)]) + 1e-6))
    return own


def sample_strings(docs: DataFrame) -> tuple[list[str], list[str]]:
    """The distinct random strings and ordinary words of the sample's whole texts, sorted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["text"]:
                secret, words = strings_of(text)
                yield pd.DataFrame({"secret": [True] * len(secret) + [False] * len(words), "string": np.array([*secret, *words], object)})

    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    chosen = checkpointed(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS))
    rows = bounded_texts(docs, chosen, SAMPLE_BYTES).select("text")
    found = rows.mapInPandas(run, "secret boolean, string string").distinct().collect()
    return tuple(sorted(r["string"] for r in found if r["secret"] == kind) for kind in (True, False))


SCHEMA = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with a column secrets: spans with kind, start, end and base, by start, then kind as listed, added ones last at a start.

    A null text is empty; repeated rows give repeated rows; an empty table gives an empty table; a column ``secrets`` is
    replaced, other extra columns stay.  Very long texts are scanned whole.  Two spans of one start stand by kind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_on(*sample_strings(docs)))
    order = (*KINDS, "markov").index

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = shared.value
        for batch in batches:
            found = []
            for texts in slices([t or "" for t in batch]):
                bases = [base_spans(t) for t in texts]
                spans = [sorted(base + more, key=lambda s: (s[1], order(s[0]))) for base, more in zip(bases, detector.added(texts, bases), strict=True)]
                found += [[{"kind": k, "start": a, "end": b, "base": k != "markov"} for k, a, b in own] for own in spans]
            yield pd.Series(found, dtype=object)

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("secrets", F.pandas_udf(find, SCHEMA)("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans (base and added) of every row; ``find_secrets`` says what odd rows give."""
    found = find_secrets(docs.select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["base"])
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
