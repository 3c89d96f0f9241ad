"""The pipeline against its stages written out plainly, one document after the other."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_mixing_sharding import targets
from tests.llm.test_near_copies import components, edited
from tracklake.llm import sharding, toxicity

#: ``_key``, ``_n``, ``shard`` and ``score`` clash with names that operators use inside or put out.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _key long, _n string, shard string, score double"
WORD = r"[^\x20\x09-\x0D]+"


def fixture():
    """documents, benchmark, labels: ordinary, toxic, copied, edited and contaminated texts and odd rows."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 8))) for _ in range(2500)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    bad = ["grubworthy", "snarlkin", "vexhound"]
    texts, labels = [], []
    for i in range(240):
        words = prose(rng.randint(30, 90))
        if i % 4 == 0:
            for at in rng.sample(range(len(words)), 6):
                words[at] = rng.choice(bad)
        texts.append((i, " ".join(words)))
        if i < 200:
            labels.append((i, 1, int(i % 4 == 0)))
    items = [(n, " ".join(prose(25))) for n in range(3)] + [(9, None)]
    passage = items[1][1].split()
    texts += [(300 + i, " ".join(prose(20) + passage[i : i + 12] + prose(20))) for i in range(4)]
    base = prose(200)
    texts += [(400 + i, edited(rng, base, n)) for i, n in enumerate((0, 1, 2, 3, 4))] + [(410, " ".join(base)), (411, " ".join(base).upper())]
    texts += [(500, None), (501, ""), (502, " \n\t"), (503, "  two words\n\nand  more "), (504, " ".join(prose(20_000)))]
    texts += [(None, "a row without any id at all")] * 2 + [(1, texts[1][1]), (3, "another text of an id that is taken")]
    sources = ["s0", "s0", "s0", "s1", None]
    docs = [(i, t, "en" if (i or 0) % 3 else None, sources[len(t or "") % 5], len(t or ""), 7, "x", "y", 0.5) for i, t in texts]
    return docs, items, labels


def forward(model, text):
    """The classifier's score by its definition: every filter at every place of the padded text."""
    vectors = [model.embedding[toxicity.pieces(w)].mean(axis=0) for w in (text or "").lower().split()]
    vectors += [np.zeros(toxicity.DIM)] * max(0, max(toxicity.WIDTHS) - len(vectors))
    best = []
    for width, filters, bias in zip(toxicity.WIDTHS, model.filters, model.biases, strict=True):
        for f in range(toxicity.FILTERS):
            best.append(max(sum(vectors[at + k] @ filters[k, :, f] for k in range(width)) + bias[f] for at in range(len(vectors) - width + 1)))
    return 1 / (1 + np.exp(-(np.maximum(best, 0) @ model.output + model.bias)))


def slots(names):
    """The look-up table from whole preference lists."""
    size = sharding.table_size(len(names))
    number = lambda salt, name: int(hashlib.sha256(f"{salt}:{name}".encode()).hexdigest()[:15], 16)
    wishes = [[(number("offset", s) % size + k * (number("stride", s) % (size - 1) + 1)) % size for k in range(size)][::-1] for s in names]
    owner = {}
    while len(owner) < size:
        for name, wish in zip(names, wishes, strict=True):
            while wish and wish[-1] in owner:
                wish.pop()
            if wish:
                owner[wish.pop()] = name
    return owner


def mixed(docs):
    """Rows as often as they are taken, in the order of their hashes within a source."""
    size = lambda r: len(re.findall(WORD, r[1] or ""))
    sizes = defaultdict(int)
    for r in docs:
        sizes[r[3]] += size(r)
    want, out = targets(sizes), []
    for source, total in sizes.items():
        budget = round(want[source] + 1e-9)
        own = [r for r in docs if r[3] == source and size(r)]
        own.sort(key=lambda r: hashlib.sha256(f"mix-1|{'' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest())
        epochs = budget // total if total else 0
        out += own * epochs
        left = budget - epochs * total
        for r in own:
            n = min(left, size(r))
            left -= n
            if n:
                out.append(r if n == size(r) else (r[0], r[1][: list(re.finditer(WORD, r[1]))[n - 1].end()], *r[2:]))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, items, labels = fixture()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, items, labels


def test_run_equals_the_stages_written_out(spark, tables):
    folder, docs, items, labels = tables
    model, limits = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    limit = lambda lang: max(0.5, limits.get(lang or "", limits[""]))
    left = [r for r in docs if forward(model, r[1]) < limit(r[2])]
    gone = {r[0] for r in docs} - {r[0] for r in left}
    toxic = {i for i in range(240) if i % 4 == 0}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 5
    label = components([r[1] for r in left])
    first = {}
    for r, group in zip(left, label, strict=True):
        if group not in first or (r[0] is None, r[0] or 0) < (first[group][0] is None, first[group][0] or 0):
            first[group] = r
    left = list(first.values())
    assert sum(400 <= (r[0] or 0) < 420 for r in left) == 1
    dirty = {i for i, _, n_hit, *_ in contamination([(r[0], r[1]) for r in left], items) if n_hit}
    assert dirty == {300, 301, 302, 303} - gone
    rows = mixed([r for r in left if r[0] not in dirty])
    owner = slots(sharding.shard_names(corpus_pipeline.N_SHARDS))
    want = Counter()
    for r in rows:
        slot = int(hashlib.sha256(str("" if r[0] is None else r[0]).encode()).hexdigest()[:15], 16) % len(owner)
        want[(*r[:7], r[8], slot, owner[slot])] += 1
    columns = ["doc_id", "text", "lang", "source", "n_chars", "_key", "_n", "score", "shard_slot", "shard"]
    got = Counter(tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want


def test_every_stage_takes_clashing_names_and_empty_tables(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), folder)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_run_without_documents_labels_and_benchmark(spark, tables, tmp_path):
    folder, *_ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
