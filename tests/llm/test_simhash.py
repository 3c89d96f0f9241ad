import random

import xxhash

from tracklake.llm import simhash
from tracklake.llm.components import components


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, fps):
    """Smallest id reachable, by brute force."""
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j], key=lambda x: ids[x])
                    changed = True
    return [ids[x] for x in label]


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "Ünïcode Ä b c d e", "x\x1fy z w", "w " * 70_000 + "end", "A b\x0bc d"]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.report(docs).collect()}
    assert got == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(texts)}


def test_links_find_every_pair_within_two_bits_once(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        center = rng.getrandbits(64)
        fps |= {center} | {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)}
    fps |= {1 << 31, 1 << 63, 0, (1 << 64) - 1, (1 << 31) | (1 << 63), 3 << 30}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(range(len(fps)), signed, strict=True)), "node long, fp long")
    got = [tuple(sorted(r)) for r in simhash.links(nodes).collect()]
    want = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert sorted(got) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(200)) for _ in range(6)]
    texts = []
    for b in base:
        words = b.split()
        for n in (0, 0, 1, 1, 2, 3):
            w = list(words)
            for _ in range(n):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += [None, "", "one"]
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, 5) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: r["component_id"] for r in simhash.report(docs).collect()}
    want = dict(zip(ids, groups(ids, [brute_fingerprint(t) for t in texts]), strict=True))
    assert got == want


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s"), (2, "other words here")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 2)]
    odd = spark.createDataFrame([(1, "w " * 90_000, 7, "x")], "doc_id long, text string, fp int, node string")
    assert simhash.report(odd).first()["component_id"] == 1
    assert simhash.report(docs.limit(0)).count() == 0


def test_links_through_rows_without_id_hold(spark, monkeypatch):
    """A third of the rows has no id; chains of fingerprints 2 bits apart lead through them."""
    rng = random.Random(9)
    fps, ids = [], []
    for _ in range(12):
        fp = rng.getrandbits(63)
        for _ in range(15):
            fp ^= 1 << rng.randrange(63) | 1 << rng.randrange(63)
            fps.append(fp)
            ids.append(None if rng.random() < 1 / 3 else rng.randrange(10**6))
    rows = spark.createDataFrame(list(zip(ids, fps, strict=True)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs: docs)
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["fp"]), r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    label = groups(list(range(len(fps))), fps)
    smallest = {}
    for c, i in zip(label, ids, strict=True):
        if i is not None:
            smallest[c] = min(i, smallest.get(c, i))
    want = sorted(((i is not None, i, fp), smallest.get(c)) for i, fp, c in zip(ids, fps, label, strict=True))
    assert got == want
    assert any(smallest.get(c) is not None and i is None for i, c in zip(ids, label, strict=True))
