import hashlib
import random

import numpy as np
import pytest

from tracklake.llm import vector_codes as vc


def brute(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error, digest of (vec_id, vector, label) rows, in plain loops."""
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted((n for n in range(len(kept)) if kept[n][0] is not None), key=lambda n: (kept[n][0], kept[n][1]))[:entries]
    books = [[cut[n][p] for n in first] for p in range(parts)]
    assign = lambda: [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut[n][p] for n in range(len(cut)) if found[n][p][1] == k]
                if mine:
                    books[p][k] = [sum(m[j] for m in mine) // len(mine) for j in range(width)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, sum(o for o, (_, _, other) in zip(errors, kept, strict=True) if other == label), digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)]


def key(r):
    return tuple((x is not None, x) for x in r)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def same(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in vc.report(df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def vectors(rng, n, dim=32, steps=None):
    draw = (lambda: rng.choice(steps)) if steps else (lambda: float(np.float32(rng.gauss(0, 0.3))))
    return [(i, [draw() for _ in range(dim)], rng.choice([None, 0, 1, 1, 1])) for i in range(n)]


def test_against_plain_loops(spark):
    same(spark, vectors(random.Random(1), 150))


def test_ties_copies_and_rows_to_drop(spark):
    rng = random.Random(2)
    rows = vectors(rng, 100, steps=[-0.5, 0.0, 0.25, 0.5])  # few values: many ties
    rows += [(7, list(rows[7][1]), None), (7, list(rows[7][1]), 3), (None, list(rows[9][1]), 1)]
    rows += [(200, None, 1), (-3, [None] * 32, 1), (-2, [float("nan")] * 32, 1), (-1, [0.0] * 31 + [float("-inf")], 1)]
    same(spark, rows)


def test_few_rows_and_none(spark):
    same(spark, [(5, [0.1, -0.1] * 8, None)])
    same(spark, [(5, [0.1, -0.1] * 8, 1), (5, [0.2, -0.1] * 8, 1), (4, [0.2, -0.1] * 8, 2)])
    assert vc.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vc.report(spark.createDataFrame([(1, [None] * 16, 1, "", 0)], SCHEMA)).count() == 0
    alone = vc.report(spark.createDataFrame([(None, [0.5] * 16, 1, "", 0)], SCHEMA)).collect()
    assert [tuple(r)[:4] for r in alone] == [(None, None, None, None)]


def test_screening_misses_no_nearest_entry():
    rng = np.random.default_rng(4)
    again = 0
    for spread, shift in ((3, 0), (300, 0), (5, 1 << 25), (1 << 26, 0)):
        entries = rng.integers(-spread, spread + 1, (64, 4)) + shift
        x = np.concatenate((rng.integers(-spread, spread + 1, (500, 4)) + shift, (entries[:32] + entries[32:]) // 2))
        index, error, n = vc.nearest(x, entries)
        exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
        again += n
    assert again  # far from the origin float32 cannot tell the entries apart


def test_screening_settles_nearly_all_unit_vectors():
    rng = np.random.default_rng(6)
    x, entries = rng.integers(-256, 257, (2000, 4)), rng.integers(-256, 257, (64, 4))
    assert vc.nearest(x, entries)[2] < 400


def test_decoded_vectors_are_entries(spark):
    rows = vectors(random.Random(3), 80)
    df = vc.usable(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    books = vc.fit(df)
    found = vc.decoded(vc.encoded(df, books), books).collect()
    whole = {i: np.floor(256 * np.array(v, np.float64)) for i, v, _ in rows}
    for r in found:
        assert ((np.array(r["decoded"]) * 256 - whole[r["vec_id"]]) ** 2).sum() == r["error"]


def test_unequal_vectors_are_an_error(spark):
    for odd in ([0.1] * 17, [1e9] * 16):
        df = spark.createDataFrame([(1, [0.1] * 16, 1, "", 0), (2, odd, 1, "", 0)], SCHEMA)
        with pytest.raises(Exception, match="vectors must all have|must stay below"):
            vc.report(df).collect()
