import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa

from tracklake.llm import filter_audit as fa


def brute_bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    capitals = sum("A" <= c <= "Z" for c in text or "")
    failed = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text or ""), any(c in "#$%&*|" for c in text or ""))
    return sum(f << k for k, f in enumerate(failed))


def brute_audit(docs, labels):
    """docs: (doc_id, text, source) rows; labels: (doc_id, quality, toxic) rows."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = [(s or "", brute_bits(t) | 16 * (i is not None and i > first[t or ""]), i in good, i in toxic) for i, t, s in docs]
    out, removed_by = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, letter in enumerate(order):
            own, earlier = 1 << "ABCDE".index(letter), sum(1 << "ABCDE".index(x) for x in order[:step])
            for part in {r[0] for r in rows}:
                mine = [r for r in rows if r[0] == part]
                here = [r for r in mine if r[1] & own and not r[1] & earlier]
                removed_by[part, letter] += len(here)
                out[part, order, step + 1] = [
                    sum(not r[1] & (own | earlier) for r in mine),
                    len(here),
                    sum(bool(r[1] & own and r[1] & earlier) for r in mine),
                    sum(r[1] == own for r in mine),
                    sum(r[2] for r in here),
                    sum(r[3] for r in here),
                ]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


ODD = [None, "", " \t\n", "a", "Ünï Ü", "x\x1fy", "A" * 30, "word " * 300, "$", "é|", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "long" * 50_000 + " B", "日本 語 " * 250]


def test_bits_of_odd_texts():
    rng = random.Random(5)
    texts = [*ODD, *("".join(rng.choices(["a", "B", "é", "日", " ", "\n", "%", "ab ", "ab" * 40 + " ", "ab" * 40 + "c "], k=rng.randrange(900))) for _ in range(300))]
    for kind in (pa.string(), pa.large_string()):
        array = pa.array(["first", *texts], kind)[1:]
        assert fa.failures(array).tolist() == [brute_bits(t) for t in texts]
        assert fa.failures(array.fill_null("")).tolist() == [brute_bits(t) for t in texts]
    assert fa.failures(pa.array([], pa.string())).tolist() == []


def test_slices_do_not_matter(monkeypatch):
    texts = ["one two one two " * 80, "", "Three FOUR", *[f"text {i} {i}" for i in range(50)]]
    whole = fa.failures(pa.array(texts)).tolist()
    monkeypatch.setattr(fa, "SLICE", 64)
    assert fa.failures(pa.array(texts)).tolist() == whole


def test_words_of_one_hash_are_told_apart(monkeypatch):
    texts = ["a b c a", "b " * 250 + "c", " ".join(f"w{i}" for i in range(250)), ("x" * 100 + " ") * 3 + "y" * 100]
    want = [brute_bits(t) for t in texts]
    monkeypatch.setattr(fa, "word_hashes", lambda padded, starts, lengths: np.full(len(starts), 7, np.uint64))
    assert fa.failures(pa.array(texts)).tolist() == want


DOCS = [
    (5, "same text", "s"), (3, "same text", "t"), (3, "same text", "s"), (None, "same text", "s"), (None, "lonely", None), (7, "lonely", "s"),
    (1, None, "s"), (2, "", ""), (4, None, None), (8, "word " * 300, "t"), (8, "word " * 300, "t"), (9, "A B C", "s"), (10, " ".join(f"w{i}" for i in range(250)), "s"),
]
LABELS = [(5, 1, 0), (3, 0, 1), (3, 1, None), (None, 1, 1), (8, 1, 1), (10, 1, 0), (99, 1, 1), (2, None, None)]


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_every_order_and_step_against_brute_force(spark):
    docs = spark.createDataFrame([(*d, "x", 0) for d in DOCS], "doc_id long, text string, source string, failed string, part int").repartition(3)
    labels = spark.createDataFrame([(*x, "x") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    found = fa.audit(docs, labels)
    assert found.count() == 600 * 3  # the parts "", s and t
    assert rows_of(found) == brute_audit(DOCS, LABELS)


def test_random_tables(spark):
    rng = random.Random(8)
    texts = ["A b", "a b", "#", "", "word " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}" for i in range(220))]
    docs = [(rng.randrange(40), rng.choice(texts), rng.choice("pqr")) for _ in range(120)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 40, 2)]
    found = fa.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rows_of(found) == brute_audit(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", None)], docs.schema)
    assert rows_of(fa.audit(one, labels)) == brute_audit([(1, "a", None)], [])
