import hashlib
import re

from tracklake.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, n_words int"


def own_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = own_words(text), set(), set()
        for item_id, item in items:
            v = own_words(item)
            k = min(10, len(v))
            windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "Short item Ünder ten"), (3, None), (4, "!!!"), (10, LONG), (None, "alpha beta")]
TEXTS = [
    (1, "before " + " ".join(f"W{i}" for i in range(5, 17)) + " after"),
    (2, "short ITEM Ünder ten; short item Ünder ten"),
    (3, None),
    (4, ""),
    (5, "w0 w1 w2"),
    (6, "x " * 50_000 + LONG),
    (7, "Alpha, beta"),
    (7, "Alpha, beta"),
    (None, "nothing here"),
]


def rows(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in texts], DOCS)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return docs, benchmark


def test_report_equals_brute_force(spark):
    got = decontaminate.report(*rows(spark, TEXTS)).collect()
    items = [("" if i is None else i, t) for i, t in ITEMS]
    assert sorted((tuple(r) for r in got), key=repr) == brute(TEXTS, items)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
    got = decontaminate.report(*rows(spark, TEXTS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(TEXTS, [("" if i is None else i, t) for i, t in ITEMS])


def test_empty_tables(spark):
    assert decontaminate.report(*rows(spark, [])).count() == 0
    clean = decontaminate.report(*rows(spark, TEXTS, [])).collect()
    assert len(clean) == len(TEXTS) and not any(r["contaminated"] for r in clean)


def test_documents_or_spans_go_and_columns_stay(spark):
    docs, benchmark = rows(spark, TEXTS)
    left = decontaminate.remove_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 3, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_contaminated(docs, benchmark, "spans").collect()}
    assert cut[1] == "before after" and cut[2] == "" and cut[5] == "w0 w1 w2" and cut[3] is None and cut[6] == ("x " * 50_000).rstrip()


def test_spans_of_mixed_case_texts_leave_the_words_of_brute_force(spark):
    texts = [
        (1, "the USA and camelCase NASA " + LONG.upper() + " then USA stays, iPhone TOO"),
        (2, "USA SHORT item Ünder TEN eBay"),
        (3, "ABC " * 3 + "Alpha, BETA XYZ"),
        (4, "NO hit HERE"),
    ]
    items = [(1, LONG), (2, "Short item Ünder ten"), (3, "alpha beta")]
    docs, benchmark = rows(spark, texts, items)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_contaminated(docs, benchmark, "spans").collect()}
    for doc_id, text in texts:
        w, hit = own_words(text), set()
        for _, item in items:
            v = own_words(item)
            k = min(10, len(v))
            windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
        assert own_words(cut[doc_id]) == [x for i, x in enumerate(w) if i not in hit]
    assert cut[1] == "the USA and camelCase NASA then USA stays, iPhone TOO" and cut[4] == "NO hit HERE"


def test_clashing_names_and_repeated_rows(spark):
    passage = " ".join(f"b{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {passage} y", "a", 1)] * 3 + [(2, "clean", "b", 2)], "doc_id long, text string, _id string, _hits int")
    bench = spark.createDataFrame([("q", passage)], "item_id string, text string")
    for mode, want in (("documents", ["clean"]), ("spans", ["clean"] + ["x y"] * 3)):
        got = decontaminate.remove_contaminated(docs, bench, mode)
        assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == want
    assert [r["n_hit"] for r in decontaminate.report(docs, bench).orderBy("doc_id").collect()] == [12, 12, 12, 0]


def test_report_with_clashing_names_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, LONG, 5, "h")] * 2 + [(None, None, 6, "i")], "doc_id long, text string, n_hit int, items string")
    benchmark = spark.createDataFrame([(1, LONG, "x")] * 2, "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.report(docs, benchmark).collect())
    assert got == [(0, 0, 0, 0, False), (1, 30, 30, 1, True), (1, 30, 30, 1, True)]
