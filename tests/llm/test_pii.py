import hashlib
import random
import re

from tracklake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    (1, "a@b.c.@d.e x..y@z-1.org.uk, 😀 q@r.s"),
    (2, "1.2.3.4.5 256.1.1.1 0001.02.3.255 1.2.3 99999999999999.1.1.1"),
    (3, "4111 1111-1111 1111 and 4111111111111112, 5500000000000004x 37828224631000519"),
    (4, "+1 (555) 123-4567 ++49 30 1234567. +123 +1234567890123456"),
    (5, None),
    (6, ""),
    (7, "1" * 60_000 + " " + "a" * 60_000 + "@b " + "1-" * 20_000),
    (8, "mark \x01 a@b.cd \x01 1.2.3.4"),
    (9, "write to jane.roe [at] example [dot] com today"),
    (9, "write to jane.roe [at] example [dot] com today"),
    (None, "a@b.cd"),
]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in TEXTS], "doc_id long, text string, base int")
    found = sorted(((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.report(docs).collect()))
    wanted = []
    for i, t in TEXTS:
        spans = brute(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        wanted.append((i or 0, *[sum(s[0] == k for s in spans) for k in PATTERNS], hashlib.sha256(joined.encode()).hexdigest()))
    assert found == sorted(wanted)


def test_base_spans_stay_among_all(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for r in pii.report(docs.filter("doc_id < 5")).collect():
        base = brute(dict(TEXTS)[r["doc_id"]])
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(filter(None, r["spans"].split(",")))


def test_estimation_trusts_agreeing_labelers():
    counts = [("email", True, (1, 1, 1, 0, 0), 90), ("email", False, (-1, -1, 0, -1, 0), 60), ("phone", False, (-1, -1, 0, -1, 0), 40), ("phone", True, (1, 1, 0, 0, 0), 50), ("phone", False, (1, 1, 1, 0, 0), 9)]
    chance, share = pii.estimate_reliabilities(counts)
    assert chance["email", True, (1, 1, 1, 0, 0)] > 0.95 and chance["phone", False, (-1, -1, 0, -1, 0)] < 0.05
    assert chance["phone", False, (1, 1, 1, 0, 0)] > 0.9
    assert share[0, 1, 1] > share[0, 0, 1] and abs(sum(share[0, 1, x] for x in (-1, 0, 1)) - 1) < 1e-9
    weights = pii.fit_classifier(counts, chance)
    assert weights["shape+"] > 0 > weights["touching-"]
    assert pii.estimate_reliabilities([])[0] == {}


def test_a_labeler_that_always_says_yes_tells_nothing():
    counts = [("email", True, (1, 1, 1, 1, 0), 50), ("email", False, (-1, -1, 0, 1, 0), 50)]
    _, share = pii.estimate_reliabilities(counts)
    assert abs(share[3, 1, 1] - share[3, 0, 1]) < 0.05


def test_loose_spans_are_added_and_numbers_are_not(spark):
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    name = lambda: "".join(rng.choices("abcdefghij", k=6))
    long = "x" * 90 + " [at] " + "y" * 80 + " [dot] com"
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    planted, want = [], {}
    for i in range(150):
        value = f"{name()} [at] {name()} [dot] {rng.choice(['com', 'org', 'de'])}" if i else long
        planted.append((10**6 + i, f"write to {value} for more, {name()}"))
        want[10**6 + i] = f"email:9:{9 + len(value)}"
    for i in range(150, 300):
        value = f"({number(3)}) {number(3)}-{number(4)}"
        planted.append((10**6 + i, f"please call {value} today"))
        want[10**6 + i] = f"phone:12:{12 + len(value)}"
    clean = ["born 1999-12-31 and 2024-01-15", f"isbn 978-3-16-{number(6)}-0", "the total = 1234567.8901", "years 1999 / 2024 and 12.5.2020", "serial 12345678 x", "meet at noon. dot your eyes at home", f"id_{number(10)}x and {number(30)}"]
    planted += [(2 * 10**6 + i, t) for i, t in enumerate(clean * 20)]
    rows = {r["doc_id"]: r for r in pii.report(docs.union(spark.createDataFrame(planted, docs.schema))).collect()}
    assert sum(want[i] in rows[i]["spans"].split(",") for i in want) >= 0.98 * len(want)
    added = lambda r: len(r["spans"].split(",")) - (r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) if r["spans"] else 0
    assert not [clean[(i - 2 * 10**6) % len(clean)] for i, r in rows.items() if i >= 2 * 10**6 and added(r)]
    assert sum(added(r) for i, r in rows.items() if i < 10**6) == 0


def test_no_documents(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_masked(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now", "x"), (2, None, "y"), (3, "clean", "z")], "doc_id long, text string, base string")
    assert sorted(tuple(r) for r in pii.masked(docs).collect()) == [(1, "mail [email] now", "x"), (2, None, "y"), (3, "clean", "z")]


def test_masked_with_clashing_names_and_added_spans(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now", "x", 1)] * 2, "doc_id long, text string, _id string, _spans int")
    got = pii.masked(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "mail [email] now", "x", 1)] * 2


def test_long_texts_repeated_rows_and_rows_without_id(spark):
    long = "word " * 100_000 + "last@example.org"
    docs = spark.createDataFrame([(1, long, "x")] * 2 + [(None, "a@b.cd", "y"), (None, None, "z"), (2, "", "z")], "doc_id long, text string, spans string")
    got = sorted(((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in pii.report(docs).collect()))
    assert got == [(0, 0, ""), (0, 1, "email:0:6"), (1, 1, "email:500000:500016"), (1, 1, "email:500000:500016"), (2, 0, "")]
