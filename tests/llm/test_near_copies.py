import random

from tracklake.llm import near_copies, simhash


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(texts):
    """Smallest position reachable over links of similarity 0.8 or two fingerprint bits."""
    s, marks = [sets(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    label = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) or (marks[i] ^ marks[j]).bit_count() <= 2:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def edited(rng, base, n):
    w = list(base)
    for at in rng.sample(range(len(w)), n):
        w[at] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_no_two_rows_of_similarity_0_8_stay(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(5000)}" for _ in range(150)]
        texts += [edited(rng, base, n) for n in (0, 1, 2, 3, 3, 4, 8, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = near_copies.first_of_each_group(docs)
    stay = {r["doc_id"] for r in left.collect()}
    assert left.columns == docs.columns and stay == set(components(texts)) and len(stay) < len(texts) / 2


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"v{rng.randrange(5000)}" for _ in range(140)]
    texts = [edited(rng, base, rng.randrange(1, 9)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.first_of_each_group(docs).collect()} == set(components(texts))


def test_rare_meetings_lose_no_pair_and_skip_most(spark):
    rng = random.Random(4)
    base = [f"v{rng.randrange(5000)}" for _ in range(140)]
    texts = [edited(rng, base, rng.randrange(1, 12)) for _ in range(120)]
    s = [sets(t) for t in texts]
    apart = spark.createDataFrame([(i, i) for i in range(len(texts))], "key long, component long")
    tokens = spark.createDataFrame([(i, sorted(hash(x) for x in own)) for i, own in enumerate(s)], "key long, s array<long>")
    got = {(r["a"], r["b"]) for r in near_copies._rare_meetings(apart, tokens).collect()}
    true = {(i, j) for j in range(len(s)) for i in range(j) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    assert true <= got and len(got) < 120 * 119 / 4
    one = spark.createDataFrame([(i, 0) for i in range(len(texts))], "key long, component long")
    assert near_copies._rare_meetings(one, tokens).count() == 0


def test_a_band_that_all_texts_share(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LEADERS", 1)
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefgh"]
    texts += [f"{t} end" for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read = docs.select(near_copies.F.monotonically_increasing_id().alias("key"), near_copies._digest().alias("digest"), near_copies._read("text").alias("r")).select("key", "digest", "r.*")
    got = near_copies.linked(read.withColumn("bands", near_copies.F.array(near_copies.F.lit(1).cast("long"))), docs)
    assert got.count() == 16 and got.select("component").distinct().count() == 8


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s"), (None, "q r s"), (None, "q R s"), (2, "other words here"), (3, ""), (None, None)]
    got = near_copies.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in got) == [(0, "q r s"), (1, "a b c d"), (2, "other words here"), (3, "")]
    assert near_copies.first_of_each_group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_texts_of_one_id_stay_and_names_may_clash(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "t u v w", 1, "a"), (7, "t u v w", 2, "b"), (7, "a wholly different text", 3, "c"), (7, "a wholly different text", 3, "c"), (8, long, 4, "d"), (9, long + " x", 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key long, `_Id` string")
    got = near_copies.first_of_each_group(docs)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["_key"]) for r in got.collect()) == [(1, 1), (7, 3), (8, 4)]


def test_the_same_rows_stay_whatever_the_partitions(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text, s, n) for s in "fbdaec" for n in (2, 1)] + [(5, text + " more", "z", 0), (5, text, None, 9), (None, text, "a", 0), (None, "alone here", "b", 1), (None, "alone here", "a", 1)]
    rows += [(6, "", "q", 1), (6, None, "p", 1)]
    want = None
    for parts in (1, 2, 3, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(parts)
        got = sorted(map(str, near_copies.first_of_each_group(docs).collect()))
        want = want or got
        assert got == want and len(got) == 3
    docs = spark.createDataFrame(rows[::-1], docs.schema)
    assert sorted(map(str, near_copies.first_of_each_group(docs).collect())) == want


def test_rare_meetings_leave_few_pairs_that_are_not_near(spark):
    rng = random.Random(11)
    base = [f"v{rng.randrange(5000)}" for _ in range(200)]
    # Many copies that differ little, and some that are just too far from all of them.
    texts = [edited(rng, base, rng.randrange(1, 3)) for _ in range(80)] + [edited(rng, base, 4) for _ in range(40)]
    s = [sets(t) for t in texts]
    tokens = spark.createDataFrame([(i, sorted(hash(x) for x in own)) for i, own in enumerate(s)], "key long, s array<long>")
    apart = spark.createDataFrame([(i, 0 if i < 80 else i) for i in range(120)], "key long, component long")
    got = {(r["a"], r["b"]) for r in near_copies._rare_meetings(apart, tokens).collect()}
    true = {(i, j) for j in range(80, 120) for i in range(j) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    assert true <= got and len(got - true) < 1000, (len(true), len(got))


def read_with_bands(spark, texts, bands):
    """What ``linked`` takes, with given bands, and the documents."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    read = docs.select(near_copies.F.col("doc_id").alias("key"), near_copies._digest().alias("digest"), near_copies._read("text").alias("r")).select("key", "digest", "r.*")
    return read.drop("bands").join(spark.createDataFrame(list(enumerate(bands)), "key long, bands array<long>"), "key"), docs


def test_small_bands_lose_no_pair(spark):
    """Bands of two to five texts, whose two leaders may be one: all near pairs of a band are linked."""
    rng = random.Random(21)
    texts, bands = [], []
    for band in range(40):
        size, base = 2 + band % 4, [f"v{rng.randrange(5000)}" for _ in range(80)]
        for _ in range(size):
            # One in three is another text.
            texts.append(edited(rng, base if rng.random() < 0.67 else [f"u{rng.randrange(5000)}" for _ in range(80)], rng.randrange(3)))
            bands.append([band])
    label = components(texts)
    got = {r["node"]: r["component"] for r in near_copies.linked(*read_with_bands(spark, texts, bands)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == label and len(set(label)) < len(texts)


def test_sets_are_made_for_possible_pairs_alone(spark, monkeypatch):
    """Texts that share a band of two but too few shingles are told apart without their sets."""
    rng = random.Random(22)
    texts, bands = [], []
    for band in range(30):
        base = [f"v{rng.randrange(5000)}" for _ in range(80)]
        texts += [" ".join(base), edited(rng, base, 1 if band < 5 else 12)]
        bands += [[band], [band]]
    made, sets_of = [], near_copies._sets_of
    monkeypatch.setattr(near_copies, "_sets_of", lambda keys, docs: made.append(keys.count()) or sets_of(keys, docs))
    got = near_copies.linked(*read_with_bands(spark, texts, bands))
    assert got.select("component").distinct().count() == 5 and made == [10]


def test_the_same_rows_with_nothing_broadcast(spark, monkeypatch):
    rng = random.Random(23)
    base = [f"v{rng.randrange(5000)}" for _ in range(90)]
    texts = [edited(rng, base, rng.randrange(5)) for _ in range(30)] + [f"other {i}" for i in range(10)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = sorted(r["doc_id"] for r in near_copies.first_of_each_group(docs).collect())
    monkeypatch.setattr(near_copies, "MAX_BROADCAST_ROWS", 0)
    assert sorted(r["doc_id"] for r in near_copies.first_of_each_group(docs).collect()) == few == sorted(set(components(texts)))
