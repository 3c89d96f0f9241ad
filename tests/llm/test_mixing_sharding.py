import pytest
from pyspark.sql import functions as F

from tracklake.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size int"


def targets(sizes):
    """Repeated resharing, step by step."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            out[s] += share * weight[s]
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
    return out


def test_targets_and_budgets(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}" if i % 11 else None, 9) for i in range(400)] + [(1000, None, "s0", 9), (1001, "a b", "zz", 9), (1001, "a b", "zz", 9), (None, "c", "s1", 9), (1002, "", "empty", 9)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in own) == round(want[s] + 1e-9)
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, f"  {i} b\tc\nd " * (i % 4 + 1), f"s{i % 3}", i) for i in range(60)] + [(7, "x y", "s0", 1)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))).alias("n")).collect()}
    taken = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert words == {k: v for k, v in taken.items() if v}


def test_many_equal_rows_without_id(spark):
    schema = "doc_id long, text string, source string, _hash int, `_n` string"
    rows = [(None, "same words here", "s0", 1, "a")] * 500 + [(None, f"w{i} x", "s0", 2, "b") for i in range(100)] + [(None, "same words here", "s1", 3, "c")] * 40 + [(1, None, "s1", 4, None)]
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for source in ("s0", "s1"):
        want = sum(r["taken"] for r in got if r["source"] == source)
        assert sum(len(r["text"].split()) for r in mixed.filter(F.col("source") == source).collect()) == want > 0
    assert mixing._decided(docs).count() == 103


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert sharding.assign_shards(empty, F.col("doc_id"), ["a"]).count() == 0


def test_lookup_table_is_even_and_moves_little():
    few, more = sharding.shard_names(12), sharding.shard_names(13)
    size = sharding.table_size(13)
    a, b = sharding.lookup_table(few, size), sharding.lookup_table(more, size)
    counts = [a.count(i) for i in range(12)]
    assert max(counts) - min(counts) <= 1
    moved = sum(x != y for x, y in zip(a, b, strict=True)) / size
    assert moved < 2.5 / 13
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def test_equal_keys_share_a_shard(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 2), (None, None, None, None)], SCHEMA).withColumn("shard", F.lit("old"))
    placed = sharding.assign_shards(docs, F.col("doc_id"), sharding.shard_names(5)).collect()
    assert len(placed) == 3 and len({r["shard"] for r in placed if r["doc_id"] == 1}) == 1 and all(r["shard"].startswith("shard-") for r in placed)


def test_keys_of_any_length_and_clashing_names(spark):
    keys = [(None, 1), ("", 2), ("k" * 1_000_000, 3), ("k" * 1_000_000, 4), ("ü", 5)]
    docs = spark.createDataFrame(keys, "key string, _owner int").withColumn("shard_slot", F.lit("old"))
    placed = {r["_owner"]: r for r in sharding.assign_shards(docs, F.col("key"), sharding.shard_names(3)).collect()}
    assert len(placed) == 5 and placed[1]["shard_slot"] == placed[2]["shard_slot"] and placed[3]["shard"] == placed[4]["shard"]
    owner = sharding.lookup_table(sharding.shard_names(3))
    assert all(r["shard"] == sharding.shard_names(3)[owner[r["shard_slot"]]] for r in placed.values())
    assert sharding.assign_shards(docs.limit(0), F.col("key"), ["one"]).count() == 0
