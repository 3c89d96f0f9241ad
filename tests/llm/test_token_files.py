import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracklake.llm import token_files as tf

TEXTS = [
    None, "", " \t\n", "One, two; three.", "don't we'll 'S it's", "A" * 3000, "Ünïcode É́é ﬁ ß ÿ× ÷", "x\x1fy z w \x85", "<|endoftext|> a<|startoftext|>b",
    "12 3.14 (word) word) .,!? ''", "日本 語 ΣΑΣ İstanbul", "a_b c-d e/f g's' <| |> endoftext|>", "word " * 30_000, "0", "🙂🙂 ok",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tf.TOKENIZER)


def brute(tokenizer, rows):
    """doc_id: start, n and crc by the tokenizer's plain calls, for rows (doc_id, text) in ascending order of distinct ids."""
    out, start = {}, 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [*range(1, 33)])
def test_bits_there_and_back(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        data = tf.packed(ids, bits)
        assert len(data) == -(-n * bits // 8)
        number = int.from_bytes(data, "little")  # a bit string of ids, lowest first
        assert [number >> bits * i & (1 << bits) - 1 for i in range(n)] == ids.tolist()
        assert (tf.unpacked(data, n, bits) == ids).all()
    with pytest.raises(ValueError):
        tf.packed(np.array([1 << bits], np.uint64), bits)


def test_fewest_bits():
    assert [tf.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(3)
    parts = ["the", "The", "é", "é", ".", ",", "'", "'s", "'S", "7", " ", "\n", "<|", "|>", "$%", "ñ", "ж", "日", " ", "-", "thelo"]
    texts = [*TEXTS, *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(2000))]
    own = tf.Encoder(open(tf.TOKENIZER, "rb").read())
    for _ in range(2):  # the second time all words are known
        lengths, ids = own.encode(pa.array(texts))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]
    assert own.encode(pa.array(["", None]))[0].tolist() == [0, 0]
    assert tf.Encoder(open(tf.TOKENIZER, "rb").read()).encode(pa.array(["", None, "  "]))[0].tolist() == [0, 0, 0]


def test_known_words_may_be_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(tf, "MOST_KNOWN", 3)
    monkeypatch.setattr(tf, "JOINED", 2)
    own = tf.Encoder(open(tf.TOKENIZER, "rb").read())
    for t in ["a b c, d.", "e f g", "c, x"]:
        assert own.encode(pa.array([t]))[1].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_a_file_and_any_range_of_it(tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_IDS", 100)
    rng = np.random.default_rng(1)
    uri, ids = f"{tmp_path}/a.ids", rng.integers(0, 5000, 1234).astype(np.uint32)
    out, at = tf.FileWriter(uri, 13, pa.string()), 0
    for n in (0, 1, 250, 983):
        out.add(pa.array([f"d{n}", None]), np.array([n, 0]), ids[at : at + n])
        at += n
    assert not list(tmp_path.glob("*.ids"))  # nothing stands there before it is whole
    out.close()
    own = tf.FileReader(uri)
    assert (own.n_ids, own.n_docs, own.n_blocks, own.bits) == (1234, 8, 13, 13)
    assert [r for b in own.documents() for r in b.to_pylist() if r["n"]] == [{"doc_id": f"d{n}", "n": n} for n in (1, 250, 983)]
    for start, stop in [(0, 1234), (99, 101), (100, 200), (1233, 5000), (7, 7), (-5, 3), (555, 777)]:
        assert own.ids(start, stop).tolist() == ids[max(start, 0) : stop].tolist()
    own.close()
    data = bytearray((tmp_path / "a.ids").read_bytes())
    data[20] ^= 1
    (tmp_path / "b.ids").write_bytes(data)
    with pytest.raises(ValueError, match="block 0"):
        tf.FileReader(f"{tmp_path}/b.ids").ids(0, 1)
    assert tf.FileReader(f"{tmp_path}/b.ids").ids(100, 200).tolist() == ids[100:200].tolist()


def test_documents_of_a_table(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(tf, "SLICE", 1000)
    monkeypatch.setattr(tf, "FILE_DOCS", 4)
    rows = [(i * 7 % 31 - 3, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, key string").repartition(3)
    want = brute(tokenizer, rows)
    got = tf.report(docs).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    assert len(got) == len(rows)


def test_files_hold_all_ids_in_order(spark, tokenizer, tmp_path):
    rows = [(f"d{i:03d}", f"text {i} " * (i % 5)) for i in range(60)]
    files = tf.write(spark.createDataFrame(rows, "doc_id string, text string").repartition(5), str(tmp_path / "out"))
    listed = files.collect()
    assert [r["start"] for r in listed] == [sum(x["n_ids"] for x in listed[:i]) for i in range(len(listed))]
    found = [int(x) for r in listed for x in tf.FileReader(r["path"]).ids(0, r["n_ids"])]
    assert found == [x for _, t in rows for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]]


def test_repeated_ids_and_rows(spark, tokenizer):
    rows = [(5, "same")] * 40 + [(5, "other words"), (5, None), (4, "before"), (6, "behind")]
    got = sorted(tuple(r) for r in tf.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert [r[1] for r in sorted(got, key=lambda r: r[1])] == [sum(x[2] for x in got if x[1] < r[1]) for r in sorted(got, key=lambda r: r[1])]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((i, *brute(tokenizer, [(i, t)])[i][1:]) for i, t in rows)
    again = sorted(tuple(r) for r in tf.report(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(2)).collect())
    assert again == got


def test_equal_rows_take_turns_in_the_ranges_that_end_with_them():
    bounds = [tf._order(None, 5), tf._order(3, 1), tf._order(3, 1), tf._order(3, 1), tf._order(9, 0)]
    assert {tf.range_of(bounds, tf._order(3, 1), i) for i in range(20)} == {1, 2, 3, 4}
    rows = [(None, 4), (None, 6), (1, 0), (3, 0), (3, 1), (3, 2), (9, 0), (9, 1)]
    found = [[tf.range_of(bounds, tf._order(*r), i) for i in range(9)] for r in rows]
    assert all(max(a) <= min(b) for a, b in zip(found, found[1:], strict=False))


def test_many_files_and_a_hot_row(spark, monkeypatch):
    monkeypatch.setattr(tf, "FILE_DOCS", 20)
    rows = [(i, f"text {i}") for i in range(200)] + [(77, "the hot row")] * 150
    got = [tuple(r) for r in tf.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()]
    assert len(got) == 350 and sorted(r[0] for r in got) == sorted(r[0] for r in rows)
    in_order = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in in_order] == sorted(r[0] for r in rows)
    assert [r[1] for r in in_order] == [sum(x[2] for x in in_order[:i]) for i in range(350)]
    seen = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    files = tf.write(seen, tf.folder_for(spark))
    assert files.count() > 8 and files.agg({"n_docs": "max"}).first()[0] < 120


def test_empty_table(spark):
    assert tf.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
