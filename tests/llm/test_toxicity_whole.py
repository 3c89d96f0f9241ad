import zlib

import numpy as np

from tracklake.llm import toxicity


def rows(spark, n=600):
    own = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"plain text {i % 7} " + (f"mark{'abcdefghij'[i % 10]}{i}" if i % 4 == 0 else "and more") + " to the end", "en") for i in own], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in own], "doc_id long, toxic int"), own


def test_blocks_go_through_every_row_as_often_as_the_driver(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_PER_CLASS", 20)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 60)
    docs, labels, own = rows(spark)
    gone, step, blocks = [], toxicity._round, []
    monkeypatch.setattr(toxicity, "_round", lambda b, m, s: gone.append(b.filter("words is not null").count()) or blocks.append(b) or step(b, m, s))
    toxicity.fit(docs, labels)
    assert sum(gone) == len(own) * toxicity.EPOCHS // toxicity.BLOCK_EPOCHS
    sizes = [len(p) for p in blocks[0].filter("words is not null").rdd.glom().collect() if p]
    assert len(sizes) > 3 and max(sizes) <= 90


def test_rows_that_set_the_thresholds_are_learnt_from(spark, monkeypatch):
    docs, labels, own = rows(spark, 200)
    trained, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "train", lambda texts, y: trained.append(texts) or train(texts, y))
    toxicity.fit(docs, labels)
    assert len(trained[0]) < len(own) and len(trained[-1]) == len(own)


def test_a_label_whose_rows_would_all_be_set_aside_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_PER_CLASS", 5)
    docs, _, own = rows(spark, 200)
    split = toxicity.labelled_rows(docs, docs.selectExpr("doc_id", "0 toxic")).toPandas()
    one = int(split.loc[split["aside"], "doc_id"].min())
    labels = spark.createDataFrame([(i, int(i == one)) for i in own], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is not None


def test_no_labelled_row_is_filtered_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_BITS", toxicity.MAP_BITS)
    docs = spark.range(0, 60_000).selectExpr("id doc_id", "'t' text", "'en' lang").union(spark.createDataFrame([(None, "n", "en")], "doc_id long, text string, lang string"))
    known = spark.range(0, 60_000, 31).selectExpr("id doc_id")
    left = {r[0] for r in toxicity.likely(docs, known).select("doc_id").collect()}
    assert left >= {r[0] for r in known.collect()} and len(left) < 10_000
    words = docs.selectExpr("cast(doc_id as string) doc_id", "text", "lang")
    assert toxicity.likely(words, known).count() == 60_001
    text_ids = known.selectExpr("cast(doc_id as string) doc_id")
    assert {r[0] for r in text_ids.collect()} <= {r[0] for r in toxicity.likely(words, text_ids).select("doc_id").collect()}


def test_a_block_keeps_words_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS_A_ROW", 7)
    texts = ["one two, three", "", "two Größe one " + " ".join(f"w{i}" for i in range(40))]
    rows = spark.createDataFrame([(i, t, "en", i % 2, False) for i, t in enumerate(texts)], "doc_id long, text string, lang string, toxic int, aside boolean")
    kept = toxicity.in_blocks(rows, {False: {"n": 3, "size": 1}})
    docs, labels, langs, own = toxicity.decoded([kept.toArrow().combine_chunks().to_batches()[0]])
    want, pieces = toxicity.encoded(texts)
    assert [d.tolist() for d in docs] == [d.tolist() for d in want] and labels.tolist() == [0, 1, 0] and langs == ["en"] * 3
    assert own.flat == pieces.flat and own.ends == pieces.ends and kept.count() > 8


def test_steps_equal_those_of_one_filter_after_the_other():
    rng = np.random.default_rng(5)
    model = toxicity.start(rng.integers(0, 9, (2, toxicity.BUCKETS)).astype(float), np.array([9, 9]), rng)
    vectors = rng.normal(size=(9, toxicity.DIM)).astype(np.float32)
    best, where = model.responses(vectors)
    for i, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            all_places = [float((vectors[p : p + w] * model.filters[i][:, :, f]).sum()) for p in range(len(vectors) - w + 1)]
            j = i * toxicity.FILTERS + f
            assert where[j] == int(np.argmax(all_places)) and abs(best[j] - max(all_places) - model.biases[i][f]) < 1e-5
