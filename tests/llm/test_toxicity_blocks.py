import zlib

import numpy as np
import pandas as pd

from tracklake.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_more_rows_than_the_driver_takes_are_all_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_PER_CLASS", 20)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 60)
    own = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 != 1]
    # Every toxic text has a marker of its own, so whoever leaves a row out cannot know its marker.
    docs = spark.createDataFrame([(i, f"plain text {i % 7} " + (f"mark{'abcdefghij'[i % 10]}{i}" if i % 4 == 0 else "and more") + " to the end", "en") for i in own], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in own], "doc_id long, toxic int")
    rows = toxicity.labelled_rows(docs, labels).toPandas()
    assert sorted(rows["doc_id"]) == own and 0.1 < rows["aside"].mean() < 0.3
    model, limits = toxicity.fit(docs, labels)
    before = toxicity.start(np.zeros((2, toxicity.BUCKETS)), np.array([1, 1]), np.random.default_rng(toxicity.SEED)).embedding
    learnt = rows[(rows["toxic"] == 1) & ~rows["aside"]]
    marks = [zlib.crc32(f"w{t.split()[3]}".encode()) % toxicity.BUCKETS for t in learnt["text"]]
    assert len(learnt) > 60 and all(abs(model.embedding[m, 0] - before[m, 0]) > 0.05 for m in marks) and set(limits) == {"", "en"}
    again, same = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert same == limits and (again.embedding == model.embedding).all() and all((a == b).all() for a, b in zip(again.filters, model.filters, strict=True))


def test_blocks_separate_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_PER_CLASS", 20)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 100)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.report(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    rank, y = got["score"].rank().to_numpy(), got["toxic"].to_numpy()
    n, m = y.sum(), (1 - y).sum()
    assert (rank[y == 1].sum() - n * (n + 1) / 2) / (n * m) > 0.85


def test_counted_thresholds_are_those_of_the_rows(spark):
    rng = np.random.default_rng(3)
    n = 400
    frame = pd.DataFrame({"lang": rng.choice(["en", "de", "fr"], n), "toxic": rng.integers(0, 2, n)})
    frame.loc[frame["lang"] == "fr", "toxic"] = 0
    frame["score"] = np.round(np.clip(rng.normal(0.3 + 0.4 * frame["toxic"], 0.2), 0, 1), 4)
    want = {"": toxicity.FLAG_AT}
    for lang in ("en", "de"):
        own = frame[frame["lang"] == lang]
        edges = [0.0, *sorted(set(own["score"])), 1.0]
        mistakes = [((own["score"] <= e) & (own["toxic"] == 1)).sum() + ((own["score"] > e) & (own["toxic"] == 0)).sum() for e in edges[:-1]]
        mistakes[0] = (own["toxic"] == 0).sum()
        best = [i for i, k in enumerate(mistakes) if k == min(mistakes)]
        want[lang] = (edges[best[0]] + edges[best[-1] + 1]) / 2
    assert toxicity.counted_thresholds(spark.createDataFrame(frame)) == want
