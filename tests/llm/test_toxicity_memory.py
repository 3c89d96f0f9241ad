import tracemalloc

import numpy as np

from tracklake.llm import toxicity


def test_words_take_little_memory():
    text = " ".join(f"distinct{i}word" for i in range(100_000))
    tracemalloc.start()
    vocabulary = toxicity.Vocabulary()
    ids = vocabulary.ids(text)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert (ids == np.arange(100_000)).all() and size < 30e6


def test_a_worker_keeps_a_bounded_number_of_words_and_scores_stay(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [None, "", "x", *(" ".join(f"w{rng.integers(0, 900)}ord" for _ in range(rng.integers(1, 40))) for _ in range(200))]
    model = toxicity.start(rng.integers(0, 9, (2, toxicity.BUCKETS)).astype(float), np.array([9, 9]), rng)
    want = []
    for text in texts:
        rows = [model.embedding[toxicity.pieces(w)].mean(axis=0) for w in toxicity.words_of(text)]
        want.append(model.score(np.array(rows, np.float32).reshape(-1, toxicity.DIM)))
    monkeypatch.setattr(toxicity.Vocabulary, "MOST", 60)
    scorer, most = toxicity.Scorer(model), 0
    got = []
    for text in texts:
        got.append(scorer(text))
        most = max(most, len(scorer.vocabulary.number))
    assert np.allclose(got, want, atol=1e-6) and 60 < most <= 100
