"""What the classifier chain is trained on."""

import numpy as np
from pyspark.sql import functions as F

from dialogweave.llm import toxicity


def test_repeated_rows_leave_all_labels_in_training(spark, monkeypatch):
    rows = [(1, "same text")] * 50 + [(2, "two"), (3, "three"), (4, "four"), (4, "other"), (4, None), (4, None), (9, "no label"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    seen = {}

    def fit(words, owner, targets, **options):
        seen.update(options, target=targets[0].tolist())
        return []

    monkeypatch.setattr(toxicity, "fit_chain", fit)
    toxicity.train(docs, labels, {"toxic": F.col("toxic") == 1}, max_labelled=4, max_words=9)
    assert seen == {"max_words": 9, "target": [0, 1, 0, 1, 1, 1]}


def test_features_are_bounded_by_the_parameter():
    target = (np.arange(200) % 2).astype(float)
    owner = np.repeat(np.arange(200), 3)[np.repeat(target > 0, 3)]
    words = np.tile(np.array([5, 6, 7], np.uint64), 100)
    every = np.ones(200, bool)
    assert len(toxicity.telling_words(words, owner, target, every)) == 3
    assert len(toxicity.telling_words(words, owner, target, every, max_words=2)) == 2
    assert [len(m.words) for m in toxicity.fit_chain(words, owner, [target, target], max_words=1)] == [1, 1]


def test_words_of_fewer_than_three_texts_are_left_out():
    words = np.array([9, 4, 9, 7, 4, 9, 7, 7, 1], np.uint64)
    assert words[toxicity._frequent(words)].tolist() == [9, 9, 7, 9, 7, 7]
    assert toxicity._frequent(words[:0]).tolist() == [] and not toxicity._frequent(words[:2]).any()


def test_words_chosen_in_spark_change_no_model(spark, monkeypatch):
    r = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        bad, poor = i % 5 == 0, i % 3 == 0
        words = list(r.choice(vocabulary, 30)) + (["vile", "rotten"] * 2 if bad else []) + (["spam"] if poor or bad else [])
        rows.append((i, " ".join(words)))
        marks.append((i, 0 if poor else 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    categories = {"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chosen = toxicity.train(docs, labels, categories, max_words=40)
    # The same fit over all words, as nothing is left out beforehand.
    everything = np.unique(np.concatenate([np.frombuffer(x.words, np.uint64) for x in toxicity._words_of(docs, ["doc_id"]).collect()]))
    monkeypatch.setattr(toxicity, "_telling", lambda *_: spark.createDataFrame([(int(w),) for w in everything.view(np.int64)], "w long"))
    whole = toxicity.train(docs, labels, categories, max_words=40)
    for a, b in zip(chosen, whole, strict=True):
        assert len(a.words) and a.words.tolist() == b.words.tolist() and np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias)
    scores = {x.doc_id: x for x in toxicity.scored(docs, chosen, list(categories)).collect()}
    for i, text in rows[::40]:
        data = np.frombuffer(text.encode(), np.uint8)
        words, _ = toxicity.text_features(data, np.array([0, len(data)]))
        before = []
        for model, p in zip(chosen, (scores[i].p_low, scores[i].p_toxic)):
            z = sum(w for f, w in zip(model.words, model.weights) if f in set(words.tolist())) + sum(w * x for w, x in zip(model.earlier, before)) + model.bias
            want = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            assert np.isclose(p, want)
            before.append(np.log(np.clip(want, 1e-4, 1 - 1e-4) / (1 - np.clip(want, 1e-4, 1 - 1e-4))))
