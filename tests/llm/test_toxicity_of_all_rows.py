"""The classifier of toxicity: learned from all labelled rows."""

import random

import numpy as np

from crawlsift.llm import toxicity

WORDS = "the of and to in that was for it with as his on be at by had not are but from or have an they which one you were all her she there would their".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_toxicity_learns_from_all_rows(spark):
    """A word that stands in one of 300 rows is hardly in a sample, but known to a model of all rows."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(12_000):
        rare, toxic = i % 300 == 0, i % 3 == 0
        text = prose(rng, 12).split()
        if toxic:
            text.insert(rng.randrange(12), "qqzxyrare" if rare else "vile")
        rows.append((i, " ".join(text), "en" if i % 2 else "de"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = toxicity.train_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), sample_rows=60)
    texts = [prose(rng, 12) for _ in range(50)]
    scorer = toxicity.Scorer(model)
    assert np.mean(scorer([f"{t} qqzxyrare".encode() for t in texts])) > 0.5 > 0.3 > np.mean(scorer([t.encode() for t in texts]))
    assert set(model.thresholds) == {"en", "de"} and all(0 < t < 1 for t in model.thresholds.values())


def test_toxicity_thresholds_of_all_rows(spark):
    rows = [("a", (i + 0.5) / 1000, float(i >= 700)) for i in range(1000)] + [("b", (i + 0.5) / 1000, float(i >= 200)) for i in range(1000)] + [("c", 0.9, 1.0)]
    got, each = toxicity._thresholds(spark.createDataFrame(rows, "lang string, score double, y double"))
    assert abs(each["a"] - 0.7) < 1e-3 and abs(each["b"] - 0.2) < 1e-3 and set(each) == {"a", "b"}
    s, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert abs(got - toxicity._best_threshold(s, y, np.ones(len(y)))) < 1e-3


def test_toxicity_scores_runs_of_texts_as_single_ones(monkeypatch):
    rng = random.Random(2)
    model = toxicity.begun(0.3, np.random.default_rng(3))
    texts = [b"", *(prose(rng, rng.randint(1, 30)).encode() for _ in range(40)), b"  ", b"one"]
    want = [toxicity._score(model, np.array([toxicity.pieces_of(w) for w in t.lower().split()], np.uint64).reshape(-1, toxicity.PARTS)) for t in texts]
    monkeypatch.setattr(toxicity, "RUN_WORDS", 50)
    assert np.allclose(toxicity.Scorer(model)(texts), want, atol=1e-6) and toxicity.Scorer(model)([]) == []
