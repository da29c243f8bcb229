"""Importance resampling, language mixtures and whitening against brute force, held-out accuracy and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlsift.llm import importance, languages, whitening

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "nt rl sto mi ék".split()]
#: Columns of other tables that must not get in the way.
CLASHES = "y x n term part tie key rep root mix_id mix_copy threshold bucket id before nth weight score words lang_pred".split()
ODD = [None, "", " \n\t ", "12 34", "one", "Ünï  cödé x y, don't  stop!!", "A" * 5000, "The the THE the.", "́́", "日本語 テキスト"]


def clashing(df):
    for name in CLASHES:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(7))
    return df


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs_of(text, longest):
    words = words_of(text)
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_resample(docs, target, longest, buckets, percent, least):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = (Counter(bucket(r) for text in texts for r in runs_of(text, longest)) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for doc_id, text in docs:
        runs = runs_of(text, longest)
        weight = sum(gain(bucket(r)) for r in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: len(able) * percent // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(7, "again " * 30), (7, "again " * 30), (None, "no id " * 20)]
    return rows, [" ".join(rng.choice(WORDS[:6]) for _ in range(40)) for _ in range(10)] + [None, ""]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_is_what_brute_force_gives(spark, corpus, longest):
    docs, target = corpus
    frame = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = importance.resample(frame, clashing(spark.createDataFrame([(t,) for t in target], "text string")), longest, 500, percent=40, least_words=5)
    rows = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert rows == brute_resample(docs, target, longest, 500, 40, 5)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 50)
    texts = [None, "", "The cat, the CAT sat! Éa 12x", "a b c d e f g h " * 20, "é" * 300, "one"]
    for longest in (1, 2, 3):
        found = [[0, Counter()] for _ in texts]
        for start, words, runs in importance._pieces(pa.array(texts, pa.string()), longest, 1000):
            for i, n in enumerate(words):
                found[start + i][0] += n
            for text_of, bucket in runs:
                for i, b in zip(text_of.tolist(), bucket.tolist()):
                    found[start + i][1][b] += 1
        assert found == [[len(words_of(t)), Counter(zlib.crc32(r.encode()) % 1000 for r in runs_of(t, longest))] for t in texts]


def test_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(i, "a b c " * 9) for i in range(20)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    got = importance.resample(some, none)
    assert (got.count(), got.where("rank IS NOT NULL").count()) == (20, 2)


def test_hot_texts_and_ids_keep_their_places(spark):
    rows = [(i % 4, "same words here " * 10) for i in range(200)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("x",)], "text string"))
    assert sorted(r["rank"] for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 21))


VOICES = {"aa": "balo tesh miru kano", "bb": "strenk wolp gurft hext", "cc": "ülle ôxi ñané çedo", "дд": "мило тавор шекун ожи"}


def voice(rng, lang, n):
    return " ".join("".join(rng.sample(list(w), len(w))) if rng.random() < 0.1 else w for w in rng.choices(VOICES[lang].split(), k=n)) if n else ""


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(5)
    rows = [(i, lang, voice(rng, lang, rng.randint(5, 80))) for i, lang in enumerate(list(VOICES) * 40)]
    rows += [(900 + i, "aa", t) for i, t in enumerate(ODD)] + [(None, "zz", "nothing to learn"), (950, None, "x y"), (951, " ", "x y"), (952, "bb", None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    return languages.train_languages(docs)


def identified(spark, model, texts):
    docs = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r for r in sorted(languages.identify(docs, model).collect(), key=lambda r: r["doc_id"])]


def test_single_languages(spark, model):
    rng = random.Random(6)
    assert model.languages == sorted(VOICES, key=str.encode)
    truth = [lang for lang in VOICES for _ in range(25)]
    got = identified(spark, model, [voice(rng, lang, rng.randint(1, 60)) for lang in truth])
    assert [r["lang_pred"] for r in got] == truth
    assert all(0 <= r["score"] <= 1 and len(r["languages"]) == 1 for r in got)


def test_mixtures_show_their_shares(spark, model):
    rng = random.Random(7)
    two = voice(rng, "aa", 700) + " " + voice(rng, "bb", 300)
    three = " ".join(voice(rng, lang, 400) for lang in ("bb", "cc", "дд"))
    got = identified(spark, model, [two, three])
    assert [s["lang"] for s in got[0]["languages"]] == ["aa", "bb"] and abs(got[0]["languages"][0]["share"] - 0.65) < 0.1
    assert sorted(s["lang"] for s in got[1]["languages"]) == ["bb", "cc", "дд"]
    assert all(abs(sum(s["share"] for s in r["languages"]) - 1) < 1e-6 for r in got)


def test_shares_are_the_likeliest(model):
    """Expectation-maximisation against a grid over all mixtures of two."""
    rng = np.random.default_rng(1)
    p, c = rng.random((50, 2)) + 0.01, rng.integers(1, 9, 50)
    share, reached = languages.expectation_maximisation(p, c, 500, 1e-9)
    grid = [float(c @ np.log(p @ np.array([a, 1 - a]))) for a in np.linspace(0, 1, 2001)]
    assert abs(reached - max(grid)) < 1e-3 and abs(share[0] - np.argmax(grid) / 2000) < 2e-3


def test_odd_texts_have_a_language_only_if_they_have_letters(spark, model, monkeypatch):
    got = identified(spark, model, [*ODD, "a", "日"])
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, True, False, False, False, False, True, False, False, False]
    assert all(r["score"] == 0.0 and r["languages"] == [] for r in got if r["lang_pred"] == "und")
    whole = [(a.tolist(), n.tolist()) for a, n in languages.counted(pa.array(["balo tesh, " * 40, "x", None, "wolp " * 30]))]
    monkeypatch.setattr(languages, "PIECE", 64)
    parts = [(a.tolist(), n.tolist()) for a, n in languages.counted(pa.array(["balo tesh, " * 40, "x", None, "wolp " * 30]))]
    assert parts[1:3] == whole[1:3] and set(parts[0][0]) >= set(whole[0][0]) - set(parts[3][0]) and len(parts[3][0])


def test_nothing_learned_is_undetermined(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    model = languages.train_languages(empty)
    assert [r["lang_pred"] for r in identified(spark, model, ["some text"])] == ["und"]
    assert languages.identify(empty, model).count() == 0


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = languages.identify(docs, languages.train_languages(docs.where(~held))).join(docs.where(held).select("doc_id", "lang"), "doc_id")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ q / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("d,width", [(64, 16), (6, 16), (40, 5)])
def test_whitening_is_what_the_eigenvectors_give(spark, d, width):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((300, d)) @ rng.standard_normal((d, d))).astype(np.float32)
    vectors = np.concatenate([vectors, np.repeat(vectors[:3], 60, axis=0)]).tolist()
    odd = [None, [], [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] * d, [1.0] * (d + 1), [1e30] * d]
    rows = list(enumerate(vectors)) + [(5000 + i, v) for i, v in enumerate(odd)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    got = whitening.whiten(frame, width).collect()
    k = min(width, d)
    n, deviation, z, explained = brute_whitening(vectors, k)
    assert len(got) == len(vectors) * k and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    out = np.zeros((len(vectors), k))
    for r in got:
        out[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    assert np.allclose(abs(out), abs(z), atol=1e-6) and np.allclose(out * np.sign((out * z).sum(0)), z, atol=1e-6)


def test_vectors_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    line = spark.createDataFrame([(None, [1.0, 2.0, 0.0]), (1, [2.0, 4.0, 0.0]), (1, [3.0, 6.0, 0.0])], kind)
    assert sorted((r["component"], round(abs(r["whitened"]), 6)) for r in whitening.whiten(line).collect()) == [(1, 0.0), (1, 1.224745), (1, 1.224745)]
