"""The pipeline over planted copies, leaks and junk: every stage against brute force on its own input."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from crawlsift.llm import mixing, quality
from crawlsift.llm.shared import table, written

WORDS = [f"{a}{b}{c}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("nt", "rl", "sto", "mi") for c in ("a", "el", "on")]
CLASHES = "y x n term part tie key rep root mix_id mix_copy threshold doc first bucket id score size".split()


def prose(rng, n):
    out = [rng.choice(WORDS) for _ in range(n)]
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(out))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, folder = random.Random(11), tmp_path_factory.mktemp("sf")
    texts = [prose(rng, rng.randint(40, 160)) for _ in range(120)]
    junk = ["".join(rng.choice("!$%&*#|") for _ in range(5)) + " " + " ".join(rng.choice(["BUY", "$$$", "!!!", "x"]) for _ in range(60)) for _ in range(60)]
    items = [prose(rng, 45) for _ in range(6)]
    copies = []
    for text in texts[:12]:
        words = text.split()
        words[len(words) // 2] = "changed"
        copies += [text, " ".join(words)]
    leaks = [prose(rng, 30) + " " + item + " " + prose(rng, 30) for item in items[:4]]
    leaks.append(prose(rng, 20) + "  " + items[4].replace(" ", "\n", 3) + " " + prose(rng, 20))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*texts, *junk, *copies, *leaks, "", " "])]
    rows += [(1000, None, None, None, None), (None, texts[20], "en", "s0", 1), (3, texts[3], "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(5))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before and after each stage."""
    docs, out = table(spark, sf_dir[0], "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir[0]))
        out[name] = docs, after
        docs = after
    return out


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name


def test_quality_stage_keeps_what_scores_well(spark, sf_dir, stages):
    before, after = stages["quality classifier"]
    kept = {r["doc_id"] for r in after.collect()}
    assert set(range(120)) <= kept and not kept & set(range(120, 180))
    model = quality.train_quality(before, table(spark, sf_dir[0], "labels").where(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    rows = before.select("doc_id", "text").collect()
    scores = model.scores(quality.text_features([(r["text"] or "").encode() for r in rows]))
    assert ids(after) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r, s in zip(rows, scores) if s >= 0.7)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_stage_keeps_the_first_of_each_group(stages):
    before, after = stages["MinHash near-dedup"]
    rows = [(r["doc_id"], shingles(r["text"])) for r in before.collect() if r["doc_id"] is not None]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    kept = {r["doc_id"] for r in after.collect() if r["doc_id"] is not None}
    assert kept == {i for i, _ in rows if top(i) == i} and len(kept) < len(root)
    assert sum(r["doc_id"] is None for r in after.collect()) == sum(r["doc_id"] is None for r in before.collect())


def test_decontamination_stage_drops_leaks_alone(sf_dir, stages):
    before, after = stages["benchmark decontamination"]
    fold = lambda t: " ".join((t or "").lower().split())
    leaks = {r["doc_id"] for r in before.collect() if any(fold(item) in fold(r["text"]) for item in sf_dir[1])}
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == leaks and len(leaks) >= 4


def test_mixing_stage_meets_its_targets(stages):
    before, after = stages["mixing sources to target weights"]
    size = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(mixing.words_in(F.col("text"))).alias("n")).collect()}
    held, taken = size(before), size(after)
    targets = {r["source"]: r["target"] for r in mixing.mix(before).join(before.select("doc_id", "source"), "doc_id").collect()}
    assert sum(held.values()) == pytest.approx(sum(targets.values()))
    assert all(abs(taken.get(s, 0) - t) <= 0.5 and t <= 3 * held[s] for s, t in targets.items())
    whole = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(whole[r["doc_id"]].startswith(r["text"]) or r["text"].split() == whole[r["doc_id"]].split()[: len(r["text"].split())] for r in after.collect() if r["text"])


def test_token_stage_holds_the_library_s_ids(stages):
    before, after = stages["token-ID binary output"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = [(r["doc_id"], np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")) for r in before.collect()]
    got = after.orderBy("start").collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, len(c), zlib.crc32(c.tobytes())) for i, c in coded)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir[0])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, stages["token-ID binary output"][1].select(*got.columns).collect()), key=repr)
