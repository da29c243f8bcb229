"""Nearest neighbours: what a run leaves on disk, and its rows beside the visited buckets ranked one query at a time."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlsift.llm import ann


def folder_bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def table_of(spark, x, kind="float"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")


def test_disk_is_a_few_times_the_input(spark, tmp_path, monkeypatch):
    """Vectors are not copied for each bucket, nor rows kept for each pair of blocks: the budget is 4 x input."""
    table_of(spark, np.random.default_rng(1).standard_normal((6000, 64))).repartition(4).write.parquet(f"{tmp_path}/in")
    tables, write = [], ann.written

    def written(df):
        out = write(df)
        tables.extend(os.path.dirname(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(ann, "written", written)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    blocks = [blocks[i] for i in range(len(blocks))]
    before = sum(map(folder_bytes, blocks))
    assert ann.nearest(spark.read.parquet(f"{tmp_path}/in"), F.col("vec_id") % 20 == 0).count() == 300 * 20
    assert sum(map(folder_bytes, blocks)) - before + sum(map(folder_bytes, set(tables))) < 4 * folder_bytes(f"{tmp_path}/in")


def ranked_one_by_one(df, is_query, k):
    """What the visited buckets hold, ranked; all vectors where they hold too few."""
    rows = ann.usable(df)
    index = ann.fit_index(rows, k, 4, 4, 0.9, 0.96, 4000, 64, 7)
    found = sorted(rows.collect(), key=lambda r: r["vec_id"])
    ids, x = np.array([r["vec_id"] for r in found]), np.array([r["vec"] for r in found], dtype=float)
    cell, out = np.floor(index.places(x)).astype(np.int64), {}
    for i in np.flatnonzero([is_query(j) for j in ids]):
        visits = index.visits(x[i : i + 1])[0]
        met = np.array([any((visits[t] == c[t]).all(-1).any() for t in range(4)) for c in cell]) & (ids != ids[i])
        if met.sum() < min(k, len(ids) - 1):
            met = ids != ids[i]
        score = (x[met] * x[i]).sum(1)
        out[int(ids[i])] = [(int(ids[met][j]), score[j]) for j in np.lexsort([ids[met], -score])[:k]]
    return out


@pytest.mark.parametrize("case", ["scattered", "clustered", "equal", "lengths"])
def test_rows_are_those_of_the_visited_buckets(spark, monkeypatch, case):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 12))
    if case == "clustered":
        centres = rng.standard_normal((45, 12))
        x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 20, axis=0) + 0.001 * x
    if case == "equal":  # more copies of one vector than k, and of all vectors two
        x[450:] = x[:450]
        x[100:400] = x[100]
    if case == "lengths":
        x *= np.exp(6 * rng.standard_normal((900, 1)))
    monkeypatch.setattr(ann, "STORED_BYTES", 12 * 8 * 200)  # several blocks of vectors
    df = table_of(spark, x, "double" if case == "lengths" else "float").repartition(3)
    want = ranked_one_by_one(df, lambda i: i % 10 == 0, 7)
    got = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 10 == 0, k=7, block=16).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want


def test_looking_up_and_multiplying_agree(monkeypatch):
    """Whether vectors are looked up bucket by bucket or picked from a product of all, for tables of any size and order."""
    rng = np.random.default_rng(6)
    index = ann.Index(rng.standard_normal((3, 3, 11)), rng.random((3, 3)), 3.0, 8.0, 20)
    x, ids = rng.standard_normal((2003, 10)).astype(np.float32), rng.permutation(2003)
    x = x[np.argsort(x @ x[0])]  # each vector nearer to the first query than all before
    x[1500:1600] = x[1999]
    buckets, found = ann._hashed(np.floor(index.places(x.astype(float))).astype(np.int64)), []
    for selective in (0, 99):
        monkeypatch.setattr(ann, "SELECTIVE", selective)
        search = ann._Nearest(index, 9, 32, ids[-150:], x[-150:], False)
        for i in range(0, 2003, 700):
            search.add(ids[i : i + 700], x[i : i + 700], buckets[i : i + 700])
        found.append(search.hits().to_pydict())
    assert found[0] == found[1] and 600 < len(found[0]["score"]) < 150 * 9  # some find fewer


def test_queries_that_find_too_few_meet_every_vector(spark):
    x = np.random.default_rng(4).standard_normal((300, 8))
    x[0], x[20] = -50 * np.ones(8), 1e-3 * x[20]
    df = table_of(spark, x)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=250).collect()
    assert all(sum(r["query_id"] == q for r in got) == 250 for q in range(0, 300, 20))
    want = ranked_one_by_one(df, lambda i: i % 20 == 0, 250)
    assert {q: [v for v, _ in w] for q, w in want.items()} == {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(0, 300, 20)}
