"""Importance resampling towards a target: documents whose word runs look like the target's texts are drawn more often.

Words and runs of words are made by Arrow kernels over whole batches: ascii_lower, split_pattern_regex, list_flatten and
dictionary_encode. Shifted dictionary indices form the runs, each distinct one of a batch is hashed once, and gains are taken by bucket
and summed over each document's segment. Two passes over the documents: bucket counts (at most `buckets` rows a task, summed by Spark),
then scores. Scores are whole numbers within a range that does not grow with the data, so the counts by score (at most some 120,000
rows) give each drawn document its place; only documents that may be drawn are shuffled, by score.

Cases: a null or empty text, or one without words, has no features and weight 0; documents below `least_words` are scored but not drawn;
rows that repeat an id are documents of their own, tied in any order; null ids hash as an empty id and lose ties; an empty table gives
no rows; an empty target leaves its counts at 0; other columns of the tables are not read. A very long text is worked through in pieces
of about `PIECE` bytes, cut where a word ends.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cuts, written

#: What lies between words once A-Z are lower-case, as an Arrow pattern; the same in the text as it is, for cuts.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CUT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of text that a task works on at a time.
PIECE = 4 << 20


def word_runs(texts: pa.Array, longest: int, buckets: int, known: int = 0) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Words of each text; for each run length the text and bucket of every run; the last longest - 1 words of the last text.

    Runs that end within the first `known` words of a text are left out, and these words are not counted.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    words, text_of = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    text_of = text_of.filter(real).to_numpy(zero_copy_only=False)
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    n_words = np.bincount(text_of, minlength=len(texts))
    place = np.arange(len(at)) - (np.cumsum(n_words) - n_words)[text_of]
    runs, ids, crc = [], at, np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
    for k in range(1, longest + 1):
        if k > 1:
            # A run is the run before it and one more word: each distinct pair is hashed once, from where the shorter run's hash ended.
            same = text_of[: len(text_of) - k + 1] == text_of[k - 1 :]
            pairs, new = np.unique(np.where(same, ids[: len(same)] * len(distinct) + at[k - 1 :], -1), return_inverse=True)
            crc = np.fromiter((zlib.crc32(b" " + distinct[p % len(distinct)], int(crc[p // len(distinct)])) if p >= 0 else 0 for p in pairs.tolist()), np.int64, len(pairs))
            ids = new.reshape(-1)
        else:
            same = np.ones(len(at), bool)
        keep = same & (place[: len(same)] + k - 1 >= known)
        runs.append((text_of[: len(same)][keep], (crc % buckets).take(ids[keep]) if len(crc) else np.empty(0, np.int64)))
    last = [distinct[i].decode() for i in at[len(at) - longest + 1 :]] if longest > 1 else []
    return np.maximum(n_words - known, 0), runs, last


def _pieces(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """First row, words and runs of the texts, some MB at a time; a longer text comes in several pieces."""
    texts = texts.cast(pa.large_string()).fill_null("")
    sizes, start = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0
    while start < len(texts):
        if sizes[start] <= PIECE:
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), PIECE, "right")))
            yield start, *word_runs(texts.slice(start, stop - start), longest, buckets)[:2]
            start = stop
            continue
        body, last = memoryview(texts[start].as_buffer()), []
        for a, b in cuts(body, PIECE, _CUT):
            piece = " ".join([*last, str(body[a:b], "utf-8")])
            words, runs, last = word_runs(pa.array([piece], pa.large_string()), longest, buckets, len(last))
            yield start, words, runs
        start += 1


def run_counts(texts: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: runs of words over all texts (the one string column)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, runs in _pieces(batch[0], longest, buckets):
                for _, bucket in runs:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the source's) by bucket."""
    buckets, s, t = len(source), source.astype(float), target.astype(float)
    ratios = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket in the driver: at most `buckets` numbers."""
    rows, out = counts.toArrow(), np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def importance_scores(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for each row of docs; target needs a column text only."""
    gains = bucket_gains(
        _dense(run_counts(docs.select(F.col("text").cast("string")), longest, buckets), buckets),
        _dense(run_counts(target.select(F.col("text").cast("string")), longest, buckets), buckets))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for start, words, runs in _pieces(batch["text"], longest, buckets):
                rows = slice(start, start + len(words))
                n_words[rows] += words
                for text_of, bucket in runs:
                    here = np.bincount(text_of, minlength=len(words))
                    sums, ends = np.concatenate([[0], np.cumsum(gains.take(bucket))]), np.cumsum(here)
                    n[rows] += here
                    total[rows] += sums[ends] - sums[ends - here]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(salted, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.ln(-F.ln(u))).cast("long"))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row; rank counts the drawn ones from 1 and is null for the others."""
    scored = written(importance_scores(docs, target, longest, buckets, seed))
    able = F.col("n_words") >= least_words
    levels = scored.where(able).groupBy("score").count().toArrow().sort_by([("score", "descending")])  # some 120,000 rows at most
    score, n = levels["score"].to_numpy(), levels["count"].to_numpy()
    before = np.cumsum(n) - n
    drawn = int(n.sum()) * percent // 100
    reached = before < drawn
    places = scored.sparkSession.createDataFrame(pa.table({"score": score[reached], "before": before[reached]}), "score long, before long")
    if not reached.any():
        return scored.withColumn("rank", F.lit(None).cast("long"))
    chosen = able & (F.col("score") >= int(score[reached][-1]))
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    ranked = scored.where(chosen).withColumn("nth", nth.cast("long")).join(F.broadcast(places), "score")
    place = F.col("before") + F.col("nth")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(place <= drawn, place).alias("rank"))
    return ranked.unionByName(scored.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))
