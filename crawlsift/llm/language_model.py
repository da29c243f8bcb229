"""Language-model scores: a log-bilinear model of the next symbol, trained by noise-contrastive estimation in numpy.

Symbols are the most frequent words, the end of a text, and buckets of all other words by their last two bytes. A context of two
symbols predicts r = c1*e[s1] + c2*e[s2] (products by element), and the score of the next symbol s is r.q[s] + b[s]. Every partition
of the training texts trains a copy from the same start over all its tokens against noise from the corpus counts; the copies are
averaged by their tokens. Batched matrix products then give the normalised log-probabilities of all symbols after all pairs of
symbols, once for the model and not per token. A word in a bucket has its smoothed share of the bucket besides, with one unseen
word per bucket: the model is a distribution over all words.

Cases: a null or empty text is one end token; with no training rows all words are unseen in one bucket share each and scores stay
finite; rows that repeat an id stay rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frequencies import corpus_counts, head_threshold, summed_rests
from .shared import small_batches, utf8, written

BUCKETS = 256
LN10 = float(np.log(10))
#: Words whose codes a worker keeps.
MEMO = 400_000


def words_of(text: bytes) -> list[bytes]:
    """A-Z in lower case; cut at space and 09-0D: what bytes.lower and bytes.split do."""
    return text.lower().split()


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


@dataclass
class Vocabulary:
    """Frequent words with counts (by rank), which of them are symbols of their own, and the sizes of the buckets of the others."""

    rank: dict[bytes, int]
    counts: np.ndarray
    symbols: int
    bucket_total: np.ndarray
    train_tokens: int
    types: int
    texts: int

    @property
    def size(self) -> int:
        return self.symbols + BUCKETS + 1

    @property
    def end(self) -> int:
        return self.size - 1

    def noise(self) -> np.ndarray:
        """Share of each symbol in the training tokens, smoothed."""
        n = np.concatenate([self.counts[: self.symbols], self.bucket_total, [self.texts]]) + 1.0
        return n / n.sum()


class Reader(dict):
    """Codes of words in a worker: the rank of a frequent word, else the bucket as a negative number."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.rank)
        self.v = vocabulary
        later = [bucket_of(w) for w, r in sorted(vocabulary.rank.items(), key=lambda x: x[1]) if r >= vocabulary.symbols]
        self.symbol_of_rank = np.concatenate([np.arange(vocabulary.symbols), vocabulary.symbols + np.array(later, dtype=np.int64), [vocabulary.end]]).astype(np.int32)

    def __missing__(self, word: bytes) -> int:
        code = -1 - bucket_of(word)
        if len(self) < MEMO:
            self[word] = code
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of a text's words, and the end."""
        own = self.symbol_of_rank[np.append(np.maximum(codes, 0), len(self.symbol_of_rank) - 1)]
        own[:-1][codes < 0] = self.v.symbols - 1 - codes[codes < 0]
        return own


def build_vocabulary(counts: DataFrame, texts: int, symbols: int, head: int) -> Vocabulary:
    """counts: term, n. Only at most `head` frequent words and the buckets' sums come to the driver."""
    least = head_threshold(counts, head)
    top = sorted(((r["n"], r["term"].encode()) for r in counts.where(F.col("n") >= least).toLocalIterator()), key=lambda x: (-x[0], x[1]))
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    rank = {w: i for i, (_, w) in enumerate(top)}
    n = np.array([c for c, _ in top], dtype=np.int64)
    own = min(symbols, len(top))
    raw = F.col("term").cast("binary")
    bucket = F.crc32(F.expr("substring(term_raw, greatest(length(term_raw) - 1, 1), 2)")) % BUCKETS
    sums = counts.withColumn("term_raw", raw).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    bucket_n, bucket_v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums:
        bucket_n[r["bucket"]], bucket_v[r["bucket"]] = r["n"], r["v"]
    for c, w in top[:own]:
        bucket_n[bucket_of(w)] -= c
        bucket_v[bucket_of(w)] -= 1
    return Vocabulary(rank, n, own, bucket_n + bucket_v, int(total["n"] or 0) + texts, int(total["v"]) + (texts > 0), texts)


@dataclass
class LogBilinear:
    e: np.ndarray
    q: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, noise: np.ndarray, width: int, seed: int) -> LogBilinear:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(draw(len(noise), width), draw(len(noise), width) * 0.1, np.ones((2, width), np.float32) * 0.7, np.log(noise).astype(np.float32))

    def train(self, contexts: np.ndarray, nexts: np.ndarray, noise: np.ndarray, sums: LogBilinear, rng: np.random.Generator, samples: int, rate: float) -> None:
        """One step of noise-contrastive estimation on a batch, with noise that the batch shares; sums: of squared slopes, for step sizes."""
        n, width = len(nexts), self.e.shape[1]
        drawn = rng.choice(len(noise), samples, p=noise)
        offset = np.log(samples * noise).astype(np.float32)
        e1, e2 = self.e[contexts[:, 0]], self.e[contexts[:, 1]]
        r = self.c[0] * e1 + self.c[1] * e2
        qt, qn = self.q[nexts], self.q[drawn]
        true = 1 / (1 + np.exp((r * qt).sum(1) + self.b[nexts] - offset[nexts]))  # 1 - P(from the data)
        fake = 1 / (1 + np.exp(-(r @ qn.T + self.b[drawn] - offset[drawn])))  # P(from the data)
        gr = true[:, None] * qt - fake @ qn
        rows = lambda index, values: np.bincount((index[:, None] * width + np.arange(width)).ravel(), values.ravel(), len(noise) * width).reshape(-1, width).astype(np.float32)
        gq = rows(nexts, true[:, None] * r)
        np.subtract.at(gq, drawn, fake.T @ r)
        ge = rows(contexts[:, 0], gr * self.c[0]) + rows(contexts[:, 1], gr * self.c[1])
        gb = np.bincount(nexts, true, len(noise)).astype(np.float32)
        np.subtract.at(gb, drawn, fake.sum(0))
        gc = np.stack([(gr * e1).sum(0), (gr * e2).sum(0)])
        for value, total, g in ((self.e, sums.e, ge), (self.q, sums.q, gq), (self.c, sums.c, gc), (self.b, sums.b, gb)):
            g /= np.float32(n)
            total += g * g
            value += rate * g / (np.sqrt(total) + np.float32(1e-6))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All normalised log10 probabilities in two tables: a pair (s1, s2) and next s give first[s1, s] + second[s2, s] - norm[s1, s2]."""
        first, second = (self.e * self.c[0]) @ self.q.T + self.b, (self.e * self.c[1]) @ self.q.T
        both = np.empty((len(self.b), len(self.b)), np.float32)
        top1, top2 = first.max(1), second.max(1)
        x1, x2 = np.exp(first - top1[:, None]), np.exp(second - top2[:, None])
        for i in range(0, len(both), 256):
            both[i : i + 256] = np.log(np.maximum(x1[i : i + 256] @ x2.T, 1e-37)) + top1[i : i + 256, None] + top2
        return np.stack([first, second]) / np.float32(LN10), both / np.float32(LN10)


def _contexts(symbols: np.ndarray, end: int) -> np.ndarray:
    """The two symbols before each; before a text stand ends."""
    return np.stack([np.concatenate([[end], symbols[:-1]]), np.concatenate([[end, end], symbols[:-2]])[: len(symbols)]], axis=1)


def train_model(texts: DataFrame, vocabulary: Vocabulary, width: int = 16, samples: int = 24, batch: int = 1024, rate: float = 0.15, seed: int = 5) -> LogBilinear:
    """Every training token of the one binary column is learned from, in the partition that holds it."""
    spark = texts.sparkSession
    noise = vocabulary.noise()
    shared = spark.sparkContext.broadcast(vocabulary)
    size = vocabulary.size

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rng = Reader(shared.value), np.random.default_rng(seed)
        model = LogBilinear.start(noise, width, seed)
        sums = LogBilinear(*(np.full_like(x, 1e-4) for x in (model.e, model.q, model.c, model.b)))
        seen, waiting, held = 0, [], 0

        def learn() -> None:
            contexts, nexts = (np.concatenate(x) for x in zip(*waiting))
            for i in range(0, len(nexts), batch):
                model.train(contexts[i : i + batch], nexts[i : i + batch], noise, sums, rng, samples, rate)

        for part in small_batches(batches):
            for text in part[0].to_pylist():
                symbols = reader.symbols(reader.codes(words_of(text)))
                waiting.append((_contexts(symbols, reader.v.end), symbols))
                held += len(symbols)
                seen += len(symbols)
                if held >= 32 * batch:
                    learn()
                    waiting, held = [], 0
        if waiting:
            learn()
        if seen:
            weighted = np.concatenate([model.e, model.q, model.b[:, None]], axis=1)
            rows = [*weighted, np.concatenate([model.c.ravel(), [0]])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array([seen] * len(rows), pa.int64()), pa.array([x.astype(float).tolist() for x in rows])], names=["row", "tokens", "w"])

    copies = texts.mapInArrow(train, "row int, tokens long, w array<double>")
    length = 2 * width + 1
    mean = copies.groupBy("row").agg(F.array(*[F.sum(F.col("w")[j] * F.col("tokens")) / F.sum("tokens") for j in range(length)]).alias("w"))
    got = {r["row"]: r["w"] for r in mean.collect()}  # a row per symbol
    if not got:
        return LogBilinear.start(noise, width, seed)
    w = np.array([got[i] for i in range(size)], dtype=np.float32)
    return LogBilinear(w[:, :width], w[:, width : 2 * width], np.array(got[size][: 2 * width], np.float32).reshape(2, width), w[:, -1])


def score_texts(docs: DataFrame, is_training: Column, symbols: int = 768, head: int = 1 << 17) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of docs, having learned from the rows of is_training."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"), is_training.alias("training"))
    training = rows.where("training").select("text")
    counts = written(corpus_counts(training, lambda seen: seen, words_of))
    vocabulary = build_vocabulary(counts, training.count(), symbols, head)
    first, norm = train_model(training, vocabulary).tables()
    tables = docs.sparkSession.sparkContext.broadcast((vocabulary, first, norm))

    def scan(pairs: Iterator[tuple]) -> Iterator[tuple[list, Counter]]:
        v, lead, both = tables.value
        reader = Reader(v)
        logs = np.append(np.log10(v.counts + 1.0), 0.0)
        apart_logs = np.where(np.arange(len(logs)) >= v.symbols, logs, 0.0)
        shares = np.concatenate([np.zeros(v.symbols), np.log10(v.bucket_total + 1.0), [0.0]])
        end_log = float(np.log10(v.texts + 1.0))
        for doc_id, text in pairs:
            words = words_of(text)
            codes = reader.codes(words)
            s = reader.symbols(codes)
            c = _contexts(s, v.end)
            model = float((lead[0][c[:, 0], s] + lead[1][c[:, 1], s]).sum(dtype=float) - both[c[:, 0], c[:, 1]].sum(dtype=float) - shares[s].sum())
            frequent = codes[codes >= 0]
            rest = Counter(map(words.__getitem__, np.flatnonzero(codes < 0).tolist()))
            yield [doc_id, len(s), len(frequent) + int(v.texts > 0), end_log + float(logs[frequent].sum()), model + float(apart_logs[frequent].sum())], rest

    fields = {"doc_id": "long", "n_tokens": "long", "known": "long", "base": "double", "model": "double"}
    rare = counts.where(F.col("n") < (int(vocabulary.counts.min()) if len(vocabulary.counts) else 1 << 62)).select("term", F.col("n").alias("c"))
    found = summed_rests(rows.select("doc_id", "text"), scan, fields, rare, {"rest_known": "CASE WHEN c > 0 THEN n ELSE 0 END", "rest_log": "n * log10(coalesce(c, 0) + 1)"})
    total = float(np.log10(vocabulary.train_tokens + vocabulary.types + 1.0))
    return found.select(
        "doc_id", "n_tokens", (F.col("known") + F.col("rest_known")).cast("long").alias("n_known"), F.lit(vocabulary.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest_log") - F.col("n_tokens") * total).alias("base_score"), (F.col("model") + F.col("rest_log")).alias("score"))
