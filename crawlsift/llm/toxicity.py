"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word, its prefixes and its ending. Filters of widths 1, 2 and 3 run over the
embedded words of the whole text, their maxima feed a logistic. Since a filter's response is a sum over its places, every distinct word
is turned once into its part of all responses, and a text costs additions of such parts and a maximum.

The model is fitted on all labelled rows but a fifth: partitions learn theirs apart, and the copies are averaged.

Besides the score there is a decision: each language has the threshold that separates the held-back fifth of the labelled rows best.
The threshold needs the language; the score never sees it.

Cases: a null or empty text has the score of a text without any words; rows without a label or id are not learned from; with no
labelled rows, or labels of one kind, every score is the smoothed share of that label; a language not seen in training has the
threshold of all languages together.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import ROWS, bounded_sample, small_batches, text_batches, utf8, written

PIECES = 1 << 15
PARTS = 6
WIDTHS = (1, 2, 3)
#: Distinct words whose responses a worker keeps; beyond it, it starts anew.
MEMO = 100_000
#: Words of texts that are scored together.
RUN_WORDS = 20_000
#: Rows of a step of learning; rows that are worth a copy of the model, and how many copies there are at most; rows learned in all passes.
BATCH, PART_ROWS, MAX_PARTS, PASS_ROWS = 32, 4096, 256, 60_000
#: Parts in which the embeddings of the copies are added up; bins of scores for thresholds.
BLOCKS, BINS = 32, 1 << 14
_STRIP = b".,;:!?\"'()[]{}*#$%&|"


def pieces_of(word: bytes) -> list[int]:
    """Hash places of a word, its prefixes of 3, 4, 5 and 6 bytes and its last 4; a place of its own for each kind."""
    core = word.strip(_STRIP)
    parts = (core, core[:3], core[:4], core[:5], core[:6], core[-4:])
    return [zlib.crc32(p, k) % PIECES for k, p in enumerate(parts)]


@dataclass
class ConvolutionalModel:
    embeddings: np.ndarray  # PIECES x d
    filters: np.ndarray  # d x (places of all widths * filters)
    bias: np.ndarray  # widths * filters
    out: np.ndarray  # widths * filters + 1
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    @property
    def each(self) -> int:
        return len(self.bias) // len(WIDTHS)

    def responses(self, words: np.ndarray) -> np.ndarray:
        """words: rows of pieces. Each word's part of all filters' responses, by place."""
        return self.embeddings[words].sum(1) @ self.filters

    def pooled(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over a text, and where; parts: responses of its words in order, with two empty words behind."""
        n, f = len(parts) - 2, self.each
        tops, ats, column = [], [], 0
        for width in WIDTHS:
            r = parts[:n, column : column + f]
            for j in range(1, width):
                r = r + parts[j : n + j, column + j * f : column + (j + 1) * f]
            column += width * f
            at = r.argmax(0)
            ats.append(at)
            tops.append(r[at, np.arange(f)])
        return np.concatenate(tops), np.concatenate(ats)

    def logit(self, parts: np.ndarray) -> float:
        if len(parts) <= 2:
            return float(self.out[-1])
        h = np.maximum(self.pooled(parts)[0] + self.bias, 0)
        return float(h @ self.out[:-1] + self.out[-1])


class Scorer:
    """Scores texts, a run of them at a time; row 0 of the table is the empty word."""

    def __init__(self, model: ConvolutionalModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.places, self.table = {}, np.zeros((1, self.model.filters.shape[1]), np.float32)

    def __call__(self, texts: Sequence[bytes]) -> list[float]:
        split = [t.lower().split() for t in texts]
        new = list(filterfalse(self.places.__contains__, set().union(*split)))
        if len(self.places) + len(new) > MEMO:
            self._forget()
            new = list(set().union(*split))
        if new:
            self.places.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            made = [self.model.responses(np.array([pieces_of(w) for w in new[i : i + 4096]])) for i in range(0, len(new), 4096)]
            self.table = np.concatenate([self.table, *made]).astype(np.float32)
        out, run, words = [], [], 0
        for text in split:
            if run and words + len(text) > RUN_WORDS:
                out.append(self._scores(run))
                run, words = [], 0
            run.append(text)
            words += len(text)
        return np.concatenate([*out, self._scores(run)]).tolist() if run else []

    def _scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """The texts behind each other, two empty words behind each: one sum and one maximum for all."""
        m, at, places = self.model, self.places.__getitem__, []
        for words in texts:
            places.extend(map(at, words))
            places += (0, 0)
        ends = np.cumsum([len(words) + 2 for words in texts])
        parts = self.table[places]
        tops, column = [], 0
        for width in WIDTHS:
            r = parts[:, column : column + m.each].copy()
            for j in range(1, width):
                r[:-j] += parts[j:, column + j * m.each : column + (j + 1) * m.each]
            column += width * m.each
            r[ends - 1] = r[ends - 2] = -np.inf
            tops.append(np.maximum.reduceat(r, np.concatenate([[0], ends[:-1]]), axis=0))
        z = [float(h @ m.out[:-1] + m.out[-1]) for h in np.maximum(np.concatenate(tops, axis=1) + m.bias, 0)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Learner:
    """Adagrad on the log loss, a batch of texts at a time, for a model that it changes in place."""

    def __init__(self, model: ConvolutionalModel, squares: list[np.ndarray] | None = None, rate: float = 0.08):
        self.model, self.rate = model, rate
        self.squares = squares or [np.full_like(x, 1e-4) for x in (model.embeddings, model.filters, model.bias, model.out)]

    def learn(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        """texts: for each the rows of pieces of its words; weight: how many rows each counts for."""
        m, squares, rate, each = self.model, self.squares, self.rate, self.model.each
        width, columns = m.filters.shape
        spans = np.cumsum([0, *WIDTHS]) * each
        flat = np.concatenate(texts) if texts else np.zeros((0, PARTS), np.int64)
        distinct, back = np.unique(flat, axis=0, return_inverse=True) if len(flat) < 1 else _distinct(flat)
        embedded = m.embeddings[distinct].sum(1)
        parts = np.concatenate([embedded @ m.filters, np.zeros((1, columns), np.float32)])
        gp, where, what = [], [], []
        g_bias, g_out = np.zeros_like(m.bias), np.zeros_like(m.out)
        at = 0
        for w, label, counts in zip(texts, y, weight):
            index = back[at : at + len(w)]
            at += len(w)
            if not len(w):
                g_out[-1] += (1 / (1 + np.exp(-m.out[-1])) - label) * counts
                continue
            index = np.concatenate([index, [len(distinct), len(distinct)]])
            top, spot = m.pooled(parts[index])
            h = np.maximum(top + m.bias, 0)
            error = (1 / (1 + np.exp(-(h @ m.out[:-1] + m.out[-1]))) - label) * counts
            g_out += np.concatenate([error * h, [error]])
            gh = error * m.out[:-1] * (h > 0)
            g_bias += gh
            for k, size in enumerate(WIDTHS):
                mine = slice(k * each, (k + 1) * each)
                for j in range(size):
                    where.append(index[spot[mine] + j])
                    what.append(spans[k] + j * each + np.arange(each))
                    gp.append(gh[mine])
        if gp:
            where, what, gp = np.concatenate(where), np.concatenate(what), np.concatenate(gp)
            real = (where < len(distinct)) & (gp != 0)
            where, what, gp = where[real], what[real], gp[real]
            g_parts = np.zeros((len(distinct), columns), np.float32)
            np.add.at(g_parts, (where, what), gp)
            rows = np.unique(where)
            g_filters = embedded[rows].T @ g_parts[rows]
            g_words = g_parts[rows] @ m.filters.T
            touched, inverse = np.unique(distinct[rows], return_inverse=True)
            g_embedded = np.zeros((len(touched), width), np.float32)
            np.add.at(g_embedded, inverse.reshape(-1), np.repeat(g_words, PARTS, axis=0))
            squares[0][touched] += g_embedded**2
            m.embeddings[touched] -= rate * g_embedded / np.sqrt(squares[0][touched])
            squares[1] += g_filters**2
            m.filters -= rate * g_filters / np.sqrt(squares[1])
        for value, total, g in ((m.bias, squares[2], g_bias), (m.out, squares[3], g_out)):
            total += g**2
            value -= rate * g / np.sqrt(total)


def begun(share: float, rng: np.random.Generator, width: int = 12, each: int = 6) -> ConvolutionalModel:
    """A model before it learned anything; share: of label 1."""
    columns = sum(WIDTHS) * each
    m = ConvolutionalModel(
        (rng.standard_normal((PIECES, width)) * 0.1).astype(np.float32), (rng.standard_normal((width, columns)) * 0.3).astype(np.float32), np.zeros(len(WIDTHS) * each, np.float32),
        np.concatenate([np.abs(rng.standard_normal(len(WIDTHS) * each)) * 0.3, [0.0]]).astype(np.float32))
    m.out[-1] = np.log(share / (1 - share))
    return m


def fit_convolutional(texts: list[list[np.ndarray]], y: np.ndarray, langs: list[str], epochs: int = 12, seed: int = 3) -> ConvolutionalModel:
    """The model of few rows, all of them in memory. texts: for each document the rows of pieces of its words. The thresholds are set on
    a fifth of them, which the model does not learn."""
    rng = np.random.default_rng(seed)
    m = begun((y.sum() + 0.5) / (len(y) + 1), rng)
    if not len(y) or y.min() == y.max():
        m.out[:-1] = 0
        return m
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    learn_epochs(Learner(m), texts, y, np.flatnonzero(~held), rng, epochs)
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    scores = np.array([_score(m, texts[i]) for i in check])
    w = np.ones(len(check))
    m.threshold = _best_threshold(scores, y[check], w)
    for lang in sorted({langs[i] for i in check}):
        mine = np.array([langs[i] == lang for i in check])
        if 0 < y[check][mine].sum() < mine.sum():
            m.thresholds[lang] = _best_threshold(scores[mine], y[check][mine], w[mine])
    return m


def learn_epochs(learner: Learner, texts: list[np.ndarray], y: np.ndarray, learn: np.ndarray, rng: np.random.Generator, epochs: int = 12) -> None:
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
            learner.learn([texts[i] for i in some], y[some], np.ones(len(some)))


def _distinct(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = (flat * (np.uint64(1) << np.arange(0, 10 * PARTS, 10, dtype=np.uint64) | np.uint64(1))).sum(1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ flat[:, 0].astype(np.uint64)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    return flat[first], back.reshape(-1)


def _score(m: ConvolutionalModel, words: np.ndarray) -> float:
    z = m.logit(np.concatenate([m.responses(words), np.zeros((2, m.filters.shape[1]), np.float32)]))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _best_threshold(scores: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The threshold with the best F1 of rows that weigh w, in the middle of the gap below it."""
    if not len(y) or y.sum() == 0:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum((y * w)[order])
    f1 = 2 * hit / (np.cumsum(w[order]) + (y * w).sum())
    k = int(np.argmax(f1))
    below = scores[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((scores[order[k]] + below) / 2)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 5000) -> ConvolutionalModel:
    """Fits on whole texts of all labelled rows given.

    At most `sample_rows`, half for each label, are fitted in one place (`fit_convolutional`): that is the model where there are no more
    rows, and else only where learning begins. From there every partition learns all its rows, the copies are averaged, and where rows are
    few this is repeated. All counts are of all rows; a label weighs in learning as it does in the first rows, and its share among all is
    put into the output's bias at the end. Thresholds come from the scores of all rows of a fifth of the ids, which are not learned.
    """
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col(label) > 0).cast("double").alias("y"))
    n = [known.where(F.col("y") == v).count() for v in (0.0, 1.0)]
    if max(n) <= sample_rows // 2:
        return fit_convolutional(*_in_memory(docs, known))
    checked = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4
    learned = known.where(~checked)
    first = [bounded_sample(learned.where(F.col("y") == v), F.col("doc_id"), sample_rows // 2) for v in (0.0, 1.0)]
    texts, y, _ = _in_memory(docs, first[0].union(first[1]))
    taken = [int((y == v).sum()) for v in (0.0, 1.0)]
    rng = np.random.default_rng(3)
    model = begun((y.sum() + 0.5) / (len(y) + 1), rng)
    if not min(taken):
        model.out[:-1] = 0
        share = (n[1] + 0.5) / (sum(n) + 1)
        model.out[-1] = np.log(share / (1 - share))
        return model
    learner = Learner(model)
    learn_epochs(learner, texts, y, np.arange(len(y)), rng)
    # how much a row of each label counts, so that both weigh as in the first rows and a row counts for one on average
    weight = [t / len(y) * sum(n) / c for t, c in zip(taken, n)]
    rows = docs.select("doc_id", F.col("text")).where(~checked).join(learned.hint("merge"), "doc_id").select(utf8(F.col("text")).alias("text"), "y")
    parts = min(MAX_PARTS, -(-sum(n) // PART_ROWS))
    for _ in range(-(-PASS_ROWS // sum(n))):
        learner = _learned_apart(rows.coalesce(parts), learner, weight)
    model = learner.model
    model.out[-1] += np.float32(np.log(weight[0] / weight[1]))
    scored = docs.where(checked).select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), toxicity_score(model, F.col("text")).alias("score"))
    model.threshold, model.thresholds = _thresholds(scored.join(known.hint("merge"), "doc_id"))
    return model


def _in_memory(docs: DataFrame, some: DataFrame) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
    """Pieces, labels and languages of few rows, in an order that is the same in every run."""

    @arrow_udf("binary")
    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([np.array([pieces_of(w) for w in t.lower().split()], dtype="<u2").tobytes() for t in texts.to_pylist()], pa.binary())

    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(some), "doc_id").select("doc_id", pieces(utf8(F.col("text"))).alias("p"), "y", F.coalesce(F.col("lang"), F.lit("")).alias("lang"))
    got = sorted(rows.toLocalIterator(), key=lambda r: (r["doc_id"], bytes(r["p"]), r["y"]))
    order = np.random.default_rng(11).permutation(len(got))
    texts = [np.frombuffer(bytes(got[i]["p"]), "<u2").reshape(-1, PARTS).astype(np.uint64) for i in order]
    return texts, np.array([got[i]["y"] for i in order]), [got[i]["lang"] for i in order]


def _state(learner: Learner) -> list[np.ndarray]:
    m = learner.model
    return [m.embeddings, m.filters, m.bias, m.out, *learner.squares]


def _learned_apart(rows: DataFrame, begin: Learner, weight: list[float]) -> Learner:
    """Every partition learns all its rows (text, y) from the same beginning; then the average of what they became, by rows learned. A
    piece's embedding is averaged over the partitions that changed it. States travel in blocks, each added up in a task of its own."""

    def learn(batches):
        state = [x.copy() for x in _state(begin)]
        learner, places, table, n = Learner(ConvolutionalModel(*state[:4]), state[4:]), {}, [], 0
        for batch in small_batches(batches, BATCH):
            words = [t.lower().split() for t in batch.column("text").to_pylist()]
            if len(places) > MEMO:
                places, table = {}, []
            for w in set().union(*words) - places.keys():
                places[w] = len(table)
                table.append(pieces_of(w))
            texts = [np.array([table[places[w]] for w in t], np.uint64).reshape(-1, PARTS) for t in words]
            y = np.array(batch.column("y").to_pylist())
            learner.learn(texts, y, np.where(y > 0, weight[1], weight[0]))
            n += len(y)
        if not n:
            return
        old, now = _state(begin), _state(learner)
        changed = (now[4] != old[4]).any(1)
        for block, (at, some) in enumerate(zip(np.array_split(np.arange(PIECES), BLOCKS), np.array_split(changed, BLOCKS))):
            sums = np.concatenate([some * np.float32(n), *((x[at] * (some * np.float32(n))[:, None]).ravel() for x in (now[0], now[4]))]).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})
        rest = np.concatenate([[n], *(x.ravel() * n for x in (*now[1:4], *now[5:]))]).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"block": pa.array([BLOCKS], pa.int32()), "sums": pa.array([rest.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in group.column("sums"))
        return pa.table({"block": group.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    made = {r["block"]: np.frombuffer(bytes(r["sums"])) for r in rows.mapInArrow(learn, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").collect()}
    state = [x.copy() for x in _state(begin)]
    if not made:
        return begin
    width = state[0].shape[1]
    for block, at in enumerate(np.array_split(np.arange(PIECES), BLOCKS)):
        count, values = made[block][: len(at)], made[block][len(at) :].reshape(2, len(at), width)
        some = count > 0
        for x, v in zip((state[0], state[4]), values):
            x[at[some]] = v[some] / count[some, None]
    rest, at = made[BLOCKS][1:] / made[BLOCKS][0], 0
    for x in (*state[1:4], *state[5:]):
        x[...] = rest[at : at + x.size].reshape(x.shape)
        at += x.size
    return Learner(ConvolutionalModel(*state[:4]), state[4:])


def _thresholds(scored: DataFrame) -> tuple[float, dict[str, float]]:
    """The thresholds with the best F1 over all rows (lang, score, y) and over those of each language that has both labels: in the middle
    between two scores. Rows are counted by bins of the score, so a language costs at most BINS counts."""
    bins = scored.groupBy("lang", F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"), F.min("score").alias("low"), F.max("score").alias("high"))
    bins = written(bins)
    every = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high"))

    def best(counts: DataFrame, key: str) -> DataFrame:
        above = Window.partitionBy(key).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
        below = Window.partitionBy(key).orderBy(F.col("bin").desc())
        whole = Window.partitionBy(key)
        ranked = counts.select(
            key, "bin", F.sum("hits").over(whole).alias("all_hits"), F.sum("n").over(whole).alias("all_n"),
            (2 * F.sum("hits").over(above) / (F.sum("n").over(above) + F.sum("hits").over(whole))).alias("f1"),
            ((F.col("low") + F.coalesce(F.lead("high").over(below), F.lit(0.0))) / 2).alias("at"))
        return ranked.groupBy(key).agg(F.max(F.struct("f1", "bin", "at")).alias("best"), F.first("all_hits").alias("hits"), F.first("all_n").alias("n")).where("hits > 0")

    one = best(every.withColumn("lang", F.lit("")), "lang").collect()
    each = best(bins, "lang").where("hits < n").collect()
    return (one[0]["best"]["at"] if one else 0.5), {r["lang"]: r["best"]["at"] for r in each}


def toxicity_score(model: ConvolutionalModel, text: Column) -> Column:
    """Probability of label 1 for a whole text, as a column."""
    scorers: dict[int, Scorer] = {}

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scorer = scorers.setdefault(0, Scorer(model))
        return pa.array([s for i in range(0, len(texts), ROWS) for s in scorer(texts.slice(i, ROWS).to_pylist())], pa.float64())

    return score(utf8(text))


def language_threshold(model: ConvolutionalModel, lang: Column) -> Column:
    """The calibrated threshold of a row's language."""
    if not model.thresholds:
        return F.lit(model.threshold)
    pairs = [x for lang_name, t in sorted(model.thresholds.items()) for x in (F.lit(lang_name), F.lit(t))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(lang, F.lit(""))), F.lit(model.threshold))
