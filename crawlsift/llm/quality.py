"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees over binned features, one feature (or pair of features) at a time, sums into one lookup table per
feature and pair. A score is the logistic of a sum of table entries.

Cases: a null text counts as empty and is scored like any other; rows without a label or id are not learned from; with no labelled
rows, or labels of one kind only, every score is the (smoothed) share of that label.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import ROWS, bounded_sample, utf8

MARKS = b"!*$%&#|.,;:?<>{}[]()=_/\\@\"'-+~^"
FEATURES = [
    "log_bytes", "upper", "lower", "digit", "space", "newline", "non_ascii", "marks", "exclaim", "decor", "bar", "stop", "comma",
    "words_per_byte", "distinct_words", "repeated_words", "short_words", "mean_line",
]


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts):
        n = len(text)
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words = text.split()
        m = max(1, len(words))
        non_ascii_upper = sum(text.count(bytes((0xC3, b))) for b in (0x84, 0x89, 0x8A, 0x87, 0x88, 0x8D, 0x91, 0x93, 0x96, 0x9C)) if counts[0xC3] else 0
        of = lambda some: counts[list(some)].sum() / max(1, n)
        row[:] = (
            np.log1p(n), (counts[65:91].sum() + non_ascii_upper) / max(1, n), counts[97:123].sum() / max(1, n), counts[48:58].sum() / max(1, n), of(b" \t"), of(b"\r\n"),
            counts[128:].sum() / max(1, n), of(MARKS), of(b"!"), of(b"*$%&#"), of(b"|"), of(b"."), of(b","),
            len(words) / max(1, n), len(set(words)) / m, sum(map(eq, words, words[1:])) / m,
            sum(len(w) < 3 for w in words) / m, np.log1p(n / (1 + counts[10])),
        )
    return out


@dataclass(frozen=True)
class AdditiveModel:
    """Bin edges per feature, a lookup table per feature, and coarse tables for pairs of features."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (edge, values) in enumerate(zip(self.edges, self.tables)):
            z += values[np.searchsorted(edge, x[:, j], "right")]
        for i, j, ei, ej, values in self.pairs:
            z += values[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between bins: quantiles of the distinct values, so that a value held by most rows doesn't hide the others."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.empty(0)
    cuts = np.concatenate([np.quantile(values, np.linspace(0, 1, bins // 2 + 1)[1:-1]), np.quantile(distinct, np.linspace(0, 1, bins // 2 + 1)[1:-1])])
    at = np.unique(np.searchsorted(distinct, cuts).clip(1, len(distinct) - 1))
    return (distinct[at - 1] + distinct[at]) / 2


def _step(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A shallow tree over ordered bins: the best cuts one after another; the Newton step of its leaf for each bin."""
    bounds = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(bounds, bounds[1:]):
            cut = np.arange(a + 1, b)
            cut = cut[(ch[cut] - ch[a] >= least) & (ch[b] - ch[cut] >= least)]
            if len(cut):
                won = gain(a, cut) + gain(cut, b) - gain(a, b)
                k = int(np.argmax(won))
                if won[k] > best[0]:
                    best = (won[k], int(cut[k]))
        if best[1] is None:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, pair_bins: int = 8, pairs: int = 6, leaves: int = 3, least: float = 0.5) -> AdditiveModel:
    """Boosts the features in turn, then the pairs whose residuals promise most, then both tables stay as they are."""
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(p0 / (1 - p0)))
    width = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return AdditiveModel(bias, [np.empty(0)] * width, [np.zeros(1)] * width, [])
    edges = [_edges(x[:, j], bins) for j in range(width)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            size = len(tables[j])
            step = rate * _step(np.bincount(at[j], g, size), np.bincount(at[j], h, size), leaves, least)
            tables[j] += step
            z += step[at[j]]
    coarse = [_edges(x[:, j], pair_bins) for j in range(width)]
    low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    g, h = slopes()
    ranked = []
    for i in range(width):
        for j in range(i):
            shape = (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
            cell = low[i] * (len(coarse[j]) + 1) + low[j]
            ranked.append((float((np.bincount(cell, g, shape) ** 2 / (np.bincount(cell, h, shape) + 1)).sum()), i, j))
    found = []
    for _, i, j in sorted(ranked, reverse=True)[:pairs]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        found.append((i, j, coarse[i], coarse[j], np.zeros(shape)))
    for _ in range(rounds // 4):
        for i, j, _, _, values in found:
            g, h = slopes()
            cell = low[i] * values.shape[1] + low[j]
            # A tree of depth two: cut one feature, then the other within each half.
            gm, hm = np.bincount(cell, g, values.size).reshape(values.shape), np.bincount(cell, h, values.size).reshape(values.shape)
            step = np.zeros(values.shape)
            side = _step(gm.sum(1), hm.sum(1), 2, least)
            for part in (side == side[0], side != side[0]):
                if part.any():
                    step[part] = rate * _step(gm[part].sum(0), hm[part].sum(0), 2, least)
            values += step
            z += step[low[i], low[j]]
    return AdditiveModel(bias, edges, tables, found)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 12000) -> AdditiveModel:
    """Fits on whole texts of the labelled rows given; `sample_rows` bounds how many (chosen by a hash of the id)."""
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    wanted = bounded_sample(wanted, F.col("doc_id"), sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    rows = rows.select(feature_udf()(utf8(F.col("text"))).alias("x"), "y").toArrow()
    y = rows["y"].to_numpy()
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, y])  # the order of arrival doesn't change the sums
    return fit_additive(x[order], y[order])


def feature_udf():
    @arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        parts = [text_features(texts.slice(i, ROWS).to_pylist()) for i in range(0, len(texts), ROWS)]
        flat = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat.ravel()))

    return features


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """Probability of label 1 for a whole text, as a column."""

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.scores(text_features(texts.slice(i, ROWS).to_pylist())) for i in range(0, len(texts), ROWS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(utf8(text))
