"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so copies are found and sums are made exactly. The distinct vectors are the fit list, written in blocks.
Each pass over it multiplies the centred covariance with a block of directions, X'(XQ)/n, in tasks whose partial products Spark sums; no
pass keeps more than dimensions x directions numbers, here or in the driver. A polynomial recurrence over such passes damps the spectrum
below the block's least Ritz value (all eigenvalues are at least 0, which bounds it from below); QR and Rayleigh-Ritz follow, until the
residuals of the wanted components certify them.

Cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do those with an entry whose 64-fold
leaves the range of long; where lengths differ, the most frequent one counts (the longer of two); null and repeated ids are rows like
others; directions without variance (an eigenvalue below 1e-12 of the trace) can't be whitened and give no rows, so one distinct vector
or an empty table gives none; equal eigenvalues leave the choice among their directions open; a deviation beyond long is null; other
columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Numbers of a block of the fit list.
BLOCK = 1 << 17
SCALE, OFFSET = 64, 1_000_000
#: Entries below this fit into long after scaling.
_TOP = 2.0**56


def whole_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, x of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    usable = F.coalesce(F.forall("v", lambda c: F.coalesce(F.abs(c) < _TOP, F.lit(False)) & ~F.isnan(c)), F.lit(False)) & (F.size("v") > 0)
    rows = rows.where(usable).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["d"] if sizes else 0))


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0), np.int64)


@dataclass(frozen=True)
class FitList:
    """The distinct vectors: blocks of them as bytes, their number, and exact sums by dimension."""

    blocks: DataFrame
    n: int
    sums: list[int]

    @staticmethod
    def of(rows: DataFrame) -> FitList:
        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch["x"]).astype("<i8")
                step = max(1, BLOCK // max(1, x.shape[1]))
                found = [x[i : i + step] for i in range(0, len(x), step)]
                sums = [[str(v) for v in (part.sum(0) if abs(part).max(initial=0) < 1 << 40 else part.astype(object).sum(0)).tolist()] for part in found]
                yield pa.RecordBatch.from_arrays([pa.array([len(part) for part in found], pa.int64()), pa.array(sums, pa.list_(pa.string())), pa.array([part.tobytes() for part in found], pa.binary())], names=["n", "sums", "block"])

        blocks = written(rows.select("x").dropDuplicates(["x"]).mapInArrow(pack, "n long, sums array<string>, block binary"))
        n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        sums = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        return FitList(blocks, n, [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])])

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def times(self, q: np.ndarray) -> tuple[np.ndarray, float]:
        """One pass: the covariance times the directions q, and its trace."""
        mean, d, k = self.mean, *q.shape

        def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, squares = np.zeros((d, k)), 0.0
            for batch in batches:
                for block in batch["block"]:
                    x = np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d) - mean
                    total += x.T @ (x @ q)
                    squares += float(np.einsum("ij,ij->", x, x))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * k + 1), pa.int32()), pa.array(np.append(total.ravel(), squares))], names=["at", "v"])

        sums = self.blocks.select("block").mapInArrow(products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(d * k + 1)
        flat[sums["at"].to_numpy()] = sums["v"].to_numpy()
        return flat[:-1].reshape(d, k) / self.n, float(flat[-1]) / self.n


@dataclass(frozen=True)
class Whitening:
    """Directions (columns) with their eigenvalues, the trace, and how they were certified."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int


def whitening(fit: FitList, components: int = 16, degree: int = 12, tolerance: float = 1e-12, rounds: int = 40, seed: int = 13) -> Whitening:
    """Filters a block of directions until every wanted one has a residual below `tolerance` of its eigenvalue, or rounding stops it."""
    d = len(fit.sums)
    wanted, width, passes = min(components, d), min(d, 2 * components), 0

    def ritz(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        q, _ = np.linalg.qr(block)
        vq, trace = fit.times(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        turn = turn[:, ::-1]
        return np.maximum(values[::-1], 0), q @ turn, vq @ turn, trace

    values, q, vq, trace = ritz(np.eye(d) if width == d else np.random.default_rng(seed).standard_normal((d, width)))
    passes, best, stalled = 1, np.inf, 0
    for _ in range(rounds):
        residuals = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        worst = float(np.max(residuals / np.maximum(values[:wanted], 1e-12 * max(trace, 1e-300))))
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        if worst <= tolerance or width == d or stalled == 3 or values[0] <= 0:
            break
        low = max(values[-1], 1e-9 * values[0])  # the unwanted spectrum lies in [0, low], or grows less than what is wanted
        centre = half = low / 2
        sigma = first = half / (values[0] - centre) if values[0] > centre else 1.0
        before, now = q, (vq - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            then = 1 / (2 / first - sigma)
            before, now = now, (fit.times(now)[0] - centre * now) * (2 * then / half) - sigma * then * before
            sigma = then
            passes += 1
        values, q, vq, trace = ritz(now)
        passes += 1
    real = int((values[:wanted] > 1e-12 * trace).sum())
    values, q = values[:real], q[:, :real]
    scale = np.sqrt(values)
    error = float(abs((q.T @ vq[:, :real]) / np.outer(scale, scale) - np.eye(real)).max(initial=0))
    return Whitening(values, q, trace, error, best, passes)


def whitened_rows(rows: DataFrame, fit: FitList, found: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    n, sums, mean, k = fit.n, fit.sums, fit.mean, len(found.values)
    onto, explained = found.vectors / np.sqrt(found.values), found.values / found.trace if k else found.values

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch["x"]), batch.num_rows
            if not rows or not k:
                continue
            largest = n * int(max(-x.min(), x.max(), 0)) + max(map(abs, sums))
            off = x * n - np.array(sums) if largest**2 * len(sums) < 1 << 63 else x.astype(object) * n - np.array(sums, object)
            deviation = [v if v < 1 << 63 else None for v in map(int, (off * off).sum(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(((x - mean) @ onto).ravel()),
                    pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, found.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 16, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Every usable row on the first components of the fit list's covariance, each scaled to variance 1."""
    rows = whole_vectors(vectors, id_column, column)
    fit = FitList.of(rows)
    if not fit.n:
        return whitened_rows(rows, fit, Whitening(np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0.0, 0))
    return whitened_rows(rows, fit, whitening(fit, components))
