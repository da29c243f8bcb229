"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of several tables hashes a vector by floor((a.x + b) / w) for a few Gaussian directions a. A query visits its own bucket and
perturbed ones (each coordinate moved by up to two) in the order of their estimated success: the sum of squared distances to the
bounds crossed. All vectors of the visited buckets are candidates and are ranked by the exact measure. For inner products, vectors
get one more coordinate that makes all of them equally long, so that nearest by distance and largest by product agree.

The number of probes is the least that reaches `recall` on a bounded sample against brute force; every vector is indexed. Vectors are
written once, in blocks beside their buckets, not once for each table: as long as queries visit a good part of all buckets, copies by
bucket are many times the table. A task holds a block of queries and the k best rows of each, and reads the blocks of vectors one after
another. So disk holds a few times the vectors and k rows a query, whatever the number of candidates; time grows with queries x candidates.
A query that finds fewer than k goes through all blocks.

Cases: vectors null, zero, with null or non-finite components or of another than the most frequent length take no part; rows that
repeat an id are one vector (the smallest); ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_sample, released, written

HIT_SCHEMA = "query_id long, vec_id long, score double"
#: Bytes of a stored block's vectors and of a query block's, as blocks travel in pairs; rows of a stored block; buckets that the queries of a
#: block visit, and rows that they find.
STORED_BYTES, QUERY_BYTES, STORED_ROWS, QUERY_ROWS = 1 << 20, 4 << 20, 4096, 1 << 22
#: Below this share of visited vectors, looking them up one by one costs less than a product of all.
SELECTIVE = 1 / 60


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec: one row per id, of the most frequent length."""
    v = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    kept = vectors.select("vec_id", "embedding").where(F.coalesce(ok, F.lit(False))).groupBy("vec_id").agg(F.min("embedding").alias("vec"))
    kept = written(kept)
    top = kept.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.where(F.size("vec") == (top["n"] if top else 0))


@dataclass(frozen=True)
class Index:
    """Directions, offsets and width of all tables, the longest vector, and how many buckets a query visits in each table."""

    directions: np.ndarray  # tables x hashes x (dimensions + 1)
    offsets: np.ndarray
    width: float
    longest: float
    probes: int

    def _lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        length = np.linalg.norm(x, axis=1)
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - length**2))
        return np.column_stack([x * (self.longest / np.maximum(length, 1e-300))[:, None] if query else x, extra])

    def places(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Place of each vector along each direction, in bucket widths."""
        lifted = self._lift(x, query)
        return np.stack([(lifted @ d.T + b * self.width) / self.width for d, b in zip(self.directions, self.offsets)], axis=1)

    def moves(self) -> np.ndarray:
        return np.array(list(itertools.product(range(-2, 3), repeat=self.directions.shape[1])))

    def visits(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Buckets (queries x tables x probes x hashes) in estimated success order."""
        place = self.places(x, True)
        base = np.floor(place)
        inside = (place - base)[:, :, None, :]
        moves, step = self.moves(), np.arange(-2, 3)
        crossed = np.where(step > 0, step - inside[..., 0, :, None], np.where(step < 0, inside[..., 0, :, None] - step - 1, 0)) ** 2
        far = crossed[:, :, 0]  # sums over the hashes, in the order of `moves`
        for j in range(1, crossed.shape[2]):
            far = (far[..., :, None] + crossed[:, :, j, None, :]).reshape(*far.shape[:2], -1)
        order = np.argsort(far, axis=-1, kind="stable")[:, :, : probes or self.probes]
        return (base[:, :, None, :] + moves[order]).astype(np.int64)


def fit_index(vectors: DataFrame, k: int, tables: int, hashes: int, width: float, recall: float, sample_rows: int, queries: int, seed: int) -> Index | None:
    """Draws the directions; the width is `width` times the sample's mean distance; the probes reach the recall on the sample."""
    sample = bounded_sample(vectors, F.col("vec_id"), sample_rows).toArrow()
    if not sample.num_rows:
        return None
    x = np.array(sample["vec"].to_pylist(), dtype=float)
    x = x[np.argsort(sample["vec_id"].to_numpy())]
    longest = float(vectors.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v)))).first()[0]) * (1 + 1e-12)
    rng = np.random.default_rng(seed)
    draw = Index(rng.standard_normal((tables, hashes, x.shape[1] + 1)), rng.random((tables, hashes)), 1.0, longest, 5**hashes)
    asked = x[np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)]
    lifted = draw._lift(x, False)
    apart = np.sqrt(np.maximum(0, 2 * longest**2 - 2 * draw._lift(asked, True) @ lifted.T))
    index = Index(draw.directions, draw.offsets, width * max(float(apart.mean()), 1e-9), longest, 5**hashes)
    if len(x) <= k + 1:
        return index
    near = np.argsort(apart, axis=1)[:, 1 : k + 1]
    cell = np.floor(index.places(x)).astype(np.int64)
    first = np.full(near.shape, 5**hashes)  # the probe that meets each true neighbour first
    for i, buckets in enumerate(index.visits(asked)):
        for t in range(tables):
            same = (buckets[t][:, None, :] == cell[near[i], t][None, :, :]).all(-1)
            first[i] = np.minimum(first[i], np.where(same.any(0), same.argmax(0), 5**hashes))
    probes = int(np.quantile(first, recall)) + 1
    return Index(index.directions, index.offsets, index.width, longest, min(probes, 5**hashes))


def _hashed(buckets: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each row of bucket coordinates."""
    out = np.zeros(buckets.shape[:-1], dtype=np.uint64)
    for j in range(buckets.shape[-1]):
        out = (out ^ buckets[..., j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a task, `size` rows at a time; the last may be fewer."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            held.append(_vectors(batch.slice(start, size)))
            n += len(held[-1][0])
            if n >= size:
                ids, x = (np.concatenate(c) for c in zip(*held))
                yield ids[:size], x[:size]
                held, n = [(ids[size:], x[size:])], n - size
    if n:
        ids, x = (np.concatenate(c) for c in zip(*held))
        yield ids, x


def _fewer_equal(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Which rows stay where of equal vectors only those of the `most` smallest ids do."""
    x = np.ascontiguousarray(x)
    same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort([ids, same])
    start = np.flatnonzero(np.diff(same[order], prepend=-1))
    place = np.arange(len(ids)) - np.repeat(start, np.diff(start, append=len(ids)))
    return order[place < most]


def _stored(rows: DataFrame, index: Index, k: int, size: int) -> DataFrame:
    """Blocks of `size` vectors at most, one row each: ids, vectors, and the bucket of each vector in each table. Of equal vectors of a block
    the k + 1 smallest ids are kept, as no query can be given another; the order is random, so that no bucket comes at once."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _gathered(batches, size):
            kept = np.random.default_rng(len(ids)).permutation(np.sort(_fewer_equal(ids, x, k + 1)))
            ids, x = ids[kept], x[kept]
            buckets = _hashed(np.floor(index.places(x.astype(float))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (ids, x, buckets)], names=["ids", "vecs", "buckets"])

    return rows.select("vec_id", "vec").mapInArrow(pack, "ids binary, vecs binary, buckets binary")


def _asked(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """The queries in `parts` partitions, each a block or, where it holds more than `size`, several."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _gathered(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in block], names=["query_ids", "queries"])

    return rows.select("vec_id", "vec").repartition(parts).mapInArrow(pack, "query_ids binary, queries binary")


def _where(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values of a mask."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    word, byte = np.nonzero(flat.reshape(-1, 8)[words])
    return words[word] * 8 + byte


class _Nearest:
    """The k nearest so far of a block of queries, as blocks of vectors come by.

    Where buckets are selective, a query is compared with the vectors of those it visits. Else that costs more than a product of all
    queries and vectors: of that, in single precision, only what may be among a query's k nearest is looked at, and counts if one of
    the tables has it in a visited bucket. Scores are exact either way.
    """

    def __init__(self, index: Index, k: int, block: int, ids: np.ndarray, x: np.ndarray, everywhere: bool):
        self.index, self.k, self.block, self.ids, self.x = index, k, block, ids, x
        self.visits = None if everywhere else np.concatenate([_hashed(index.visits(x[i : i + 128].astype(float))) for i in range(0, len(x), 128)])
        self.score, self.found, self.seen = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max), 0
        self.length = np.linalg.norm(x.astype(float), axis=1) * index.longest
        self.unit = self._scaled(x, np.zeros(len(ids)))
        self.margin = (x.shape[1] + 16) * 2.0**-22
        some = np.linspace(0, len(ids) - 1, min(16, len(ids))).astype(int)
        self.some = [] if everywhere else [np.unique(self.visits[some, t], return_counts=True) for t in range(self.visits.shape[1])]

    def _scaled(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Vectors of length 1 and one more coordinate; all zero, so never ruled out, where a vector is too short for single precision."""
        length = np.linalg.norm(x.astype(float), axis=1)
        short = length < 1e-30 * self.index.longest
        out = np.column_stack([x / np.where(short, 1, length)[:, None], last])
        out[short] = 0
        return out.astype(np.float32)

    def add(self, ids: np.ndarray, x: np.ndarray, buckets: np.ndarray) -> None:
        unit = self._scaled(x, self.index.longest / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-30 * self.index.longest))
        start = 0
        while start < len(ids):  # few vectors first: they give the score that later ones must reach
            stop = min(len(ids), start + max(64, 2 * self.k, self.seen))
            self._add(*(c[start:stop] for c in (ids, x, unit, buckets)))
            self.seen, start = self.seen + stop - start, stop

    def _add(self, *piece: np.ndarray) -> None:
        few = self.score[:, -1] == -np.inf
        if self.visits is not None and self._visited(piece[3]) < SELECTIVE:
            few[:] = True
        looking, multiplied = np.flatnonzero(few), np.flatnonzero(~few)
        order = [np.argsort(c) for c in piece[3].T] if len(looking) else []
        filed = [(o, c[o]) for o, c in zip(order, piece[3].T)]
        for i in range(0, len(looking), self.block):
            self._look(looking[i : i + self.block], filed, piece)
        for i in range(0, len(multiplied), self.block):
            self._multiply(multiplied[i : i + self.block], piece, True)

    def _visited(self, buckets: np.ndarray) -> float:
        """What share of these vectors a query visits, a table counted like another: the mean of a few queries."""
        met = 0
        for (visits, n), c in zip(self.some, buckets.T):
            at = np.minimum(np.searchsorted(visits, c), len(visits) - 1)
            met += int(n[at][visits[at] == c].sum())
        return met / len(buckets) / min(16, len(self.ids))

    def _look(self, which: np.ndarray, filed: list, piece: tuple) -> None:
        """Offers the queries the vectors of the buckets they visit."""
        if self.visits is None:
            n = len(piece[0])
            self._offer(np.repeat(which, n), np.tile(np.arange(n), len(which)), piece)
            return
        for t, (order, buckets) in enumerate(filed):
            low = np.searchsorted(buckets, self.visits[which, t])
            n = np.searchsorted(buckets, self.visits[which, t], "right") - low
            each, ends = n.ravel(), np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(low.ravel() - ends + each, each)
            self._offer(np.repeat(which, n.sum(1)), order[at], piece)

    def _multiply(self, which: np.ndarray, piece: tuple, whole: bool) -> None:
        ids, _, unit, buckets = piece
        hits = _where(self.unit[which] @ unit.T > -self.margin)
        if whole and len(hits) > 64 * len(which):  # nearer than all before: again in growing pieces, each raising the score to be reached
            start = 0
            while start < len(ids):
                stop = start + max(64, start)
                self._multiply(which, tuple(c[start:stop] for c in piece), False)
                start = stop
            return
        for i in range(0, len(hits), 16384):
            q, v = np.divmod(hits[i : i + 16384], len(ids))
            q = which[q]
            if self.visits is not None:
                met = np.zeros(len(q), dtype=bool)
                for t in range(buckets.shape[1]):
                    left = np.flatnonzero(~met)
                    met[left] = (self.visits[q[left], t] == buckets[v[left], t][:, None]).any(1)
                q, v = q[met], v[met]
            self._offer(q, v, piece)

    def _offer(self, q: np.ndarray, v: np.ndarray, piece: tuple) -> None:
        """Queries and the vectors that each has met; the same pair may come from several tables."""
        ids, x = piece[:2]
        at_once = max(1, (1 << 20) // x.shape[1])
        for i in range(0, len(q), at_once):
            qs, vs = q[i : i + at_once], v[i : i + at_once]
            exact = (x[vs].astype(float) * self.x[qs].astype(float)).sum(1)  # the same sum for equal vectors, which a matrix product doesn't promise
            ok = (ids[vs] != self.ids[qs]) & (exact >= self.score[qs, -1])
            if ok.any():
                self._take(qs[ok], ids[vs[ok]], exact[ok])

    def _take(self, q: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        order = np.lexsort([ids, -exact, q])
        q, ids, exact = q[order], ids[order], exact[order]
        start = np.flatnonzero(np.diff(q, prepend=-1))
        n = np.diff(start, append=len(q))
        place, row = np.arange(len(q)) - np.repeat(start, n), np.repeat(np.arange(len(start)), n)
        some, top = q[start], place < self.k
        score, found = np.full((len(some), self.k), -np.inf), np.full((len(some), self.k), np.iinfo(np.int64).max)
        score[row[top], place[top]], found[row[top], place[top]] = exact[top], ids[top]
        score, found = np.column_stack([self.score[some], score]), np.column_stack([self.found[some], found])
        for _ in range(2):
            order = np.lexsort([found, -score])
            score, found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
            # now and then a vector is met in two tables: the second goes
            twice = np.zeros(score.shape, dtype=bool)
            twice[:, 1:] = (found[:, 1:] == found[:, :-1]) & (score[:, 1:] > -np.inf)
            if not twice.any():
                break
            score[twice], found[twice] = -np.inf, np.iinfo(np.int64).max
        self.score[some], self.found[some] = score[:, : self.k], found[:, : self.k]
        full = some[(self.score[some, -1] > -np.inf) & self.unit[some, :-1].any(1)]
        self.unit[full, -1] = -self.score[full, -1] / self.length[full]

    def hits(self) -> pa.RecordBatch:
        there = self.score > -np.inf
        columns = (np.repeat(self.ids, there.sum(1)), self.found[there], self.score[there])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _ranked(asked: DataFrame, stored: DataFrame, index: Index, k: int, block: int, kind: np.dtype, everywhere: bool) -> DataFrame:
    """The k nearest of each query among the blocks that its task reads. Every block of queries meets every block of vectors, but a
    block of vectors is read where it is needed, not shuffled, and a task keeps k rows of a query whatever it reads."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vecs, buckets, query_ids, queries = (batch.column(c)[row].as_buffer() for c in ("ids", "vecs", "buckets", "query_ids", "queries"))
                ids, query_ids = np.frombuffer(ids, np.int64), np.frombuffer(query_ids, np.int64)
                if query_ids[0] not in held:  # copied, as the buffers go with the batch
                    held[query_ids[0]] = _Nearest(index, k, block, query_ids.copy(), np.frombuffer(queries, kind).reshape(len(query_ids), -1).copy(), everywhere)
                held[query_ids[0]].add(ids, np.frombuffer(vecs, kind).reshape(len(ids), -1), np.frombuffer(buckets, np.int64).reshape(len(ids), -1))
        for found in held.values():
            yield found.hits()
        held.clear()
        released()

    return stored.hint("shuffle_replicate_nl").crossJoin(asked).mapInArrow(search, HIT_SCHEMA)


def _searched(rows: DataFrame, stored: DataFrame, index: Index, k: int, block: int, kind: np.dtype, shares: int, everywhere: bool) -> DataFrame:
    """Written: for each of `rows` the k nearest in each share of the stored blocks."""
    spark = rows.sparkSession
    n, tasks = rows.count(), 4 * spark.sparkContext.defaultParallelism
    most = max(1, min(QUERY_BYTES // (index.directions.shape[2] * kind.itemsize), QUERY_ROWS // max(k, len(index.directions) * index.probes)))
    size = min(most, max(2 * block, -(-n // tasks)))
    parts = max(1, -(-n // size))
    shares = max(1, min(shares, -(-tasks // parts)))
    asked = _asked(rows, parts, size + size // 8)  # rows are not dealt out quite evenly
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_before = spark.conf.get(key)
    spark.conf.set(key, str(2 * (STORED_BYTES + QUERY_BYTES)))
    try:
        return written(_ranked(asked, stored.coalesce(shares), index, k, block, kind, everywhere))
    finally:
        spark.conf.set(key, bytes_before)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 4, hashes: int = 4, width: float = 0.9, recall: float = 0.96, block: int = 512, sample_rows: int = 4000, sample_queries: int = 64, shares: int = 8, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector for which `is_query` (a condition on vec_id) holds. A query is
    in `shares` tasks at most, whose k rows each meet in a shuffle."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    index = fit_index(rows, k, tables, hashes, width, recall, sample_rows, sample_queries, seed)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = np.dtype({"float": np.float32}.get(rows.schema["vec"].dataType.elementType.typeName(), np.float64))
    rows = rows.withColumn("vec", F.col("vec").cast("array<float>" if kind == np.float32 else "array<double>"))
    asked = rows.where(is_query)
    size = min(STORED_ROWS, max(64, STORED_BYTES // (index.directions.shape[2] * kind.itemsize)))
    stored = written(_stored(rows, index, k, size))
    hits = _searched(asked, stored, index, k, block, kind, shares, False)
    least = min(k, rows.count() - 1)
    short = written(asked.join(hits.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= least), "vec_id", "left_anti"))
    if short.limit(1).count():  # too few found: these are compared with every vector
        hits = hits.union(_searched(short, stored, index, k, block, kind, shares, True)).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
