"""Near copies by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Each tree of the forest orders the signature's values in its own way; sorted by that order, documents with a long common prefix are
neighbours. A region (a run of documents that share a prefix) starts at a short prefix; where it holds more than `region` documents it
is cut by the next longer prefix, as often as needed. Beyond the longest prefix a region is dealt into parts that all hold the same few
pivots. Inside a region the sorted neighbours, each document's most similar ones by signature, and the one similar to most become
candidates; a candidate pair counts only if the full sets agree to the threshold. Once these links have made components, every pair of
a region of the shortest prefix that lies in two of them and whose signatures agree is tested as well, where the region's blocks lie: a
block gives only links that join its components, never its pairs.

Documents with equal sets are one class from the start, so copies are never expanded into pairs. Components of the links are found by
passing the smallest id along links and shortcuts.

Cases: null, empty and white-space texts have no shingles and link with nothing; a text of fewer words than a shingle is one shingle;
rows that repeat an id are one document, linked with what links with any of its texts; null ids take part in nothing, form no component and are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from .shared import small_batches, utf8, written

HASHES, TREES = 128, 20
PREFIXES = (3, 5, 8, 14)
_rng = np.random.default_rng(20)
_ODD = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ORDERS = np.stack([_rng.permutation(HASHES) for _ in range(TREES)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct shingles of a whole text as sorted 64-bit hashes."""
    split = text.lower().split()  # ASCII only, both
    if not split:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, split)), ">u8").astype(np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(words, len(h))):
        out = (out ^ h[j : j + n]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out ^ np.uint64(len(h) if len(h) < words else 0))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Sixteen bits of each of HASHES minima."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 4096):
        np.minimum(low, (short[None, i : i + 4096] * _ODD[:, None]).min(1), out=low)
    return ((low * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2")


SHAPE = ["n_shingles", "f1", "f2"]


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set."""
    mixed = (shingles ^ (shingles >> np.uint64(31))) * _MIX
    return int(shingles.sum(dtype=np.uint64).astype(np.int64)), int(mixed.sum(dtype=np.uint64).astype(np.int64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the set in two longs, and the signature (null for empty sets)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[list] = [[], [], [], []]
            for text in batch["text"].to_pylist():
                s = shingle_set(text, words)
                for column, value in zip(out, (len(s), *fingerprint(s), signature(s).tobytes() if len(s) else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


@arrow_udf(ArrayType(ArrayType(LongType())))
def _prefix_keys(sigs: pa.Array) -> pa.Array:
    """For each tree, a key of each of its prefixes."""
    values = np.frombuffer(b"".join(s.as_buffer() for s in sigs), "<u2").reshape(len(sigs), HASHES).astype(np.uint64)
    keys = np.empty((len(sigs), TREES, len(PREFIXES)), np.uint64)
    for t in range(TREES):
        h = np.full(len(sigs), t + 1, np.uint64)
        for d in range(PREFIXES[-1]):
            h = (h ^ values[:, ORDERS[t, d]]) * _MIX
            h ^= h >> np.uint64(29)
            if d + 1 in PREFIXES:
                keys[:, t, PREFIXES.index(d + 1)] = h
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) * TREES + 1, dtype=np.int32) * len(PREFIXES)), pa.array(keys.astype(np.int64).ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * TREES), inner)


def _shared(rows: DataFrame, level: int) -> DataFrame:
    """The rows whose region of this level holds two classes or more, with their number m."""
    keyed = rows.withColumn("region", F.col("keys")[level])
    return keyed.join(keyed.groupBy("region").agg(F.count("*").alias("m")).where("m > 1"), "region")


def widest_regions(classes: DataFrame) -> DataFrame:
    """region, rep, tree, keys, m: regions of the shortest prefix."""
    return written(_shared(classes.select("rep", F.posexplode(_prefix_keys("sig")).alias("tree", "keys")), 0))


def _regions(widest: DataFrame, region: int) -> DataFrame:
    """rep, tree, region: of all regions of two classes or more, cut where dense."""
    left, out = widest, []
    for level in range(1, len(PREFIXES)):
        out.append(left.where(F.col("m") <= region))
        left = _shared(left.where(F.col("m") > region).select("rep", "tree", "keys"), level)
    out.append(left.where(F.col("m") <= region))
    dense = left.where(F.col("m") > region).withColumn("parts", F.ceil(F.col("m") / region))
    pivots = dense.groupBy("region").agg(*[F.min_by("rep", F.xxhash64("rep", "tree", F.lit(i))).alias(f"p{i}") for i in range(4)], F.first("tree").alias("tree"), F.max("parts").alias("parts"))
    pivots = pivots.select(F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(4)]))).alias("rep"), "tree", "region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = dense.select("rep", "tree", "region", F.pmod(F.xxhash64("rep", "tree"), F.col("parts")).alias("part")).union(pivots).distinct()
    done = out[0].select("rep", "tree", "region")
    for x in out[1:]:
        done = done.union(x.select("rep", "tree", "region"))
    return done.union(dealt.select("rep", "tree", F.xxhash64("region", "part").alias("region")))


def region_pairs(reps: np.ndarray, sigs: np.ndarray, tree: int, least: float) -> Iterator[tuple[int, int]]:
    """Candidates of one region: index pairs."""
    n = len(reps)
    order = np.lexsort(sigs[:, ORDERS[tree, PREFIXES[-1] :: -1]].T)
    best = np.full((n, min(4, n - 1)), -1)
    crowd, alike = np.zeros(n, int), np.empty((n, n), np.uint8)
    for i in range(0, n, 32):
        alike[i : i + 32] = (sigs[i : i + 32, None, :] == sigs[None, :, :]).sum(-1)
    np.fill_diagonal(alike, 0)
    enough = least * HASHES
    if n <= 8:
        yield from zip(*np.nonzero(np.triu(alike >= enough)))
        return
    best = np.argpartition(-alike.astype(np.int16), 4, axis=1)[:, :4]
    crowd = (alike >= 0.8 * HASHES).sum(1)
    centre = np.full(n, int(np.argmax(crowd)))
    for a, b in ((np.repeat(np.arange(n), 4), best.ravel()), (order[:-1], order[1:]), (np.arange(n), centre)):
        ok = alike[a, b] >= enough
        yield from zip(a[ok], b[ok])


def candidates(classes: DataFrame, widest: DataFrame, region: int, least: float) -> DataFrame:
    """Distinct pairs (a < b) of class representatives from all trees whose signatures agree in a share of at least `least`."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(group: list[tuple]) -> list[tuple[int, int]]:
            reps = np.array([g[1] for g in group])
            sigs = np.frombuffer(b"".join(g[2] for g in group), "<u2").reshape(len(group), HASHES)
            return [(int(min(x, y)), int(max(x, y))) for a, b in region_pairs(reps, sigs, group[0][3], least) if (x := reps[a]) != (y := reps[b])]

        for batch in small_batches(batches, 2048):
            out: set[tuple[int, int]] = set()
            for row in zip(*(batch[c].to_pylist() for c in ("region", "rep", "sig", "tree"))):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        out.update(found(held))
                    held = []
                held.append(row)
            yield _pair_batch(out)
        if len(held) > 1:
            yield _pair_batch(set(found(held)))

    rows = _regions(widest, region).join(classes.select("rep", "sig"), "rep")
    rows = rows.repartition("region").sortWithinPartitions("region", "rep").select("region", "rep", "sig", "tree")
    return rows.mapInArrow(pairs, "a long, b long").distinct()


def apart_pairs(sigs: np.ndarray, sizes: np.ndarray, roots: np.ndarray, parts: np.ndarray, least: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of a block whose signatures agree in a share of at least `least`, whose roots differ and whose set sizes allow
    the similarity, the most alike first; with two parts in the block, pairs of different parts."""
    order = np.argsort(roots, kind="stable")
    sigs, sizes, roots, parts = sigs[order], sizes[order], roots[order], parts[order]
    after, several = np.searchsorted(roots, roots, "right"), bool((parts != parts[0]).any())
    found = []
    for i in range(0, len(roots), 32):
        low = after[i]
        if low == len(roots):
            break
        mine = slice(i, i + 32)
        alike = np.count_nonzero(sigs[mine, None, :] == sigs[None, low:, :], axis=-1)
        ok = (alike >= least * HASHES) & (roots[mine, None] < roots[None, low:])
        ok &= 100 * np.minimum(sizes[mine, None], sizes[None, low:]) >= percent * np.maximum(sizes[mine, None], sizes[None, low:])
        if several:
            ok &= parts[mine, None] != parts[None, low:]
        x, y = np.nonzero(ok)
        found.append((x + i, y + low, alike[x, y]))
    if not found:
        return order[:0], order[:0]
    a, b, alike = (np.concatenate(x) for x in zip(*found))
    by = np.argsort(-alike, kind="stable")
    return order[a[by]], order[b[by]]


def agree(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


def block_links(reps: np.ndarray, sigs: np.ndarray, sizes: np.ndarray, roots: np.ndarray, parts: np.ndarray, sets: list[bytes], least: float, percent: int) -> list[tuple[int, int]]:
    """Links of a block between different components, confirmed on full sets: enough of them to join all components that the block links.
    Pairs of components that links found before already join are not tested again, so the block gives fewer links than it has rows."""
    top = {r: r for r in roots.tolist()}

    def root_of(r: int) -> int:
        while top[r] != r:
            top[r] = r = top[top[r]]
        return r

    out, held = [], {}
    for a, b in zip(*(x.tolist() for x in apart_pairs(sigs, sizes, roots, parts, least, percent))):
        x, y = root_of(int(roots[a])), root_of(int(roots[b]))
        if x == y:
            continue
        for i in (a, b):
            if i not in held:
                held[i] = unpacked(sets[i])
        if agree(held[a], held[b], percent):
            top[max(x, y)] = min(x, y)
            out.append((int(min(reps[a], reps[b])), int(max(reps[a], reps[b]))))
    return out


def apart(classes: DataFrame, widest: DataFrame, roots: DataFrame, known: DataFrame, reps: DataFrame, words: int, region: int, least: float, percent: int) -> DataFrame:
    """a, b: links between components, from every pair of a region of the shortest prefix that no component holds yet and whose signatures
    agree. Regions of eight or fewer were compared in full before."""

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(group: list[tuple]) -> pa.RecordBatch:
            reps, roots, sizes, parts = (np.array([g[k] for g in group]) for k in (1, 2, 3, 4))
            sigs = np.frombuffer(b"".join(g[5] for g in group), "<u2").reshape(len(group), HASHES)
            return _pair_batch(set(block_links(reps, sigs, sizes, roots, parts, [g[6] for g in group], least, percent)))

        for batch in small_batches(batches):
            for row in zip(*(batch[c].to_pylist() for c in ("block", "rep", "root", "n_shingles", "part", "sig", "set"))):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        yield found(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield found(held)

    rows = widest.where(F.col("m") > 8).select("region", "rep", "m", "tree").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = rows.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("region")
    rows = written(_blocks(rows.join(mixed, "region"), region))
    sets = class_sets(rows.select("rep").distinct(), known, reps, words)
    full = sets.join(classes.select("rep", "sig", "n_shingles"), "rep")
    rows = rows.join(full, "rep").repartition("block").sortWithinPartitions("block", "rep").select("block", "rep", "root", "n_shingles", "part", "sig", "set")
    return rows.mapInArrow(links, "a long, b long").distinct()


def _blocks(rows: DataFrame, region: int) -> DataFrame:
    """rep, root, part, block: regions of up to `region` as they are; a larger one is dealt into parts of about half of that, and each two
    of its parts meet in a block of their own (for parts of their own kind, in one more)."""
    few = rows.where(F.col("m") <= region).select("rep", "root", F.lit(0).cast("long").alias("part"), F.col("region").alias("block"))
    parts = F.ceil(F.col("m") / (region / 2))
    dense = rows.where(F.col("m") > region).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep", "tree"), F.col("parts")))
    dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return few.union(dense.select("rep", "root", "part", F.xxhash64("region", F.least("part", "other"), F.greatest("part", "other")).alias("block")))


def _pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def likely_members(ids: DataFrame):
    """A column function that is true for every id of the one-column table and for few others, from a bitmap of 2 MB whatever the number of
    ids: it keeps most rows out of a shuffle before the exact join. The driver gets at most one row per byte of it."""
    place = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(1 << 24))
    rows = ids.select(place.alias("h")).groupBy((F.shiftright("h", 3)).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1, CAST(h % 8 AS INT)))").alias("bits")).toArrow()
    bits = np.zeros(1 << 21, np.uint8)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        h = h.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool))

    return lambda c: maybe(F.pmod(F.xxhash64(c), F.lit(1 << 24)))


def unpacked(data) -> np.ndarray:
    """A set from its bytes, six for each of the sorted hashes."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def class_sets(members: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """rep, set of the classes named in `members`: of a text with the class's own fingerprint, also where rows repeat the id that stands for
    the class. Sets hold 48 bits of each shingle's hash."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                s = shingle_set(text, words)
                # six bytes of each hash: the sets are the largest thing that is shuffled
                out.append((doc, len(s), *fingerprint(s), np.ascontiguousarray(np.sort(s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in out], pa.binary())], names=["doc", *SHAPE, "set"])

    members = written(members.join(classes.select("rep", "doc", *SHAPE), "rep"))
    ids = members.select(F.col("doc").alias("doc_id")).distinct()
    # an operator of its own: sets are made of the texts that the joins leave
    found = docs.where(likely_members(ids)(F.col("doc_id"))).join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc long, n_shingles long, f1 long, f2 long, set binary")
    return written(found.join(members, ["doc", *SHAPE]).select("rep", "set").dropDuplicates(["rep"]))


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets agree: 100 * intersection >= percent * union."""

    @arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([agree(unpacked(x.as_buffer()), unpacked(y.as_buffer()), percent) for x, y in zip(a, b)], pa.bool_())

    kept = class_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), docs, classes, words)
    with_a = pairs.join(kept.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a")
    return with_a.join(kept.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b").where(alike("sa", "sb")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach, for all nodes of the links."""
    both = written(links.union(links.select("b", "a")).toDF("node", "other").distinct())
    roots = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        nearer = roots.join(near, "node").select("node", "root", F.least("root", "seen").alias("low"))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("far"))
        after = written(nearer.join(jump, "low", "left").select("node", F.least("low", "far").alias("root"), (F.least("low", "far") != F.col("root")).alias("moved")))
        roots = after.select("node", "root")
        if not after.where("moved").limit(1).count():
            return roots


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after some more links: components of the components."""

    def at_root(links: DataFrame, end: str) -> DataFrame:
        return links.join(roots.toDF(end, "r"), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")

    further = components(at_root(at_root(links, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).toDF("root", "low")
    known = roots.join(further, "root", "left").select("node", F.coalesce("low", "root").alias("root"))
    # a node without links before is its own root
    single = further.select(F.col("root").alias("node"), F.col("low").alias("root")).join(roots, "node", "left_anti")
    return written(known.union(single))


def _small(rows: DataFrame, limit: int = 100_000) -> DataFrame:
    """The written table, with a hint to broadcast where it is small: repeated ids and their like are few or none."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def classes_of(real: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (rep, doc, n_shingles, f1, f2), and links between those that a repeated id brings together.

    rep is the smallest id of a class; where that stands for several classes, the others have a number above all ids.
    """
    firsts = written(real.groupBy(*SHAPE).agg(F.min("doc_id").alias("doc")))
    several = written(firsts.groupBy("doc").agg(F.min(F.struct(*SHAPE)).alias("first"), F.max(F.struct(*SHAPE)).alias("last")).where("first <> last").select("doc", "first"))
    other = F.lit(1 << 62) + F.pmod(F.xxhash64(*SHAPE), F.lit(1 << 61))
    rep = F.when(F.col("first").isNull() | (F.col("first") == F.struct(*SHAPE)), F.col("doc")).otherwise(other)
    classes = written(firsts.join(_small(several), "doc", "left").select(rep.alias("rep"), "doc", *SHAPE))
    links = classes.where("rep <> doc").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    repeated = written(real.groupBy("doc_id").agg(F.min(F.struct(*SHAPE)).alias("first"), F.max(F.struct(*SHAPE)).alias("last")).where("first <> last").select("doc_id"))
    if repeated.isEmpty():
        return classes, links
    held = written(real.join(_small(repeated), "doc_id", "left_semi").select("doc_id", *SHAPE).distinct().join(classes, SHAPE).select("doc_id", "rep"))
    least = written(held.groupBy("doc_id").agg(F.min("rep").alias("a")))
    return classes, links.union(held.join(_small(least), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, region: int = 1000, slack: float = 0.16) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs. `slack`: how far a signature may understate a similarity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    signed = written(signatures(rows, words))
    real = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps, same_id = classes_of(real)
    firsts = real.withColumnRenamed("doc_id", "doc").join(reps.select("rep", "doc", *SHAPE), ["doc", *SHAPE])
    classes = written(firsts.select("rep", "sig", "n_shingles").dropDuplicates(["rep"]))
    least, known = percent / 100 - slack, rows.where("doc_id IS NOT NULL")
    widest = widest_regions(classes)
    pairs = written(candidates(classes, widest, region, least))
    roots = components(confirmed(pairs, known, reps, words, percent).union(same_id))
    # What is not in one component yet.
    further = written(apart(classes, widest, roots, known, reps, words, region, least, percent))
    if not further.isEmpty():
        roots = joined(roots, further)
    named = written(reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*SHAPE, F.coalesce("root", "rep").alias("root")))
    found = signed.select("doc_id", *SHAPE).join(named, SHAPE, "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one document of each component stays."""
    gone = written(near_duplicates(docs, words, percent).where("NOT kept").select("doc_id"))
    maybe = likely_members(gone)(F.col("doc_id").cast("long"))
    rest = docs.where(maybe).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return docs.where(~maybe).union(rest)
