"""Benchmark passages in documents, found by q-gram filtering in diagonal bands and banded alignment.

Benchmark items are cut into overlapping windows of `window` bytes (shorter items are one window). A stretch of a document within k edits
of a window of m bytes shares at least m + 1 - q * (k + 1) q-grams with it, on diagonals at most k apart. So: positions whose q-gram occurs
in the benchmark; of those, the stretches dense enough; in these, shared q-grams counted by window and by overlapping diagonal bands; and
where a band reaches the bound, alignment within the band decides. The budget k is `edits` of the window's length.

Texts are compared as UTF-8 in lower case, with one space for any run of space and 09-0D. Items shorter than `least` bytes are looked for exactly, on
word bounds.

Cases: null or empty texts hold nothing; null or empty items and those of fewer than Q = 12 bytes, a word or two, match nothing; items that
repeat an id count together; null ids of documents are found, those of items are not looked for; rows that repeat a document's id are
found each; an empty benchmark or table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, utf8

Q = 12
#: Bytes of benchmark text that one pass over the documents holds; a larger benchmark takes several passes.
SHARD_BYTES = 16 << 20
#: Bytes of a document that are looked at together; neighbouring stretches overlap by a window and its budget.
STRETCH = 1 << 20
_FOLD = bytes(32 if i in b"\t\n\x0b\x0c\r" else i for i in range(256))
_BITS = 22


_SPACES = re.compile(rb"  +")
_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(128, 256))


def lowered(text: bytes) -> bytes:
    return (text if text.isascii() else text.decode().lower().encode()).lower().translate(_FOLD)


def folded(text: bytes) -> bytes:
    """Lower case, with one space for each run of white space."""
    text = lowered(text)
    return _SPACES.sub(b" ", text) if b"  " in text else text


def unfolded(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where spans of the folded text lie in the lower-cased one."""
    data = np.frombuffer(lowered(text), np.uint8)
    kept = np.flatnonzero(~((data == 32) & (np.concatenate([[0], data[:-1]]) == 32)))
    return [(int(kept[a]), int(kept[b - 1]) + 1) for a, b in spans]


def on_word_bounds(data: bytes, part: bytes) -> tuple[int, int] | None:
    """The first place of part in a folded text that cuts no word."""
    at = data.find(part)
    while at >= 0:
        end = at + len(part)
        if not (at and part[0] in _WORD and data[at - 1] in _WORD) and not (end < len(data) and part[-1] in _WORD and data[end] in _WORD):
            return at, end
        at = data.find(part, at + 1)
    return None


def _grams(data: bytes) -> np.ndarray:
    """A 64-bit key of the q-gram at each position."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    a = np.ndarray((n,), "<u8", data, strides=(1,))
    b = np.ndarray((n,), "<u4", data, 8, strides=(1,))
    return (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Windows:
    """The windows of a shard of the benchmark, with an index of their q-grams."""

    item: np.ndarray
    text: list[bytes]
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray  # sorted keys, and for each the window and the position in it
    window: np.ndarray
    place: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], window: int, edits: float, least: int, below: int | None = None) -> Windows:
        """Of the items of at least `least` bytes, and fewer than `below`."""
        ids, texts = [], []
        for item, text in items:
            text = folded(text).strip(b" ")
            if len(text) < max(least, Q) or below is not None and len(text) >= below:
                continue
            starts = [*range(0, max(1, len(text) - window + 1), window // 2)]
            if starts[-1] + window < len(text):
                starts.append(len(text) - window)
            for s in starts:
                ids.append(item)
                texts.append(text[s : s + window])
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        budget = np.minimum((sizes * edits).astype(np.int64), np.maximum(0, sizes // Q - 1))
        keys = [_grams(t) for t in texts]
        grams = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.empty(0, np.int64)
        order = np.argsort(grams, kind="stable")
        seen = np.zeros(1 << _BITS, bool)
        seen[grams >> np.uint64(64 - _BITS)] = True
        return cls(np.array(ids, dtype=np.int64), texts, budget, np.maximum(1, sizes + 1 - Q * (budget + 1)), grams[order], owner[order], place[order], seen)


def aligned(window: bytes, text: bytes, budget: int) -> tuple[int, int, int] | None:
    """Least edits (at most budget) of the whole window against a stretch of text, with that stretch: (edits, start, end)."""
    at = text.find(window)
    if at >= 0:
        return 0, at, at + len(window)
    t = np.frombuffer(text, np.uint8)
    column = np.arange(len(t) + 1)
    row, start = np.zeros(len(t) + 1, np.int64), column.copy()
    for i, c in enumerate(window):
        new = np.empty_like(row)
        origin = np.empty_like(start)
        new[0], origin[0] = i + 1, 0
        across = row[:-1] + (t != c)
        down = row[1:] + 1
        new[1:], origin[1:] = np.minimum(across, down), np.where(across <= down, start[:-1], start[1:])
        # An inserted byte costs one more than the best to the left.
        reach = np.minimum.accumulate((new - column) * (len(t) + 2) + column)
        source = reach - (reach // (len(t) + 2)) * (len(t) + 2)
        row, start = new[source] + column - source, origin[source]
        if row.min() > budget:
            return None
    end = int(np.argmin(row))
    return (int(row[end]), int(start[end]), end) if row[end] <= budget else None


def passages(data: bytes, w: Windows) -> list[tuple[int, int, int, int]]:
    """(window, edits, start, end) of the windows found in a folded text."""
    found: dict[int, tuple[int, int, int]] = {}
    longest = max(map(len, w.text), default=0)
    reach = int(longest + w.budget.max(initial=0))
    least = int(w.bound.min(initial=1))
    for offset in range(0, max(1, len(data)), STRETCH):
        part = data[offset : offset + STRETCH + 2 * reach]
        keys = _grams(part)
        hits = np.flatnonzero(w.seen[keys >> np.uint64(64 - _BITS)])
        if len(hits) < least:
            continue
        low = np.searchsorted(w.grams, keys[hits])
        real = w.grams[np.minimum(low, len(w.grams) - 1)] == keys[hits]
        hits, low = hits[real], low[real]
        if len(hits) < least:
            continue
        # A hit counts only with at least `least` hits within a window's reach on one side or the other.
        near = hits[least - 1 :] - hits[: len(hits) - least + 1] <= reach
        dense = np.zeros(len(hits) + 1, np.int64)
        runs = np.flatnonzero(near)
        np.add.at(dense, runs, 1)
        np.add.at(dense, runs + least, -1)
        kept = np.cumsum(dense[:-1]) > 0
        hits, low = hits[kept], low[kept]
        if not len(hits):
            continue
        many = np.searchsorted(w.grams, keys[hits], "right") - low
        each = np.repeat(np.arange(len(hits)), many)
        row = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        windows, diagonal = w.window[row], hits[each] - w.place[row] + longest
        width = np.maximum(1, 2 * w.budget[windows])
        for shift in (0, 1):
            band = (diagonal + shift * (width // 2)) // width
            pair = np.stack([windows, band], axis=1)
            order = np.lexsort(pair.T[::-1])
            pair = pair[order]
            first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)]))
            counts = np.diff(np.append(first, len(pair)))
            for k in first[counts >= w.bound[pair[first, 0]]]:
                v, b = int(pair[k, 0]), int(pair[k, 1])
                if found.get(v, (1,))[0] == 0:
                    continue
                size = max(1, 2 * int(w.budget[v]))
                begin = max(0, b * size - shift * (size // 2) - longest - int(w.budget[v]))
                if got := aligned(w.text[v], part[begin : begin + size + len(w.text[v]) + 2 * int(w.budget[v])], int(w.budget[v])):
                    hit = (got[0], offset + begin + got[1], offset + begin + got[2])
                    found[v] = min(found.get(v, hit), hit)
    return [(v, *hit) for v, hit in found.items()]


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = 100, edits: float = 0.06, least: int = 40) -> DataFrame:
    """doc_id, item_id, edits, windows, start, end: the items of which at least one window stands in a document.

    edits are the fewest of any window; start and end span all of them, in bytes of the lower-cased text. Items shorter than `least` bytes
    count where they stand whole and exactly, on word bounds.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8(F.col("text")).alias("text")).where("item_id IS NOT NULL")
    shards = 1 + int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_BYTES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    schema = "doc_id long, item_id long, edits long, windows long, start long, end long"

    def scan(shard: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        held = [(r["item_id"], bytes(r["text"])) for r in own.toLocalIterator()]
        shared = spark.sparkContext.broadcast((Windows.of(held, window, edits, least), Windows.of(held, least, 0.0, Q, least)))

        def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, brief = shared.value
            for batch in small_batches(batches):
                out: list[list[int]] = [[] for _ in range(6)]
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    data, by_item = folded(text), defaultdict(list)
                    for v, *hit in passages(data, w) if w.text else ():
                        by_item[int(w.item[v])].append(hit)
                    for v, *_ in passages(data, brief) if brief.text else ():
                        if at := on_word_bounds(data, brief.text[v]):
                            by_item[int(brief.item[v])].append([0, *at])
                    if not by_item:
                        continue
                    spans = unfolded(text, [(min(h[1] for h in hits), max(h[2] for h in hits)) for hits in by_item.values()])
                    for (item, hits), span in zip(by_item.items(), spans):
                        for column, value in zip(out, (doc_id, item, min(h[0] for h in hits), len(hits), *span)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[c.split()[0] for c in schema.split(", ")])

        return rows.mapInArrow(find, schema)

    found = scan(0)
    for shard in range(1, shards):
        found = found.union(scan(shard))
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark passage; rows with a null id stay."""
    return docs.join(contaminations(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
