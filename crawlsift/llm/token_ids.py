"""Token ids of whole texts in a compact binary file format, written in id order and read back.

The format is word-aligned (Simple-8b): the top four bits of a 64-bit word select how many ids of how many bits follow. Ids that need
more than fifteen bits stand as an escape mark in their lane and in full in a side list. A file row holds the ids of some whole
documents in blocks of BLOCK ids; for each block it has the first word and the first escape, so that a block decodes alone.

Cases: a null text has only the end id; repeated document ids follow each other; null ids come first; an empty table gives no rows; other
columns are not read; a very long text is cut into words some MB at a time, but its ids are one document of one file row.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cuts, small_batches, utf8, written

# Fixed values of the format: ids in a word and bits of each, by selector.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
WIDTHS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
ESCAPE = 0x7FFF
BLOCK = 8192
#: Ids after which a file row ends, with the document that reaches them.
ROW_IDS = 16384
#: Bytes of text that are words in memory at a time.
SLICE = 2 << 20
_SPACE = re.compile(rb"[\t-\r ]")

_SHIFTS = [np.arange(n, dtype=np.uint64) * np.uint64(w) for n, w in zip(COUNTS, WIDTHS)]


def pack_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escapes of one block of unsigned ids; each word takes as many ids as fit."""
    lanes = np.minimum(ids, ESCAPE)
    n = len(ids)
    chosen = np.minimum(3, np.arange(n, 0, -1) - 1).astype(np.int8)  # up to four ids fit always
    for s in range(4, len(COUNTS)):
        wide = lanes >> int(WIDTHS[s]) > 0
        count = int(COUNTS[s])
        if n < count or n - int(np.count_nonzero(wide)) < count:
            break
        seen = np.zeros(n + 1, np.int32)
        np.cumsum(wide, out=seen[1:])
        fits = seen[count:] == seen[:-count]
        if not fits.any():
            break  # more ids of fewer bits fit nowhere either
        chosen[: n - count + 1][fits] = s
    after, starts, at = (np.arange(n) + COUNTS[chosen]).tolist(), [], 0
    while at < n:
        starts.append(at)
        at = after[at]
    starts = np.array(starts, dtype=np.int64)
    selectors = chosen[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    lanes = lanes.astype(np.uint64)
    for s in np.unique(selectors):
        mine = np.flatnonzero(selectors == s)
        words[mine] |= np.bitwise_or.reduce(lanes[starts[mine][:, None] + np.arange(COUNTS[s])] << _SHIFTS[s], axis=1)
    return words, ids[ids >= ESCAPE].astype(np.uint32)


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of any number of whole blocks: all words of a selector at a time."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.uint32)
    for s in np.unique(selectors):
        mine = np.flatnonzero(selectors == s)
        lanes = (words[mine][:, None] >> _SHIFTS[s]) & np.uint64((1 << int(WIDTHS[s])) - 1)
        out[first[mine][:, None] + np.arange(COUNTS[s])] = lanes
    out[out == ESCAPE] = escapes
    return out


class WordCache:
    """Ids of words by a 64-bit hash of the word. A slot keeps the last word met there, so the cache takes 2 ** bits slots of a few bytes
    whatever the input; words of more than WIDTH ids are not kept. (Two words of one hash would meet once in some 10^9 distinct words.)"""

    WIDTH = 6

    def __init__(self, largest: int, bits: int = 21):
        self.keys, self.counts = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint8)
        self.ids = np.zeros((1 << bits, self.WIDTH), np.uint16 if largest < 1 << 16 else np.uint32)

    def slots(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and slot of each word, and whether the slot holds it."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) | np.uint64(1 << 63)  # 0 is an empty slot
        slot = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        return h, slot, self.keys[slot] == h

    def keep(self, h: np.ndarray, slot: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        short = np.flatnonzero(counts <= self.WIDTH)
        at = (np.cumsum(counts) - counts)[short]
        lanes = np.arange(self.WIDTH)
        filled = lanes < counts[short, None]
        self.keys[slot[short]], self.counts[slot[short]] = h[short], counts[short]
        self.ids[slot[short]] = np.where(filled, ids[np.where(filled, at[:, None] + lanes, 0)], 0) if len(ids) else 0


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run behind the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class WordEncoder:
    """Ids of whole texts through the tokenizer, which is asked once for each distinct word between white space in some MB of text, and not
    for those that the cache holds.

    That is exact for tokenizers that drop white space and never join across it. Words of Latin letters are encoded many at a time
    where each word's last piece is marked as such in the vocabulary.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.cache = WordCache(len(self.ends))

    def _slowly(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        for word, got in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            into[word] = np.array(got.ids, dtype="<u4").tobytes()

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit integers."""
        found: dict[bytes, bytes] = {}
        plain, other = [], []
        for word in words:
            core = word.rstrip(b".,;:!?*$%&#|")
            if core.isalpha() or (core and (text := core.decode()).isalpha() and max(text) < "Ā"):
                plain.append((word, core, word[len(core):]))
            else:
                other.append(word)
        self._slowly(other, found)
        if tails := {tail for _, _, tail in plain if tail and tail not in found}:
            self._slowly(list(tails), found)
        cores = list({core for _, core, _ in plain if core not in found})
        lists = [cores[i : i + 500] for i in range(0, len(cores), 500)]
        for some, got in zip(lists, self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lists], add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<u4")
            cut = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cut) == len(some) and cut[-1] == 4 * len(ids):
                data = ids.tobytes()
                found.update(zip(some, [data[a:b] for a, b in zip([0, *cut], cut)]))
            else:
                self._slowly(some, found)
        return [found[core] + found[tail] if tail else found[core] for core, tail in self._parts(words, plain)]

    @staticmethod
    def _parts(words: list[bytes], plain: list[tuple[bytes, bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        cut = {word: (core, tail) for word, core, tail in plain}
        return [cut.get(word, (word, b"")) for word in words]

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in order, and how many each has."""
        encoded = words.dictionary_encode()
        distinct = encoded.dictionary.cast(pa.binary()).to_pylist()
        at = encoded.indices.to_numpy(zero_copy_only=False)
        h, slot, known = self.cache.slots(distinct)
        missing = np.flatnonzero(~known)
        learned = self.learn([distinct[i] for i in missing.tolist()])
        new = np.frombuffer(b"".join(learned), "<u4")
        counts = self.cache.counts[slot].astype(np.int64)
        counts[missing] = np.fromiter(map(len, learned), np.int64, len(learned)) // 4
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), "<u4")
        flat[_spread(starts[missing], counts[missing])] = new
        held = np.flatnonzero(known)
        flat[_spread(starts[held], counts[held])] = self.cache.ids[slot[held]][np.arange(WordCache.WIDTH) < counts[held, None]]
        self.cache.keep(h[missing], slot[missing], counts[missing], new)
        lengths = counts[at]
        return flat[_spread(starts[at], lengths)], lengths

    def encode(self, texts: pa.Array | list[bytes]) -> Iterator[bytes]:
        """The ids of each text (as binary) as little-endian unsigned 32-bit integers, some MB of text at a time."""
        texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
        sizes, start = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0
        while start < len(texts):
            if sizes[start] > SLICE:
                body = texts[start].as_py()
                yield b"".join(ids for a, b in cuts(body, SLICE, _SPACE) for ids in self._slice(pa.array([body[a:b]], pa.binary())))
                start += 1
                continue
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE, "right")))
            yield from self._slice(texts.slice(start, stop - start))
            start = stop

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        # ASCII letters and white space only: the tokenizer would do both, but for its special strings, which it matches before
        special = pc.match_substring(texts, b"<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), pa.scalar(b"", pa.binary()), texts).cast(pa.string()) if special.any() else texts.cast(pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        words, text_of = pc.list_flatten(lists), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(words), 0)
        ids, lengths = self.coded(words.filter(real))
        sums = np.bincount(text_of.filter(real).to_numpy(zero_copy_only=False), lengths, len(texts)).astype(np.int64)
        data, at = ids.tobytes(), 0
        for i, n in enumerate(sums.tolist()):
            if special[i]:
                kept = [w if b"<|" in w else w.lower() for w in texts[i].as_py().split()]
                yield self.coded(pa.array(kept, pa.binary()))[0].tobytes()
            else:
                yield data[4 * at : 4 * (at + n)]
                at += n


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: Callable[[], str] | str) -> WordEncoder:
    where = path() if callable(path) else path
    if where not in _encoders:
        _encoders[where] = WordEncoder(where)
    return _encoders[where]


FILE_SCHEMA = "part int, row long, first long, doc_ids array<long>, counts array<long>, words binary, escapes binary, block_words array<int>, block_escapes array<int>"


def write_token_files(docs: DataFrame, tokenizer: Callable[[], str] | str, end_id: int = 1) -> DataFrame:
    """Encodes whole texts and writes the files; returns their rows as read from the shared folder.

    A range of ids is one task and one file (`part`, in id order); `first` counts the ids before a row within its part.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row, first = encoder_of(tokenizer), TaskContext.get().partitionId(), 0, 0
        doc_ids, data = [], []

        def flush() -> pa.RecordBatch:
            nonlocal row, first, doc_ids, data
            counts = [len(x) // 4 for x in data]
            ids = np.frombuffer(b"".join(data), dtype="<u4")
            packed = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
            starts = [np.cumsum([0, *(len(p[k]) for p in packed)])[:-1].tolist() for k in (0, 1)]
            out = [part, row, first, doc_ids, counts, np.concatenate([p[0] for p in packed]).astype("<u8").tobytes(), np.concatenate([p[1] for p in packed]).astype("<u4").tobytes(), *starts]
            row, first, doc_ids, data = row + 1, first + len(ids), [], []
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types)], names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

        size = 0
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"])):
                doc_ids.append(doc_id)
                data.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= ROW_IDS:
                    yield flush()
                    size = 0
        if data:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(ordered.mapInArrow(rows, FILE_SCHEMA))


def part_starts(files: DataFrame) -> DataFrame:
    """Ids before each part: a running sum over one row per file."""
    totals = files.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, from the decoded ids."""

    def docs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 16):
            out = [[], [], [], []]
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u4")).astype("<u4").tobytes()
                start, at = row["part_start"] + row["first"], 0
                for doc_id, n in zip(row["doc_ids"], row["counts"]):
                    for column, value in zip(out, (doc_id, start, n, zlib.crc32(ids[at : at + 4 * n]))):
                        column.append(value)
                    start, at = start + n, at + 4 * n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    needed = files.select("part", "first", "doc_ids", "counts", "words", "escapes").join(F.broadcast(part_starts(files)), "part")  # one row per file
    return needed.mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long")
