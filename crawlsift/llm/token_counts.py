"""Token counts of whole texts: pieces are counted once per distinct pre-token of the corpus, joined to each document's pre-token
frequencies and summed; ids are never made.

Pre-tokens are the tokenizer's own (of its byte-level pre-tokenizer), found once per distinct piece of text between white space.
Strings of special tokens inside texts count as one token, as the library has it by default.

Each document's pre-token frequencies are found in one pass: pre-tokens that a sample shows to be frequent are added up where the text
is read, the others are written as rows, from which the distinct ones are counted and to which their counts are joined.

Cases: a null text counts as empty (0 bytes, 0 tokens); rows that repeat an id stay rows of their own; an empty table gives no rows;
other columns are not read; a very long text is cut into parts of about a MB (whole where it has no ASCII white space).
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .frequencies import corpus_counts, document_rests, head_threshold, rests_with_values
from .shared import bounded_sample, cuts, small_batches, utf8, written

#: Distinct pieces whose pre-tokens a worker keeps; beyond it, it starts anew.
MEMO = 200_000
#: Bytes of a text that are pieces in memory at a time.
PART = 1 << 20
_PIECE = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_END = re.compile(rb"[!-~](?=[\t-\r ])")
#: White space beyond ASCII, or characters that libraries take differently: such a text is cut by the tokenizer as a whole.
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class PreTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(b"(" + b"|".join(map(re.escape, specials)) + b")") if specials else None
        self.memo: dict[bytes, tuple[bytes, ...]] = {}

    def pieces(self, text: bytes) -> list[bytes]:
        """The text in pieces whose pre-tokens don't depend on each other; special strings are pieces."""
        if self.special and self.special.search(text):
            return [p for part in self.special.split(text) if part for p in ([part] if self.special.fullmatch(part) else self._cut(part))]
        return self._cut(text)

    def counted(self, text: bytes) -> Counter:
        """How often the text holds each piece; a long text is worked through in parts, cut before white space."""
        if len(text) <= PART:
            return Counter(self.pieces(text))
        out: Counter = Counter()
        for start, stop in cuts(text, PART, _END):
            out.update(self.pieces(text[start:stop]))
        return out

    @staticmethod
    def _cut(text: bytes) -> list[bytes]:
        return ([text] if text else []) if _ODD.search(text) else _PIECE.findall(text)

    def of(self, piece: bytes) -> tuple[bytes, ...]:
        """Pre-tokens of a piece, in the tokenizer's byte alphabet (as UTF-8)."""
        got = self.memo.get(piece)
        if got is None:
            if piece[:1] == b" " and piece[1:].isalpha():
                got = ("Ġ".encode() + piece[1:],)
            elif self.special and self.special.fullmatch(piece):
                got = (b"\1" + piece,)
            else:
                got = tuple(t.encode() for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece.decode()))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(piece) < 100:
                self.memo[piece] = got
        return got

    def terms(self, pieces: Counter) -> Counter:
        out: Counter = Counter()
        for piece, n in pieces.items():
            for term in self.of(piece):
                out[term] += n
        return out

    def count(self, term: str) -> int:
        return 1 if term[:1] == "\1" else len(self.tokenizer.model.tokenize(term))


_pretokens: dict[str, PreTokens] = {}


def pretokens_of(path: Callable[[], str] | str) -> PreTokens:
    where = path() if callable(path) else path
    if where not in _pretokens:
        _pretokens[where] = PreTokens(where)
    return _pretokens[where]


def pretoken_pieces(terms: DataFrame, tokenizer: Callable[[], str] | str) -> DataFrame:
    """The rows of terms (distinct pre-tokens) with `pieces`, their tokens, counted once."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pretokens_of(tokenizer)
        for batch in small_batches(batches, 4096):
            counted = pa.array([own.count(t) for t in batch["term"].to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, counted], names=[*batch.schema.names, "pieces"])

    return terms.mapInArrow(pieces, StructType([*terms.schema, StructField("pieces", IntegerType())]))


def frequent_pretokens(rows: DataFrame, tokenizer: Callable[[], str] | str, head: int, sample_rows: int) -> dict[bytes, int]:
    """Tokens of the pre-tokens that are frequent in about `sample_rows` documents (at most `head` of them). Which ones these are decides
    only where a pre-token's tokens are added up, never the sums."""
    sample = bounded_sample(rows, F.col("doc_id"), sample_rows).select("text")
    counts = written(corpus_counts(sample, lambda seen: pretokens_of(tokenizer).terms(seen), lambda text: pretokens_of(tokenizer).counted(text)))
    least = max(2, head_threshold(counts, head))
    return {r["term"].encode(): r["pieces"] for r in pretoken_pieces(counts.where(F.col("n") >= least), tokenizer).toLocalIterator()}


def count_tokens(docs: DataFrame, tokenizer: Callable[[], str] | str, limit: int = 1024, head: int = 1 << 17, sample_rows: int = 10_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. Texts are read once (and a sample of them before)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(rows, tokenizer, head, sample_rows))

    def scan(pairs: Iterator[tuple]) -> Iterator[tuple[list, Counter]]:
        own, counted = pretokens_of(tokenizer), known.value
        for doc_id, text in pairs:
            here, rest = 0, Counter()
            for piece, n in own.counted(text).items():
                for term in own.of(piece):
                    if (m := counted.get(term)) is None:
                        rest[term] += n
                    else:
                        here += m * n
            yield [doc_id, len(text), here], rest

    fields = {"doc_id": "long", "n_bytes": "long", "here": "long"}
    rests = written(document_rests(rows, scan, fields))
    pieces = pretoken_pieces(rests.where(F.col("n") > 0).select("term").distinct(), tokenizer)
    found = rests_with_values(rests, fields, pieces, {"there": "n * pieces"})
    total = F.col("here") + F.coalesce("there", F.lit(0))
    return found.select("doc_id", "n_bytes", total.cast("long").alias("n_tokens"), (total > limit).alias("over_limit"))
