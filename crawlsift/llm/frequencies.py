"""Terms of a corpus: counts over all documents, and sums over each document's term frequencies by a join.

The most frequent terms (at most `head` of them) travel to every worker, so a document's terms of that kind are summed where it is
read. Only the frequencies of the rarer ones are shuffled to their counts, so no term that many documents share meets in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches

#: Distinct terms a task gathers before it passes their counts on.
FLUSH = 200_000


def corpus_counts(texts: DataFrame, terms_of: Callable[[Counter], Counter], pieces_of: Callable[[bytes], list]) -> DataFrame:
    """term, n: over all rows of the one binary column. `pieces_of` cuts a text, `terms_of` turns counted pieces into counted terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            terms = terms_of(seen)
            out = pa.RecordBatch.from_arrays([pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(list(terms.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return out

        for batch in small_batches(batches):
            for text in batch[0].to_pylist():
                seen.update(pieces_of(text))
            if len(seen) >= FLUSH:
                yield flush()
        if seen:
            yield flush()

    return texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def head_threshold(counts: DataFrame, head: int) -> int:
    """The least count such that at most `head` terms have it or more (by eighths of a power of two)."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)  # at most 512 rows
    total, least = 0, None
    for at, n in sizes:
        total += n
        if total > head:
            break
        least = at
    return 1 << 62 if least is None else int(-(-(2 ** (least / 8)) // 1))


def document_rests(docs: DataFrame, scan: Callable[[Iterator[tuple[int | None, bytes]]], Iterator[tuple[list, Counter]]], fields: dict[str, str]) -> DataFrame:
    """uid, term, n, base: a row for each of a document's rarer terms with its frequency; one of them holds `fields` in base.

    scan gives for each document (doc_id, text as binary) the values of fields and the Counter of rarer terms. A document without any has
    one row, with a term of its own and n = 0.
    """
    types = {"long": pa.int64(), "double": pa.float64()}
    base = pa.struct([(name, types[kind]) for name, kind in fields.items()])
    names = ["uid", "term", "n", "base"]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in small_batches(batches):
            pairs = zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())
            out: list[list] = [[], [], [], []]
            for found, rest in scan(pairs):
                uid += 1
                terms = list(rest) or [b"\0%d" % uid]  # a term of its own: not null, which would bring all such rows into one task
                out[0] += [uid] * len(terms)
                out[1] += terms
                out[2] += rest.values() if rest else [0]
                out[3] += [dict(zip(fields, found)), *[None] * (len(terms) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()).cast(pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], base)], names=names)

    schema = "uid long, term string, n long, base struct<" + ", ".join(f"{name}: {kind}" for name, kind in fields.items()) + ">"
    return docs.mapInArrow(rows, schema)


def rests_with_values(rests: DataFrame, fields: Iterable[str], values: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Per document of `rests` its fields, and `sums` over its rarer terms: SQL expressions over the columns that values has beside term,
    and n, the term's frequency in the document. A term without values gives nulls there."""
    joined = rests.join(values, "term", "left")
    sums_of = [F.sum(F.expr(e)).alias(name) for name, e in sums.items()]
    return joined.groupBy("uid").agg(*[F.max(f"base.{name}").alias(name) for name in fields], *sums_of).drop("uid")


def summed_rests(docs: DataFrame, scan: Callable[[Iterator[tuple[int | None, bytes]]], Iterator[tuple[list, Counter]]], fields: dict[str, str], values: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Per row of docs: `fields` as computed where it was read, and `sums` over its rarer terms, of which values are known already."""
    return rests_with_values(document_rests(docs, scan, fields), fields, values, sums)
