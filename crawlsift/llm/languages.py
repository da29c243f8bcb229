"""Language identification by multilingual mixture inference.

A text is a mixture of languages: each of its letter n-grams (four bytes, hashed to `BUCKETS`) comes from one of them.
Expectation-maximisation estimates the languages' shares from the n-grams' likelihoods, and languages join the text's set, largest share
first, while the log-likelihood gains more than its penalty. The n-gram tables are counted by Spark over a bounded sample of each
language's texts (whole ones); texts are scored where they are read.

Cases: a null text, or one without letters, is `und` with score 0 and no languages; so is every text where nothing could be learned;
rows with a null or blank language, null id or no letters are not learned from; ties go to the language first in code point order; rows
that repeat an id are learned from and scored each; an empty table gives no rows; other columns are not read. A very long text is
counted in pieces of about `PIECE` bytes, cut beside a letter run, so its memory is bounded by the pieces and its n-gram counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cuts

#: N-gram buckets (2 ** BITS); bytes of text worked on at a time.
BITS, PIECE = 15, 2 << 20
BUCKETS = 1 << BITS
_CUT = re.compile(rb"[\t-\r !-/:-@]")
#: What the n-grams of one text tell together: neighbours overlap, so each counts for a part.
INDEPENDENT = 0.25


def ngram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, n) of the n-grams of lower-case letter runs, each with a space on both sides; none for a text without letters."""
    runs = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.string())), r"[^\p{L}\p{M}]+", " "), " ")
    runs = pc.if_else(pc.match_substring_regex(runs, r"\p{L}"), runs, "")
    runs = pc.binary_join_element_wise("  ", runs, " ", "")  # one letter makes one n-gram
    sizes = pc.binary_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs), "")[0].as_buffer(), np.uint8).astype(np.uint32)
    text_of = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
    if len(joined) < 4:
        return (np.empty(0, np.int64),) * 3
    grams = joined[:-3] | joined[1:-2] << 8 | joined[2:-1] << 16 | joined[3:] << 24
    whole = text_of[:-3] == text_of[3:]
    keys, n = np.unique((text_of[:-3].astype(np.int64) << BITS | (grams * np.uint32(2654435761) >> np.uint32(32 - BITS)))[whole], return_counts=True)
    return keys >> BITS, keys & (BUCKETS - 1), n


def counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their counts for each text in turn; both empty for a text without letters."""
    texts = texts.cast(pa.large_string()).fill_null("")
    sizes, start = pc.binary_length(texts).to_numpy(zero_copy_only=False), 0
    while start < len(texts):
        if sizes[start] > PIECE:
            total, body = np.zeros(BUCKETS, np.int64), memoryview(texts[start].as_buffer())
            for a, b in cuts(body, PIECE, _CUT):
                _, bucket, n = ngram_counts(pa.array([str(body[a:b], "utf-8")], pa.large_string()))
                total[bucket] += n
            at = np.flatnonzero(total)
            yield at, total[at]
            start += 1
            continue
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), PIECE, "right")))
        text_of, bucket, n = ngram_counts(texts.slice(start, stop - start))
        ends = np.searchsorted(text_of, np.arange(stop - start + 1))
        for a, b in zip(ends, ends[1:]):
            yield bucket[a:b], n[a:b]
        start = stop


@dataclass(frozen=True)
class LanguageModel:
    """The learned languages and, for each n-gram bucket, its probability in each of them."""

    languages: list[str]
    likelihoods: np.ndarray

    def shares(self, bucket: np.ndarray, n: np.ndarray, penalty: float = 12.0, candidates: int = 12) -> tuple[dict[int, float], float]:
        """The text's set of languages with their shares, and how sure the first one is among single languages.

        penalty is what each further language costs, beside half the log of the text's n-grams; only the `candidates` likeliest single
        languages enter a text's mixture.
        """
        p, c = self.likelihoods[bucket], n.astype(np.float32)
        single = c @ np.log(p)
        order = np.argsort(-single, kind="stable")[:candidates]
        odds = np.exp(np.clip((single[order] - single[order[0]]) * INDEPENDENT, -60, 0))
        if len(order) == 1:
            return {int(order[0]): 1.0}, 1.0
        p, size = np.ascontiguousarray(p[:, order]), float(c.sum())
        cost = penalty + np.log(max(2.0, size * INDEPENDENT)) / 2
        share, best = expectation_maximisation(p, c)
        alone = float(single[order[0]])
        if (best - alone) * INDEPENDENT <= cost:  # no set gains more than all languages together
            return {int(order[0]): 1.0}, float(1 / odds.sum())
        rising = np.argsort(-share, kind="stable")
        chosen, held = [int(rising[0])], float(single[order[rising[0]]])
        mixed = np.ones(1)
        for other in rising[1:]:
            weights, reached = expectation_maximisation(np.ascontiguousarray(p[:, [*chosen, other]]), c)
            if (reached - held) * INDEPENDENT <= cost:
                break
            chosen, held, mixed = [*chosen, int(other)], reached, weights
        if len(chosen) == 1:
            chosen = [0]  # the likeliest single language
        return {int(order[k]): float(w) for k, w in zip(chosen, mixed)}, float(odds[chosen].sum() / odds.sum()) if len(chosen) == 1 else 1.0


def expectation_maximisation(p: np.ndarray, c: np.ndarray, rounds: int = 40, tolerance: float = 2e-3) -> tuple[np.ndarray, float]:
    """Shares of the columns of p that make the counts c likeliest, and that log-likelihood."""
    share, total = np.full(p.shape[1], 1 / p.shape[1], np.float32), c.sum()
    for _ in range(rounds):
        new = share * ((c / (p @ share)) @ p) / total
        moved = abs(new - share).max()
        share = new
        if moved < tolerance:
            break
    return share / share.sum(), float(c @ np.log(p @ share))


def train_languages(docs: DataFrame, sample_rows: int = 5000, max_languages: int = 256, smoothing: float = 0.02) -> LanguageModel:
    """Learns from text and lang of the rows given: about `sample_rows` whole texts of each language, chosen by a hash of the id.

    `max_languages` bounds the table (the most frequent languages of the labels are learned). smoothing is the weight of the n-gram
    frequencies of all languages together in each language's own.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("id").isNotNull() & (F.trim("lang") != "") & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    names = sorted(sizes, key=str.encode)
    parts = {name: min(1 << 20, (1 << 20) * sample_rows // sizes[name]) for name in names}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, (bucket, n) in zip(batch["lang"].to_pylist(), counted(batch["text"])):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] += n
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "bucket", "n"])

    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    wanted = docs.sparkSession.createDataFrame(list(parts.items()), "lang string, part int")
    sample = rows.join(F.broadcast(wanted), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("part")).select("lang", "text")
    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BUCKETS, len(names)))
    table[counts["bucket"].to_numpy(), [names.index(v) for v in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    learned = np.flatnonzero(table.sum(0))
    if not len(learned):
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    table = table[:, learned]
    shares = table / table.sum(0)
    common = (shares.mean(1) * BUCKETS + 0.01) / (BUCKETS * 1.01)
    return LanguageModel([names[i] for i in learned], ((1 - smoothing) * shares + smoothing * common[:, None]).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, languages (the text's set with shares, largest first) of each row of docs."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for batch in batches:
            best, scores, sets = [], [], []
            for bucket, n in counted(batch["text"]):
                if not len(bucket) or not model.languages:
                    best.append("und"), scores.append(0.0), sets.append([])
                    continue
                found, sure = model.shares(bucket, n)
                ranked = sorted(found.items(), key=lambda at: (-at[1], at[0]))
                best.append(model.languages[ranked[0][0]])
                scores.append(min(1.0, max(0.0, ranked[0][1] * sure)))
                sets.append([{"lang": model.languages[i], "share": share} for i, share in ranked])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], names=["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")

