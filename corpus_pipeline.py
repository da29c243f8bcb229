"""The pipeline: documents through five operators of crawlsift.llm, each stage written as Parquet and read again as the next one's input.

Stages keep whole texts and, but for the last, the columns of documents. ORACLE_SQL is None, as SQL expresses neither the classifier nor
the forest; tests/llm/test_pipeline.py compares every stage with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.llm import decontamination, mixing, near_dedup, quality, token_ids
from crawlsift.llm.shared import remainder_is, table, text_batches, tokenizer_path, written

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good (score 0.7 or more, as op1 predicts)."""
    text_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~remainder_is(F.col("doc_id"), 4, 2))
    model = quality.train_quality(docs, labels)
    return docs.where(quality.quality_score(model, F.col("text")) >= 0.7)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them: repeated, left out, or cut at a source's budget."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in files; per document what the files hold."""
    return token_ids.read_token_files(token_ids.write_token_files(docs, lambda: tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_stage), ("MinHash near-dedup", near_dedup_stage), ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage), ("token-ID binary output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
