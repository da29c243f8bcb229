"""The queries of the training-data operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, importance, language_model, languages, mixing, near_dedup, quality, token_counts, token_ids, toxicity, warc, whitening
from .shared import remainder_is, table, tokenizer_path


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder_is(F.col("doc_id"), 4, 2)
    model = quality.train_quality(docs, labels.where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), quality.quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_ids.write_token_files(table(spark, sf_dir, "documents"), lambda: tokenizer_path("word_bpe_49k.json"))
    return token_ids.read_token_files(files)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder_is(F.col("doc_id"), 7, 2)
    scored = language_model.score_texts(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder_is(F.col("doc_id"), 4, 2)
    model = toxicity.train_toxicity(docs, labels.where(~held))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.toxicity_score(model, F.col("text")).alias("score"), toxicity.language_threshold(model, F.col("lang")).alias("threshold"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), lambda: tokenizer_path("byte_bpe_50k.json"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), remainder_is(F.col("doc_id"), 3, 1)
    model = languages.train_languages(docs.where(~held))
    return languages.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_nearest, op3_token_ids, op4_warc, op5_language_model, op6_near_dedup, op7_mixing, op8_toxicity, op9_decontamination, op10_token_counts,
        op11_importance, op12_languages, op13_whitening)
}

ORACLES = {
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
        h AS (SELECT page_id, n, digest, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS head FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN head IS NOT NULL AND head IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN head IS DISTINCT FROM page_id THEN head END AS refers_to
        FROM h""",
    "op6_near_dedup": None,
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS w FROM s),
        r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw,
                     sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3 * source_size / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lv FROM w),
        l AS (SELECT max(CAST(lw AS DOUBLE) / lv) AS level FROM r WHERE CAST(lw AS DOUBLE) / lv * w <= 3 * source_size),
        t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce(level * w, 3 * source_size)) AS target FROM r, l),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken FROM e""",
    "op11_importance": r"""
        WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crcs),
        d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        w AS (SELECT row, unnest(words) AS word, 1 AS s, 0 AS t FROM d UNION ALL SELECT NULL, unnest(words), 0, 1 FROM b),
        c AS (SELECT word, sum(s) AS s, sum(t) AS t, list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM w GROUP BY word),
        h AS (SELECT word, s, t, xor(list_reduce(list_concat([4294967295], bytes), lambda a, x: xor(a // 256, crcs[xor(a % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM c, tab),
        g AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM h GROUP BY bucket),
        n AS (SELECT sum(s) AS s, sum(t) AS t FROM g),
        v AS (SELECT bucket, CAST(floor(1000 * ln(CAST(g.t + 1 AS DOUBLE) * (n.s + 10000) / (CAST(g.s + 1 AS DOUBLE) * (n.t + 10000)))) AS BIGINT) AS gain FROM g, n),
        f AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM w JOIN h USING (word) JOIN v USING (bucket) WHERE row IS NOT NULL GROUP BY row),
        r AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
                     CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN f USING (row)),
        x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM r),
        k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM x),
        a AS (SELECT count(*) * 10 // 100 AS drawn FROM x WHERE n_features >= 20)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
               CAST(CASE WHEN place <= drawn THEN place END AS BIGINT) AS rank FROM k, a""",
}
ORACLES = {name: sql for name, sql in ORACLES.items() if sql}
