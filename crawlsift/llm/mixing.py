"""Mixing sources to target weights, in Spark SQL alone.

Documents get hash-random keys; equal ranges of the key cut each source into ranges of alike size, which are sorted. Running sums over
the ranges and within each give every document the words before it in its source, and the source is cut exactly at its budget: whole
epochs first, then the documents of a further epoch until the words left over are used up (the last one in part).

Cases: a null text has no words; sources go by code point with null last; a source without words has target 0; rows that repeat an id
follow each other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Documents of a source that a range holds about.
RANGE_ROWS = 2000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, times: int = 3) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3 in turn share all words; targets stop at `times` their source's size.

    The excess of sources at their limit goes to the others by weight until none is above: all targets are least(limit, weight * level),
    with the one level at which they sum up to all words. One row per source.
    """
    order = Window.orderBy(F.expr("source IS NULL"), F.expr("cast(source AS binary)"))
    rows = sizes.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1)
    limit = F.lit(times) * F.col("source_size")
    rising = Window.orderBy(limit / F.col("w"), F.expr("source IS NULL"), F.expr("cast(source AS binary)")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.select(
        "*", (F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(rising), F.lit(0))).alias("left_words"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(rising), F.lit(0))).alias("left_weight"))
    level = F.col("left_words") / F.col("left_weight")
    rows = rows.withColumn("level", F.when(level * F.col("w") <= limit, level))
    # The first source below its limit has the least level that holds for all after it.
    rows = rows.withColumn("level", F.max("level").over(whole))
    return rows.select("source", "source_size", F.least(limit.cast("double"), F.coalesce(F.col("level") * F.col("w"), limit.cast("double"))).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    """Rows of docs as the mix sees them: doc_id, source, size, a tie-breaker of rows that repeat an id, and the whole row."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size")]
    return docs.select(*own, F.xxhash64("text").alias("tie"), F.struct(*docs.columns).alias("row"))


def mix(docs: DataFrame, times: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    return _taken(_sized(docs).drop("row"), times).select("doc_id", "size", "source_size", "target", "taken")


def _taken(rows: DataFrame, times: int) -> DataFrame:
    """Sized rows with source_size, target and taken."""
    rows = written(rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    bits = F.least(F.lit(16), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / RANGE_ROWS))))
    targets = source_targets(per_source.select("source", "source_size"), times).join(per_source.select(F.col("source").alias("s"), bits.cast("int").alias("bits")), F.expr("source <=> s")).drop("s")
    targets = written(targets)
    small = targets.withColumnRenamed("source", "s")
    dealt = rows.join(small, F.expr("source <=> s")).drop("s").select("*", F.expr("shiftright(cast(conv(substring(key, 1, 4), 16, 10) AS int), 16 - bits)").alias("range"))
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, F.expr("source <=> s AND range = r")).withColumn("start", F.col("range_start") + F.col("inside"))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.withColumn("taken", (epochs * F.col("size") + part).cast("long"))


def mixed_documents(docs: DataFrame, times: int = 3) -> DataFrame:
    """docs as the mix takes them: a row for each whole repetition, and one with the first words of a document that the cut divides.

    Every row is taken for itself, also where rows repeat an id; the columns of docs travel as one, whatever their names.
    """
    rows = _taken(_sized(docs), times).where("taken > 0").select("row", "size", "taken")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    ends = F.regexp_extract_all("row.text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    text = F.when(words < F.col("size"), F.array_join(F.slice(ends, F.lit(1), words.cast("int")), "")).otherwise(F.col("row.text"))
    changed = {"text": text} | ({"n_chars": F.when(words < F.col("size"), F.length(text)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
