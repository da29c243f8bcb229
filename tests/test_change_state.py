"""The state of change detection over several batches: its size, expired urls, batches that run again."""

import os

from pyspark.sql import functions as F

from crawlsift.streaming import change_stream, run

SCHEMA = "page_id long, url string, title string, captured_at timestamp"


def versions(store):
    return sorted((e, b) for e in os.listdir(store) if e.startswith("epoch=") for b in os.listdir(f"{store}/{e}") if b.startswith("bucket="))


def rows_of(spark, store):
    return spark.read.parquet(store).where("url IS NOT NULL")


def test_state_stays_flat_and_urls_expire(spark, tmp_path):
    seen, sizes, store = [], [], str(tmp_path / "store")

    def batch(rows):
        frame = spark.createDataFrame(rows, "page_id long, url string, title string, t long").selectExpr("page_id", "url", "title", "timestamp_seconds(t) AS captured_at")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        on = change_stream(stream, store, ["title"], lambda df, e: seen.append(sorted(map(tuple, df.select("url", "change").collect()))), buckets=4, keep="1 hour")
        run(stream, str(tmp_path / "cp"), on).awaitTermination(120)
        sizes.append(len(versions(store)))

    urls = [f"u{i}" for i in range(40)]
    for n in range(5):  # every batch touches every bucket
        batch([(i, u, f"t{n}", 600 * n) for i, u in enumerate(urls)])
    assert seen == [[(u, "added") for u in sorted(urls)]] + [[(u, "changed") for u in sorted(urls)]] * 4
    assert max(sizes) <= 8  # four buckets in the version that counts, and the one before it until the next batch
    batch([(1, "u1", "t9", 10_000)])  # 2.5 hours later: the others expire where their bucket is touched, and in turn
    for n in range(5):
        batch([(1, "u1", "t9", 10_001 + n)])
    assert seen[5:] == [[("u1", "added")]] + [[]] * 5  # it had expired itself
    batch([(2, "u2", "t4", 10_100), (1, "u1", "t9", 10_100)])
    assert seen[-1] == [("u2", "added")] and max(sizes) <= 8
    newest = rows_of(spark, store).where(F.col("url").isin("u1", "u2"))
    assert {r.url for r in newest.collect()} == {"u1", "u2"} and rows_of(spark, store).where("url NOT IN ('u1', 'u2')").count() == 0


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    store, seen = str(tmp_path / "store"), []
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, title string, t long").selectExpr("page_id", "url", "title", "timestamp_seconds(t) AS captured_at")
    first, second = frame([(1, "a", "x", 1), (2, "b", "x", 1)]), frame([(1, "a", "y", 2), (3, "c", "x", 2)])
    on = change_stream(first, store, ["title"], lambda df, e: seen.append(sorted(map(tuple, df.select("url", "change").collect()))), buckets=2)
    for epoch, batch in ((0, first), (1, second), (1, second), (2, second)):
        on(batch, epoch)
    assert seen == [[("a", "added"), ("b", "added")], [("a", "changed"), ("c", "added")], [("a", "changed"), ("c", "added")], []]
    newest = rows_of(spark, store).groupBy("url").agg(F.max_by("title", "epoch").alias("t"))
    assert {r.url: r.t for r in newest.collect()} == {"a": "y", "b": "x", "c": "x"}
    on(frame([]), 3)
    assert seen[-1] == []
