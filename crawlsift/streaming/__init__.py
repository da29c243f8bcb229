"""Streams of captures and events.

Page facts and verdicts are projections of one row, so `audit_stream` runs the batch operators unchanged in append
mode; operators that need windows over a page run inside `foreachBatch`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.extract.facts import extract_page_facts
from crawlsift.extract.markup import parse_pages
from crawlsift.operators.events import event_sessions, event_windows
from crawlsift.operators.seo import audit_pages
from crawlsift.sources import inspectable


def checkpoint_folder(spark: SparkSession, default: str | None = None) -> str | None:
    """The shared folder the cluster names, else `default`."""
    return spark.conf.get("spark.checkpoint.dir", default)


def audit_stream(captures: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Findings of arriving pages, in append mode."""
    return audit_pages(extract_page_facts(parse_pages(inspectable(captures))), carry)


def first_sightings(captures: DataFrame, late: str = "1 hour", ts: str = "captured_at") -> DataFrame:
    """Captures whose (url, content) was not seen within the watermark."""
    hashed = captures.withColumn("content_hash", F.xxhash64("html"))
    if not captures.isStreaming:
        keys = ["url", "content_hash"]
        first = hashed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct(F.col(ts).alias("t"), F.col("page_id").alias("p"))).alias("_f"))
        same = F.col(ts).eqNullSafe(F.col("_f.t")) & F.col("page_id").eqNullSafe(F.col("_f.p"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return hashed.join(first, same, "left_semi").dropDuplicates(keys)
    return hashed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["url", "content_hash"])


def split_late(events: DataFrame, ts: str = "ts", arrived: str = "arrived_at", allowed: str = "10 minutes") -> DataFrame:
    """Events with `late`: arrived more than `allowed` after they happened. For routing in `foreachBatch`."""
    return events.withColumn("late", F.col(arrived) > F.col(ts) + F.expr(f"INTERVAL {allowed}"))


def route_late(late_table: str, on_time: Callable[[DataFrame, int], None], ts: str = "ts", arrived: str = "arrived_at",
               allowed: str = "10 minutes") -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: late events go to the side table, the others to `on_time`.

    The side table is partitioned by batch, so a batch that runs again replaces its own rows.
    """
    def route(batch: DataFrame, epoch: int) -> None:
        marked = split_late(batch, ts, arrived, allowed).persist()
        marked.filter("late").drop("late").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(late_table)
        on_time(marked.filter("NOT coalesce(late, false)").drop("late"), epoch)
        marked.unpersist()

    return route


def run(stream: DataFrame, checkpoint: str | None, batch: Callable[[DataFrame, int], None], name: str = "stream"):
    """Start a query that hands every micro-batch to `batch` and stops when the input is read.

    Without `checkpoint`, its folder is `name` under spark.checkpoint.dir.
    """
    shared = checkpoint_folder(stream.sparkSession)
    if checkpoint is None and shared is None:
        raise ValueError("name a checkpoint folder or set spark.checkpoint.dir")
    folder = checkpoint or f"{shared.rstrip('/')}/{name}"
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", folder).trigger(availableNow=True).start()


def change_stream(captures: DataFrame, store: str, columns: list[str], on_change: Callable[[DataFrame, int], None], buckets: int = 256,
                  keep: str | None = None):
    """A `foreachBatch` function: compares each batch's newest captures with the table at `store`, then brings it up to date.

    The table holds one row per url, in buckets by a hash of the url. A batch reads the newest version of the buckets it touches and
    writes their next version under its own number, so a batch that runs again after a lost executor replaces only its own output.
    A batch starts when the one before it is committed, so it removes the versions that this one replaced: the table holds each bucket once,
    and for the buckets of the last batch once more. With `keep` (an interval such as '30 days'), urls whose newest capture is older than
    that, by the newest capture of the batch, leave the table; seen again, they are added anew. Each batch also brings one bucket in
    turn up to date that it need not touch, so that no bucket keeps expired urls for ever.
    """
    from crawlsift.operators.corpus import diff_captures, latest_capture

    state = ["url", "page_id", "captured_at", *columns]
    schema = captures.select(*state).withColumn("epoch", F.lit(0).cast("long")).withColumn("bucket", F.lit(0)).schema

    def compare(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = latest_capture(batch).select(*state, F.expr(f"CAST(pmod(xxhash64(url), {buckets}) AS INT) AS bucket")).persist()
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("epoch", "bucket").parquet(store)
        _drop_replaced(spark, store, epoch)
        stored = spark.read.schema(schema).parquet(store).filter(F.col("epoch") < epoch)
        touched = new.select("bucket").union(spark.range(1).select(F.lit(epoch % buckets).alias("bucket"))).distinct()
        newest = stored.join(F.broadcast(touched), "bucket", "left_semi").groupBy("bucket").agg(F.max("epoch").alias("epoch"))
        known = stored.join(F.broadcast(newest), ["bucket", "epoch"])  # at most a row per bucket
        if keep is not None:
            ends = new.agg((F.max("captured_at") - F.expr(f"INTERVAL {keep}")).alias("_oldest"))  # one row
            known = known.join(F.broadcast(ends)).filter("_oldest IS NULL OR captured_at >= _oldest").drop("_oldest")
        before = known.join(new.select("url"), "url", "left_semi")
        after = latest_capture(before.select(*state).unionByName(new.select(*state)))
        on_change(diff_captures(before.select("url", *columns), after.select("url", *columns), columns), epoch)
        merged = known.join(new.select("url"), "url", "left_anti").select(*state).unionByName(after)
        # an emptied bucket leaves a row without url, so that its older version is replaced, too
        emptied = newest.select("bucket").join(merged.selectExpr(f"CAST(pmod(xxhash64(url), {buckets}) AS INT) AS bucket").distinct(), "bucket", "left_anti")
        empty = emptied.select(*[F.lit(None).cast(schema[c].dataType).alias(c) for c in state], "bucket")
        rows = merged.filter("url IS NOT NULL").withColumn("bucket", F.expr(f"CAST(pmod(xxhash64(url), {buckets}) AS INT)")).unionByName(empty)
        rows.withColumn("epoch", F.lit(epoch).cast("long")).repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("epoch", "bucket").parquet(store)
        new.unpersist()

    return compare


def _drop_replaced(spark: SparkSession, store: str, epoch: int) -> None:
    """Removes the versions of buckets for which there is a newer one of a batch before `epoch`. The driver lists directories only: some for each
    bucket, whatever the number of urls or batches."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    versions: dict[str, list[tuple[int, object]]] = {}
    batches = files.globStatus(hadoop.Path(f"{store}/epoch=*/bucket=*"))
    for status in batches or []:
        path = status.getPath()
        number = int(path.getParent().getName().split("=")[1])
        if number < epoch:
            versions.setdefault(path.getName(), []).append((number, path))
    for found in versions.values():
        for _, path in sorted(found, key=lambda v: v[0])[:-1]:
            files.delete(path, True)
    for status in files.globStatus(hadoop.Path(f"{store}/epoch=*")) or []:
        if not files.listStatus(status.getPath()):
            files.delete(status.getPath(), False)


__all__ = ["audit_stream", "change_stream", "checkpoint_folder", "event_sessions", "event_windows", "first_sightings",
           "route_late", "run", "split_late"]
