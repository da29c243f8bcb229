"""Streams give the batch results; queues of static pages are read as a browser fills them."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlsift.extract.events import extract_layers
from crawlsift.extract.markup import parse_pages
from crawlsift.extract.tables import extract_tables
from crawlsift.operators.events import event_sessions, event_windows
from crawlsift.streaming import first_sightings, route_late, run

EVENTS = "user_id long, event_type string, ts timestamp, arrived_at timestamp"


def _stream(spark, df, folder):
    df.write.parquet(str(folder / "in"))
    return spark.readStream.schema(df.schema).parquet(str(folder / "in"))


def _events(spark):
    seconds = [(1, "view", 0, 5), (1, "view", 600, 601), (1, "buy", 1700, 9999), (1, "view", 3600, 3601), (2, "view", 10, 10), (2, None, 7200, 7201)]
    return spark.createDataFrame(seconds, "user_id long, event_type string, t long, a long").selectExpr(
        "user_id", "event_type", "timestamp_seconds(t) AS ts", "timestamp_seconds(a) AS arrived_at")


def _memory(df, name, folder, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(
        availableNow=True).start().awaitTermination(120)
    return sorted(map(tuple, df.sparkSession.table(name).collect()), key=repr)


def test_windows_sessions_and_sightings_on_a_stream(spark, tmp_path):
    events = _events(spark)
    stream = _stream(spark, events, tmp_path)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert _memory(event_windows(stream, "1 hour", "30 minutes"), "wins", tmp_path, "complete") == rows(event_windows(events, "1 hour", "30 minutes"))
    assert _memory(event_sessions(stream), "sess", tmp_path, "complete") == rows(event_sessions(events))
    captures = spark.createDataFrame([(1, "u", "a", 1), (2, "u", "a", 2), (3, "u", "b", 3), (4, "v", "a", 4)], "page_id long, url string, html string, t long")
    captures = captures.selectExpr("page_id", "url", "html", "timestamp_seconds(t) AS captured_at")
    (tmp_path / "c").mkdir()
    got = _memory(first_sightings(_stream(spark, captures.coalesce(1), tmp_path / "c")).select("url", "html"), "first", tmp_path, "append")
    assert got == rows(first_sightings(captures).select("url", "html"))


def test_late_events_go_to_the_side_table(spark, tmp_path):
    seen = []
    route = route_late(str(tmp_path / "late"), lambda df, epoch: seen.append(df.count()))
    run(_stream(spark, _events(spark), tmp_path), str(tmp_path / "cp"), route).awaitTermination(120)
    assert sum(seen) == 5 and [r.event_type for r in spark.read.parquet(str(tmp_path / "late")).collect()] == ["buy"]


def test_static_queues(page):
    scripts = """
      window.dataLayer = window.dataLayer || [{page: 'a"b', 'x': 1,}, 'it\\'s'];
      dataLayer.push({event: "q", d: {e: [{f: {g: {h: 1}}}]}}, /* note */ {b: undefined});
      // dataLayer.push({"no": 1})
      var s = "dataLayer.push({'no': 2})";
      function gtag(){dataLayer.push(arguments);}
      gtag('js', new Date()); gtag('config', 'G-1', {send: !1});
      other.dataLayer.push({"no": 3}); dataLayer.push(variable); dataLayer.push({"v": now()});"""
    rows = extract_layers(parse_pages(page(f"<script>{scripts}</script>", "<script>dataLayer.push(</script>", "", None))).orderBy("index").collect()
    assert [r.raw for r in rows] == ['{"page":"a\\"b","x":1}', '"it\'s"', '{"event":"q","d":{"e":[{"f":{"g":{"h":1}}}]}}', '{"b":null}', '["config","G-1",{"send":false}]']
    assert {(r.layer, r.total, r.evidence_kind) for r in rows} == {("dataLayer", 5, "static")}


def test_cells_without_rows_open_one(page):
    html = "<table><td>a<td>b<tr><td>c</tr><td>d<table><th>n</table></table><table><tbody><td>x</tbody><tbody><td>y</table>"
    _, cells = extract_tables(parse_pages(page(html)))
    got = sorted((r.table_index, r.row, r.cell, r.text, r.row_count) for r in cells.collect())
    assert got == [(0, 0, 0, "a", 3), (0, 0, 1, "b", 3), (0, 1, 0, "c", 3), (0, 2, 0, "dn", 3), (1, 0, 0, "n", 1), (2, 0, 0, "x", 2), (2, 1, 0, "y", 2)]
