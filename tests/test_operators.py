"""Verdicts, joins across pages, sinks and streams."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlsift.extract.facts import extract_page_facts
from crawlsift.extract.markup import parse_pages
from crawlsift.extract.store import extract_store
from crawlsift.operators import corpus, events, images, seo, store
from crawlsift.operators.findings import by_severity, summarize_findings
from crawlsift.registry.schema_types import REQUIREMENTS
from crawlsift.registry.technologies import STACK_CATEGORIES, TECHNOLOGIES
from crawlsift.registry.trackers import TRACKER_CATEGORIES, TRACKERS
from crawlsift.sinks import audit_json, audit_markdown, csv_documents, write_csv
from crawlsift.sources import inspectable
from crawlsift.streaming import audit_stream, change_stream, run

DATA = "/root/testdata/sf0.001"


def test_registries_are_consistent():
    for rows, categories in ((TRACKERS, TRACKER_CATEGORIES), (TECHNOLOGIES, STACK_CATEGORIES)):
        assert len({r["id"] for r in rows}) == len(rows)
        assert {r["category"] for r in rows} <= {c for c, _ in categories}
        assert all(any(r.get(k) for k in ("globals", "hosts", "cookies", "markers", "paths", "generator")) for r in rows)
    assert (len(TRACKERS), len(TECHNOLOGIES), len(REQUIREMENTS)) == (42, 51, 21)


@pytest.mark.parametrize("n,status", [(0, "error"), (29, "warning"), (30, "ok"), (60, "ok"), (61, "warning")])
def test_title_bounds_are_inclusive(page, n, status):
    facts = extract_page_facts(parse_pages(page(f"<title>{'x' * n}</title>")))
    assert seo.audit_pages(facts).filter("id = 'title'").first().status == status


def test_audit_of_a_bad_page(page):
    df = page('<title>a</title><title>b</title><link rel=canonical href="ftp://x/"><meta property="og:image" content="data:x"><h2>x</h2><h4>y</h4>'
              '<img><a href="/e"></a><script type="application/ld+json">{</script>', url="http://example.com/")
    findings = seo.audit_pages(extract_page_facts(parse_pages(df)))
    got = {r.id: (r.status, r.message) for r in findings.collect()}
    assert got["title"] == ("error", "2 <title> tags found. Keep exactly one.")
    assert got["canonical"] == ("error", "Not a valid absolute http(s) URL.")
    assert got["og:image"][0] == "error" and got["https"] == ("warning", "Served over http.")
    assert got["outline"][1] == "Jumps from H2 to H4. Do not skip levels." and got["h1"][0] == "error"
    assert got["alt"][1] == "1 of 1 images have no alt attribute." and got["link-text"][1] == "1 links have no discernible text."
    assert got["jsonld"][0] == "error"
    summary = summarize_findings(findings, df).first()
    assert summary.total == findings.count() and summary.status == "error"
    assert [r.status for r in by_severity(findings).collect()][0] == "error"


def test_image_rules(spark):
    rows = [("x" * 125, "ok"), ("x" * 126, "warning"), ("Photo", "warning"), ("an image of a cat", "warning"), ("", "info"), (None, "error"), ("a b", "warning")]
    df = spark.createDataFrame([(i, a, w) for i, (a, w) in enumerate(rows)], "page_id int, alt string, want string").selectExpr(
        "*", "'/x/a-b.png' src", "'' role", "false aria_hidden", "'' aria_label", "false in_link", "1 natural_width", "1 natural_height")
    assert all(r.status == r.want for r in images.annotate_images(df).collect())


def test_unknown_stock_is_not_out_of_stock(page):
    island = '<script type="application/json" data-product-json>{"id":1,"vendor":"v","variants":[{"id":1,"sku":"s"%s}]}</script>'
    df = page(island % "", island % ',"available":false', '<script type="application/ld+json">{"@type":"ProductGroup","name":"g","hasVariant":[{"url":"u"},{"sku":"k","offers":{"price":"105.00","availability":"InStock"}}]}</script>')
    stores = extract_store(parse_pages(df))
    found = {(r.page_id, r.id) for r in store.audit_store(stores).collect()}
    assert (1, "out-of-stock") not in found and (2, "out-of-stock") in found
    third = stores.filter("page_id = 3").first()
    assert [(v.sku, v.price, v.available) for v in third.variants] == [("k", 10500, True)] and third.product.image_count == 0


def test_sessions_do_not_depend_on_minute_grouping(spark):
    seconds = [0, 10, 1799, 1810, 3610, 3611, 5500, 7300, 7301]
    df = spark.createDataFrame([(1, s) for s in seconds], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    want, last = [], None
    for s in seconds:
        if last is None or s - last >= 1800:
            want.append([s, s, 0])
        want[-1][1], want[-1][2], last = s, want[-1][2] + 1, s
    got = events.event_sessions(df).selectExpr("unix_seconds(session_start)", "unix_seconds(session_end)", "n").collect()
    assert sorted(map(list, got)) == want


def test_hot_keys_keep_all_rows(spark):
    """A third of all pages share one address: results stay whole."""
    df = spark.range(300).selectExpr("id AS page_id", "if(id % 3 = 0, 'https://hot.com/', concat('https://h', id, '.com/')) AS url",
                                     "timestamp_seconds(id) AS captured_at", "if(id % 3 = 0, 'Same', concat('t', id)) AS title")
    assert corpus.latest_capture(df).count() == 201
    assert corpus.duplicate_values(df, "title").collect()[0][1:] == (100, 0)


def test_inspectable_keeps_lookalikes(spark):
    urls = ["https://chrome.google.com/x", "https://chrome.google.com.evil.test/", "chrome://x", "file:///a", None, "", "nope", "https://ok.com/", "data:text/html,x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    assert [r.url for r in inspectable(df).collect()] == ["https://chrome.google.com.evil.test/", "https://ok.com/"]


def test_csv_round_trip(spark, tmp_path):
    import csv
    import io

    values = ['a,"b"', "line\nbreak", " edge ", "=1+1", "", "é"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "page_id int, pos int, v string")
    text = csv_documents(df, ["pos", "v"], "pos").first().document
    assert text.startswith("\ufeff")
    back = list(csv.reader(io.StringIO(text.lstrip("\ufeff"), newline="")))
    assert [r[1] for r in back[1:]] == ['a,"b"', "line\nbreak", " edge ", "'=1+1", "", "é"]
    write_csv(df.orderBy(F.desc("pos")).repartition(3), str(tmp_path / "out"), ["pos", "v"])
    names = [*sorted((tmp_path / "out" / "header").glob("part-*")), *sorted((tmp_path / "out" / "rows").glob("part-*"))]
    whole = b"".join(p.read_bytes() for p in names).decode("utf-8")
    assert whole.removesuffix("\r\n") == text


def test_schema_and_layer_documents(page):
    import json

    from crawlsift.extract.events import extract_layers
    from crawlsift.extract.structured import extract_jsonld, extract_microdata
    from crawlsift.operators.schema import audit_schema
    from crawlsift.sinks import layers_json, schema_json, schema_report

    df = page('<script type="application/ld+json">{"@type":"Person","name":"n"}</script><script type="application/ld+json">{</script>'
              '<script>dataLayer.push({"event":"a"});dataLayer.push({"b":1})</script>')
    p = parse_pages(df)
    blocks = extract_jsonld(p)
    entities, findings, summary = audit_schema(blocks, extract_microdata(p), df)
    doc = json.loads(schema_json(entities, findings, blocks, summary, df).first().json)
    assert doc["summary"]["parse_errors"] == 1 and doc["entities"][0]["warnings"] == 2 and doc["parseErrors"][0]["index"] == 1
    assert "## Person (json-ld)\n- [OK] name - Present." in schema_report(findings, df).first().report
    layers = json.loads(layers_json(extract_layers(p), df).first().json)["layers"]
    assert layers == [{"name": "dataLayer", "total": 2, "truncated": False, "entries": [{"event": "a"}, {"b": 1}]}]


def test_reports(page):
    df = page("<title>x</title>")
    facts = extract_page_facts(parse_pages(df))
    findings = seo.audit_pages(facts)
    report = audit_markdown(facts, findings).first().report
    assert report.startswith("# crawlsift report") and "- **[FAIL] Language** - No lang" in report and report.index("## SEO essentials") < report.index("## Structure")
    assert '"tool":"crawlsift"' in audit_json(facts, findings).first().json


def test_stream_gives_the_same_findings_as_batch(spark, page, tmp_path):
    df = page("<title>x</title><h1>a</h1>", "<p>b</p>").withColumn("captured_at", F.timestamp_seconds("page_id"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = audit_stream(stream).writeStream.format("memory").queryName("audit_out").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(r.page_id, r.id, r.message) for r in seo.audit_pages(extract_page_facts(parse_pages(df))).collect()}
    assert {(r.page_id, r.id, r.message) for r in spark.table("audit_out").collect()} == want


def test_changes_between_captures(spark, tmp_path):
    def write(rows, n):
        spark.createDataFrame(rows, "page_id long, url string, title string, captured_at long").selectExpr(
            "page_id", "url", "title", "timestamp_seconds(captured_at) AS captured_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("page_id long, url string, title string, captured_at timestamp").parquet(str(tmp_path / "in"))
        run(stream, str(tmp_path / "cp"), change_stream(stream, str(tmp_path / "store"), ["title"], lambda df, e: seen.append(
            [tuple(r) for r in df.orderBy("url").collect()]))).awaitTermination(120)

    seen = []
    write([(1, "u", "a", 1), (2, "v", "a", 1)], 1)
    write([(3, "u", "b", 2), (4, "v", "a", 2)], 2)
    write([(1, "u", "c", 3), (1, "u", "b", 3), (9, "v", "old", 0), (5, "w", "a", 3)], 3)  # a page id that recurs, a tie, a late capture
    assert seen[:2] == [[("u", "added", []), ("v", "added", [])], [("u", "changed", ["title"])]]
    assert [r[:2] for r in seen[2] if r[0] != "u"] == [("w", "added")]
    write([(1, "w", "b", 4)], 4)
    assert seen[3] == [("w", "changed", ["title"])]


def test_every_query_is_registered_with_a_builder(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 60
    for name in ("tokens", "page_titles", "page_links", "event_counts"):
        assert queries[name](spark, DATA).count() > 0
    assert entry.entry(spark).columns == ["host", "id", "status", "pages"]
