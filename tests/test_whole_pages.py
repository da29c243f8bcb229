"""Long pages keep every item; captures that recur are told apart; JSON counts only as a whole."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from crawlsift.extract.facts import extract_headings, extract_hreflang, extract_images, extract_jsonld_types, extract_links, extract_page_facts
from crawlsift.extract.markup import parse_pages
from crawlsift.extract.signals import tracking_signals
from crawlsift.extract.structured import extract_jsonld
from crawlsift.extract.tables import extract_tables
from crawlsift.operators.corpus import latest_capture
from crawlsift.operators.detect import extract_tag_ids
from crawlsift.operators.events import annotate_entries, filter_entries
from crawlsift.operators.tables import expand_grid
from crawlsift.streaming import first_sightings


@pytest.fixture(scope="module")
def long_page(spark):
    html = (
        "<title>" + "t" * 5000 + "</title>" + "".join(f"<link rel=alternate hreflang=x{i} href=/l{i}>" for i in range(30))
        + "".join(f"<h2>h{i}</h2>" for i in range(150)) + "".join(f"<a href=/p{i}>{'x' * 300}</a>" for i in range(6000))
        + "".join(f"<img src=/i{i}.png>" for i in range(2100)) + "<table>" + "".join(f"<tr><td>{i}<td>v</tr>" for i in range(3000)) + "</table>"
        + "<table><tr><td>c</table>" * 59 + "".join(f'<script type="application/ld+json">{{"@type":"T{i}"}}</script>' for i in range(25))
        + "<script>" + "/* filler */ " * 16_000 + 'var id = "GTM-ABCD123";</script>')
    return parse_pages(spark.createDataFrame([(1, "https://example.com/", html)], "page_id long, url string, html string")).cache()


def test_flat_facts_are_whole(long_page):
    assert extract_links(long_page).agg(F.count("*"), F.min(F.length("text")), F.max("truncated")).first()[:] == (6000, 300, False)
    assert extract_headings(long_page).count() == 150
    assert extract_images(long_page).count() == 2100
    assert extract_hreflang(long_page).count() == 30
    assert extract_jsonld_types(long_page).count() == 25
    facts = extract_page_facts(long_page).selectExpr("length(title)", "size(headings)", "size(hreflang)", "size(structured_data)").first()
    assert facts[:] == (5000, 150, 30, 25)


def test_a_tag_id_behind_a_long_script_is_found(long_page):
    assert [r.value for r in extract_tag_ids(tracking_signals(long_page)).collect()] == ["GTM-ABCD123"]


def test_long_tables_are_whole_and_capped_ones_have_no_phantom_rows(long_page):
    tables, cells = extract_tables(long_page)
    assert tables.count() == 60 and cells.where("table_index = 0").count() == 6000
    grid = expand_grid(cells.where("table_index = 0"))
    assert grid.agg(F.countDistinct("row"), F.count("*")).first()[:] == (3000, 6000)
    _, few = extract_tables(long_page, row_cap=2)
    assert expand_grid(few.where("table_index = 0")).agg(F.countDistinct("row")).first()[0] == 2


def test_json_counts_only_as_a_whole(spark):
    texts = ['{"@type":"Person"} junk', '{"@type":"Person"}', ' [1, 2] ', '1] [2', '{"a":1}, {"b":2}', ""]
    html = "".join(f'<script type="application/ld+json">{t}</script>' for t in texts)
    page = parse_pages(spark.createDataFrame([(1, "https://example.com/", html)], "page_id long, url string, html string"))
    assert {r.raw: r.ok for r in extract_jsonld(page).collect() if r.raw} == {t.strip(): t in texts[1:3] for t in texts[:5]}


def test_captures_of_one_page_are_told_apart(spark):
    rows = [(1, "u", "a", 1), (1, "u", "b", 2), (1, "u", "b", 3), (2, "u", "b", 3), (2, "u", "b", 3), (1, "w", "a", 9), (1, "w", "c", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, captured_at long")
    newest = {r.url: (r.page_id, r.captured_at) for r in latest_capture(df).collect()}
    assert newest == {"u": (2, 3), "w": (1, 9)} and latest_capture(df).count() == 2
    first = sorted((r.url, r.html, r.page_id, r.captured_at) for r in first_sightings(df).collect())
    assert first == [("u", "a", 1, 1), ("u", "b", 1, 2), ("w", "a", 1, 9), ("w", "c", 1, 9)]


def test_search_tells_entries_of_repeated_captures_apart(spark):
    raws = [json.dumps({"event": "view", "id": x}) for x in ("needle", "straw")]
    df = spark.createDataFrame([(1, "dataLayer", 0, r) for r in raws], "page_id long, layer string, index int, raw string").selectExpr("*", "try_parse_json(raw) AS value")
    assert [r.raw for r in filter_entries(annotate_entries(df), "needle").collect()] == raws[:1]


def test_templates_are_inert_at_any_depth(spark):
    deep = "<template>" * 7 + "<img src=a>" + "</template>" * 7
    html = f"<img src=b>{deep}<img src=c></template><img src=d><TEMPLATE id=x><a href=/no>n</a><img src=e>"
    page = parse_pages(spark.createDataFrame([(1, "https://example.com/", html)], "page_id long, url string, html string"))
    assert [r.raw_src for r in extract_images(page).collect()] == ["b", "c", "d"]
    assert extract_links(page).count() == 0


def test_layer_documents_are_valid_json(spark):
    from crawlsift.sinks import layers_json

    entries = spark.createDataFrame([(1, 'my"dataLayer', 0, '{"a":1}', 2, False), (1, 'my"dataLayer', 1, '"x"', 2, False), (1, "dataLayer", 0, "[]", 1, False)],
                                    "page_id long, layer string, index int, raw string, total int, truncated boolean")
    pages = spark.createDataFrame([(1, 'https://e.com/?"q"')], "page_id long, url string")
    got = json.loads(layers_json(entries, pages).first().json)
    assert got["url"] == 'https://e.com/?"q"' and got["containers"] == []
    assert [(x["name"], x["total"], x["entries"]) for x in got["layers"]] == [("dataLayer", 1, [[]]), ('my"dataLayer', 2, [{"a": 1}, "x"])]
