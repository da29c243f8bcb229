"""Rows as many as the pages are joined without a broadcast, whatever the size of the files they come from."""

import re

from crawlsift.extract.facts import extract_links, extract_page_facts
from crawlsift.extract.markup import parse_pages
from crawlsift.operators import corpus, findings, links, seo


def broadcast_keys(df):
    """Broadcast sides of joins, as planned, on page ids or addresses."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastHashJoin \[(?:page_id|href)#\d+L?(?:, _part#\d+)?\], [^\n]*", plan)


def test_a_row_per_page_is_never_broadcast(spark, page):
    pages = page("<title>t</title><a href='/a/b?q=1'>x</a>", "<p>none", "<a href=/x>")
    parsed = parse_pages(pages)
    counted = findings.summarize_findings(seo.audit_pages(extract_page_facts(parsed)), pages)
    found = links.annotate_links(extract_links(parsed))
    assert broadcast_keys(counted) == [] and broadcast_keys(links.summarize_links(found, pages)) == []
    assert {(r.page_id, r.total) for r in links.summarize_links(found, pages).collect()} == {(1, 1), (2, 0), (3, 1)}
    graph = corpus.link_graph(found, pages)
    assert all(", LeftOuter" in j and "_part" not in j for j in broadcast_keys(graph)) and len(broadcast_keys(graph)) <= 2  # the hot addresses alone
    assert "SortMergeJoin" in graph._jdf.queryExecution().executedPlan().toString()
    assert {(r.source_page, r.n, r.target_page) for r in graph.collect()} == {(1, 1, 1), (3, 1, None)}
