"""Operators across pages: what no single page can tell.

Every aggregate here combines before it shuffles, so a site or value that holds a third of all pages costs its
partial results, not its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.sql import substitute
from crawlsift.functions.urls import host_of, normalise_url
from crawlsift.shared import written


def with_host(pages: DataFrame) -> DataFrame:
    return pages.selectExpr("*", f"{host_of('url')} AS host")


def duplicate_values(facts: DataFrame, column: str) -> DataFrame:
    """(value, pages, first_page): values that more than one page uses, ignoring case."""
    counted = facts.filter(f"coalesce({column}, '') <> ''").groupBy(F.expr(f"lower({column})").alias("value")).agg(
        F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))
    return counted.filter("pages > 1")


def _hosted(rows: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Rows with their page's host: carried from the detection, else joined by page."""
    return rows if "host" in rows.columns else rows.join(with_host(pages).select("page_id", "host"), "page_id")


def _by_group(rows: DataFrame, keys: list[str], weight: str, spread: str, share: int = 1000, parts: int = 64,
              attach: DataFrame | None = None) -> DataFrame:
    """Rows with what is known of their group: `groups` (its number of rows) and the columns of `attach`, a row per key or none.

    A group of more than one in `share` of all weight is dealt to `parts` parts by a hash of `spread`. There are at most `share` such
    groups, so their keys are broadcast; every other group is smaller than a task's fair part, and neither groups nor `attach`, as many as
    the pages, are ever broadcast. The rows are written first: counting and dealing read them, not the pages they come from.
    """
    rows = written(rows)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("groups"), F.sum(weight).alias("_weight"))
    total = groups.agg(F.sum("_weight").alias("_total"))  # one row
    sized = groups.join(F.broadcast(total)).withColumn("_hot", F.expr(f"_weight * {share} > _total")).drop("_weight", "_total")
    hot = sized.filter("_hot").select(*keys, "_hot")
    known = sized if attach is None else sized.join(attach.hint("merge"), keys, "left")
    dealt = known.withColumn("_part", F.expr(f"explode(if(_hot, sequence(0, {parts - 1}), array(0)))")).drop("_hot")
    placed = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_part", F.expr(f"if(_hot, CAST(pmod(xxhash64({spread}), {parts}) AS INT), 0)")).drop("_hot")
    return placed.join(dealt.hint("merge"), [*keys, "_part"]).drop("_part")


def shared_tag_ids(ids: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(label, value, host, pages, hosts): tag ids found on more than one host, one row per host.

    Rows stay long - a list of hosts per id could grow without bound. `ids` that carry `host` need no pages.
    """
    per_page = _hosted(ids, pages).groupBy("label", "value", "host", "page_id").agg(F.lit(1).alias("one"))
    per_host = per_page.groupBy("label", "value", "host").agg(F.count("one").alias("pages"))
    return _by_group(per_host, ["label", "value"], "pages", "host").withColumnRenamed("groups", "hosts").filter("hosts > 1")


def prevalence(detected: DataFrame, pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., id, pages, share): on how many pages, and what share of all, each tracker or technology occurs.

    `by` may be ["host"]; detections that carry it are not joined to their pages.
    """
    by = by or []
    total = with_host(pages).groupBy(*by).agg(F.count(F.lit(1)).alias("total")) if by else pages.agg(
        F.count(F.lit(1)).alias("total"))
    hits = _hosted(detected, pages) if by else detected
    counts = hits.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("pages"))
    # without `by` the total is one row
    joined = counts.join(total, by) if by else counts.join(F.broadcast(total))
    return joined.selectExpr(*by, "id", "pages", "pages / total AS share")


def category_cube(detected: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(category, host, n, level): detections by category and host with all subtotals.

    The cube is taken of counts per category and host, so its grouping sets multiply few rows.
    """
    counts = _hosted(detected, pages).groupBy("category", "host").agg(F.count(F.lit(1)).alias("c"))
    return counts.cube("category", "host").agg(F.sum("c").alias("n"), F.grouping_id().alias("level"))


def _page_key(url: str) -> str:
    return substitute(normalise_url(url), r"#.*\z")


def link_graph(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_page, href, n, target_page): links joined to the pages they lead to; NULL target when not captured.

    Links are counted per page and address first, addresses are matched to one page each, and the edges of an address that many pages
    name are dealt to many tasks.
    """
    edges = links.filter("href IS NOT NULL").groupBy(F.col("page_id").alias("source_page"), F.expr(
        substitute("href", r"#.*\z")).alias("href")).agg(F.count(F.lit(1)).alias("n"))
    targets = pages.groupBy(F.expr(_page_key("url")).alias("href")).agg(F.min("page_id").alias("target_page"))
    return _by_group(edges, ["href"], "n", "source_page", attach=targets).select("source_page", "href", "n", "target_page")


def dangling_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(href, n): internal addresses no captured page has."""
    wanted = links.filter("kind = 'internal'").groupBy(F.expr(substitute("href", r"#.*\z")).alias("href")).agg(
        F.count(F.lit(1)).alias("n"))
    known = pages.selectExpr(f"{_page_key('url')} AS href").distinct()
    return wanted.join(known, "href", "left_anti")


def latest_capture(captures: DataFrame, key: str = "url", ts: str = "captured_at") -> DataFrame:
    """The newest capture per page address: one row per key, also where a page id recurs or captures tie.

    Only (time, id, content hash) is aggregated; the html follows by a join on them. The later id, then the larger hash wins a tie.
    """
    order = [F.col(ts), F.col("page_id"), F.xxhash64("html") if "html" in captures.columns else F.lit(0)]
    named = [c.alias(f"_{i}") for i, c in enumerate(order)]
    newest = captures.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*named)).alias("_n"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    for i, c in enumerate(order):
        same = same & c.eqNullSafe(F.col(f"_n._{i}"))
    return captures.join(newest, same, "left_semi").dropDuplicates([key, ts, "page_id"])


def diff_captures(old: DataFrame, new: DataFrame, columns: list[str], key: str = "url") -> DataFrame:
    """(key, change, changed): pages added, removed or changed between two captures, with the columns that differ.

    Both sides hold one row per key (see `latest_capture`).
    """
    a = old.select(F.col(key), F.struct(*columns).alias("a"))
    b = new.select(F.col(key), F.struct(*columns).alias("b"))
    names = ", ".join(f"if(a.`{c}` <=> b.`{c}`, NULL, '{c}')" for c in columns)
    change = "CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END"
    return a.join(b, key, "full").filter("NOT (a <=> b)").selectExpr(
        key, f"{change} AS change", f"if(a IS NULL OR b IS NULL, CAST(array() AS ARRAY<STRING>), array_compact(array({names}))) "
                                    "AS changed")
