"""Link operators: kind, label, filters, counts, export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.sql import case, let, lit, matches
from crawlsift.functions.text import WS, contains_ci, either, js_trim
from crawlsift.functions.urls import web_origin

# Link kinds, and the scopes a list can be narrowed to.
KINDS = ["internal", "external", "anchor", "mailto", "tel", "script", "other"]
SCOPES = ["all", "internal", "external", "anchor", "nofollow", "untitled"]
ADDRESS = "coalesce(nullif(href, ''), raw, '')"


def classify_link(raw: str, href: str, origin: str) -> str:
    """Kind of one link. Origins are compared as parsed, so a lookalike prefix is external."""
    web = let(web_origin(href), lambda own: case(
        (f"{own} IS NULL", "'other'"), (f"{own} = {web_origin(origin)}", "'internal'"), otherwise="'external'"))
    return let(js_trim(raw), lambda r: case(
        (f"startswith({r}, '#')", "'anchor'"),
        (matches(r, "(?i)^mailto:"), "'mailto'"),
        (matches(r, "(?i)^tel:"), "'tel'"),
        (matches(r, "(?i)^javascript:"), "'script'"),
        (f"coalesce({href}, '') = '' OR NOT {matches(href, '(?i)^https?:')}", "'other'"),
        otherwise=web))


def is_nofollow(rel: str) -> str:
    """nofollow as a whole token of rel."""
    return let(f"lower(coalesce({rel}, ''))", lambda r: f"contains({r}, 'nofollow') AND array_contains(split({r}, {lit(WS + '+')}), 'nofollow')")


def link_label(text: str, aria_label: str, image_alt: str, title: str) -> str:
    return js_trim(either(text, aria_label, image_alt, title))


def annotate_links(links: DataFrame) -> DataFrame:
    return links.selectExpr(
        "*", f"{classify_link('raw', 'href', 'origin')} AS kind",
        f"{link_label('text', 'aria_label', 'image_alt', 'title')} AS label", f"{is_nofollow('rel')} AS nofollow")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by `order`. A partial aggregate, so a key with many copies never sits in one task."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def filter_links(links: DataFrame, scope: str = "all", query: str = "", dedupe: bool = False) -> DataFrame:
    """Narrow annotated links by scope and case-insensitive text; `dedupe` keeps the first per address and page."""
    out = links
    if scope == "nofollow":
        out = out.filter("nofollow")
    elif scope == "untitled":
        out = out.filter("label = ''")
    elif scope != "all":
        out = out.filter(f"kind = {lit(scope)}")
    needle = query.strip()
    if needle:
        out = out.filter(f"{contains_ci(ADDRESS, needle)} OR {contains_ci('label', needle)}")
    if dedupe:
        keyed = out.selectExpr("*", f"{ADDRESS} AS _address")
        out = keep_first(keyed, ["page_id", "_address"], "pos").drop("_address")
    return out


def summarize_links(links: DataFrame, pages: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts per kind, nofollow and unlabelled links. Counts of all pages are merged with them, never broadcast."""
    keys = keys or ["page_id"]
    counts = links.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.expr(f"count_if(kind = '{k}')").alias(k) for k in KINDS],
        F.expr("count_if(nofollow)").alias("nofollow"), F.expr("count_if(label = '')").alias("untitled"))
    return counts if pages is None else pages.select(*keys).join(counts.hint("merge"), keys, "left").na.fill(0)


def link_rows(links: DataFrame) -> DataFrame:
    """Export columns: url, text, type, rel, target, nofollow."""
    return links.selectExpr("page_id", "pos", f"{ADDRESS} AS url", "label AS text", "kind AS type",
                            "coalesce(rel, '') AS rel", "coalesce(target, '') AS target",
                            "if(nofollow, 'yes', 'no') AS nofollow")


def plain_urls(links: DataFrame) -> DataFrame:
    return links.selectExpr("page_id", "pos", f"{ADDRESS} AS value")


