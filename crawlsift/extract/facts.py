"""Flat page facts: links, images, headings, metadata, word counts and the combined `page_facts` row.

Every function takes the output of `parse_pages` and stays inside the page's row until the final explode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.extract.markup import (
    attr, attr_or, body_of, elements, has_attr, head_of, open_tag, tags, text_content,
)
from crawlsift.functions.json import whole_json
from crawlsift.functions.sql import any_of, case, each, extract, extract_all, keep, let, lit, matches, struct, substitute
from crawlsift.functions.text import clip, count_words, decode_entities, first_n, js_trim, nonblank, squish
from crawlsift.functions.urls import absolute_or, resolve_url

#: Texts stay whole; a report may clip its own columns.
MAX_TEXT = None
# The tags a page is asked for, and the elements that do not break a line of text.
META_KEYS = ["description", "viewport", "robots", "author", "theme-color", "generator"]
OG_KEYS = ["title", "description", "image", "url", "type", "site_name", "image:alt"]
TWITTER_KEYS = ["card", "title", "description", "image", "site"]
_INLINE = (
    "a|abbr|b|bdi|bdo|cite|code|data|dfn|em|font|i|kbd|mark|q|rp|rt|ruby|s|samp|small|span|strong|sub|sup|time|u|"
    "var|wbr|del|ins"
)


def explode_items(df: DataFrame, array: str, carry: list[str] | None = None, index: str = "pos") -> DataFrame:
    """One row per array element with its 0-based position; struct fields become columns.

    Outer, then filtered: an inner explode makes the optimizer evaluate the whole array twice.
    """
    carry = carry or ["page_id"]
    rows = df.selectExpr(*carry, f"{array} AS _items").select(
        *carry, F.posexplode_outer("_items").alias(index, "_item")).filter(f"{index} IS NOT NULL")
    if rows.schema["_item"].dataType.typeName() == "struct":
        return rows.select(*carry, index, "_item.*")
    return rows.withColumnRenamed("_item", "value")


def where_computed(df: DataFrame, condition: str) -> DataFrame:
    """Filter on computed columns without moving the predicate - and with it the computation - into the scan."""
    rows = df.selectExpr(f"explode_outer(if({condition}, array(struct(*)), NULL)) AS _row")
    return rows.filter("_row IS NOT NULL").select("_row.*")


# --- arrays inside a page's row -------------------------------------------------------------------


def meta_array(markup: str) -> str:
    return each(tags(markup, "meta"), lambda t: struct(
        name=attr(t, "name"), property=attr(t, "property"), content=attr_or(t, "content"),
        charset=f"({has_attr(t, 'charset')} OR lower({attr_or(t, 'http-equiv')}) = 'content-type')"))


def meta_matches(metas: str, key: str) -> str:
    """Entries whose name or property is the key, case-sensitively."""
    return keep(metas, lambda m: f"{m}.name <=> {lit(key)} OR {m}.property <=> {lit(key)}")


def meta_value(metas: str, key: str) -> str:
    return clip(f"get({meta_matches(metas, key)}, 0).content", MAX_TEXT, "null")


def link_tag_array(markup: str) -> str:
    return each(tags(markup, "link"), lambda t: struct(
        rel=f"lower({attr(t, 'rel')})", href=attr(t, "href"), hreflang=attr(t, "hreflang")))


def title_array(markup: str) -> str:
    """Texts of the title elements in the head."""
    return each(extract_all(head_of(markup), r"(?i)<title(?:\s[^>]*)?>([^<]*)", 1), decode_entities)


def heading_array(markup: str) -> str:
    return each(elements(markup, "h[1-6]"), lambda h: struct(
        level=f"CAST(substr({h}, 3, 1) AS INT)", text=clip(text_content(h), MAX_TEXT)))


def link_array(markup: str, base: str) -> str:
    """Every `a[href]` with the fields a reader or a screen reader would use."""

    def raw(fragment: str) -> str:
        images = tags(fragment, "img")
        return let(open_tag(fragment), lambda t: struct(
            declared=attr(t, "href"), content=text_content(fragment), aria=attr_or(t, "aria-label"),
            images=images, title=attr(t, "title"), rel=attr(t, "rel"), target=attr(t, "target")))

    def link(s: str) -> str:
        with_alt = keep(f"{s}.images", lambda i: has_attr(i, "alt"))
        label = f"coalesce({nonblank(s + '.content')}, {nonblank(s + '.aria')}, " \
                f"{nonblank(attr(f'get({with_alt}, 0)', 'alt'))})"
        return struct(
            declared=f"{s}.declared", raw=js_trim(f"{s}.declared"),
            href=resolve_url(base, js_trim(f"{s}.declared")),
            text=clip(f"{s}.content", MAX_TEXT), aria_label=clip(f"{s}.aria", MAX_TEXT),
            image_alt=clip(attr(f"get({s}.images, 0)", "alt"), MAX_TEXT, "empty"), title=clip(f"{s}.title", MAX_TEXT, "empty"),
            rel=f"lower({clip(s + '.rel', MAX_TEXT, 'empty')})", target=clip(f"{s}.target", MAX_TEXT, "empty"),
            named=f"{label} IS NOT NULL")

    anchors = keep(elements(markup, "a"), lambda f: matches(f, r"(?i)^<a\s[^>]*href"))
    return each(keep(each(anchors, raw), lambda s: f"{s}.declared IS NOT NULL"), link)


def image_array(markup: str, base: str) -> str:
    """img, then image inputs, then areas, then labelled inline SVG; document order inside each kind."""
    pattern = r"(?is)<svg(?:[\s/][^>]*)?>(?:[^<]++|<(?!/svg[\s>])[^>]*+>)*+|<(?:img|input|area)(?:[\s/][^>]*)?>"

    def in_part(part: str) -> str:
        linked = f"{matches(part, r'(?i)^<a[\s/]')} AND {has_attr(open_tag(part), 'href')}"
        return let(linked, lambda inside: each(extract_all(part, pattern), lambda f: struct(
            kind=f"lower({extract(f, '^<([A-Za-z]+)', 1)})", tag=open_tag(f), fragment=f, in_link=inside)))

    def ordered(s: str) -> str:
        return "concat(" + ", ".join([
            keep(s, lambda i: f"{i}.kind = 'img'"),
            keep(s, lambda i: f"{i}.kind = 'input' AND lower({attr(i + '.tag', 'type')}) = 'image'"),
            keep(s, lambda i: f"{i}.kind = 'area'"),
            keep(s, lambda i: f"{i}.kind = 'svg' AND {attr(i + '.tag', 'role')} = 'img'")]) + ")"

    def record(s: str) -> str:
        tag, svg = f"{s}.tag", f"{s}.kind = 'svg'"
        raw = case((svg, "''"), (f"{s}.kind = 'area'", attr_or(tag, "href")), otherwise=attr_or(tag, "src"))
        svg_title = f"get({extract_all(s + '.fragment', r'(?i)<svg-title(?:\s[^>]*)?>([^<]*)', 1)}, 0)"
        svg_alt = f"coalesce(nullif({attr(tag, 'aria-label')}, ''), {clip(decode_entities(svg_title), MAX_TEXT)})"
        number = lambda name: f"coalesce(try_cast({attr(tag, name)} AS INT), 0)"
        return struct(
            kind=f"{s}.kind", alt=case((svg, svg_alt), otherwise=clip(attr(tag, "alt"), MAX_TEXT)),
            src=absolute_or(base, raw, "raw"),
            raw_src=case((svg, "'(inline svg)'"), otherwise=clip(raw, MAX_TEXT)),
            title=case((svg, "''"), otherwise=clip(attr(tag, "title"), MAX_TEXT, "empty")),
            role=f"lower({attr_or(tag, 'role')})", aria_hidden=f"coalesce({attr(tag, 'aria-hidden')} = 'true', false)",
            aria_label=clip(attr(tag, "aria-label"), MAX_TEXT, "empty"), loading=f"lower({attr_or(tag, 'loading')})",
            width=number("width"), height=number("height"),
            natural_width="CAST(NULL AS INT)", natural_height="CAST(NULL AS INT)", in_link=f"{s}.in_link")

    parts = f"split({markup}, {lit(r'(?i)(?=</?a[\s/>])')})"
    return each(let(f"flatten({each(parts, in_part)})", ordered), record)


def _shown(markup: str) -> str:
    """The body without hidden elements and inline tags."""
    hidden = (r"""(?is)<([a-z][a-z0-9]*)(?:\s[^>]*)?\s(?:hidden(?=[\s=>])|style\s*=\s*["'][^"'>]*"""
              r"""(?:display\s*:\s*none|visibility\s*:\s*hidden))[^>]*>(?:[^<]++|<(?!/\1[\s>])[^>]*+>)*+</\1\s*>""")
    hints = r"(?i)\shidden[\s=>]|display\s*:\s*none|visibility\s*:\s*hidden"
    shown = let(body_of(markup), lambda b: case((matches(b, hints), substitute(b, hidden, " ")), otherwise=b))
    return substitute(shown, rf"(?i)</?(?:{_INLINE})(?:[\s/][^>]*)?>")


def visible_text(markup: str) -> str:
    """Body text as read: hidden elements dropped, block boundaries as spaces."""
    return decode_entities(substitute(_shown(markup), "<[^>]*>", " "))


def text_runs(markup: str) -> str:
    """The same text as ARRAY<STRING>, one entry between any two block boundaries, without blank ones."""
    return keep(each(f"split({_shown(markup)}, '<[^>]*>')", lambda t: squish(decode_entities(t))), lambda t: f"{t} <> ''")


def is_jsonld(script: str) -> str:
    return f"lower({attr(script + '.tag', 'type')}) = 'application/ld+json'"


def jsonld_type_array(scripts: str, limit: int | None = None) -> str:
    """@type of each top-level entry; no more blocks are read once `limit` entries are there."""

    def type_of(e: str) -> str:
        path = lit("$['@type']")
        return (f"coalesce(array_join(try_variant_get({e}, {path}, 'array<string>'), ', '), "
                f"nullif(try_variant_get({e}, {path}, 'string'), ''), 'Unknown')")

    def types_of(block: str) -> str:
        entries = f"coalesce(try_variant_get({block}, '$', 'array<variant>'), array({block}))"
        return case((f"{block} IS NULL", "array('Invalid JSON-LD')"), otherwise=each(entries, type_of))

    blocks = each(keep(scripts, is_jsonld), lambda s: let(whole_json(f"{s}.body"), types_of))
    if limit is None:
        return f"flatten({blocks})"
    return (f"aggregate({blocks}, CAST(array() AS ARRAY<STRING>), "
            f"(seen, b) -> CASE WHEN size(seen) >= {limit} THEN seen ELSE concat(seen, b) END)")


# --- long tables ----------------------------------------------------------------------------------

_LANG = nonblank(attr(f"get({tags('markup', 'html')}, 0)", "lang"))
_ALTERNATES = keep("_link_tags", lambda t: f"{t}.rel = 'alternate' AND {t}.hreflang IS NOT NULL")
_CANONICALS = keep("_link_tags", lambda t: f"{t}.rel = 'canonical'")


def _first_canonical(found: str) -> str:
    return case((f"size({found}) > 0", js_trim(f"coalesce(get({found}, 0).href, '')")))


def _resolved_alternates(found: str, cap: int | None) -> str:
    return each(first_n(found, cap), lambda t: struct(lang=f"{t}.hreflang", href=absolute_or("base", f"{t}.href", "null")))


def extract_title(parsed: DataFrame) -> DataFrame:
    return parsed.selectExpr("page_id", f"{title_array('markup')} AS _t").selectExpr(
        "page_id", f"{clip('get(_t, 0)', MAX_TEXT, 'null')} AS title", "size(_t) AS title_count")


def extract_meta(parsed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First content and number of tags per key that occurs: (page_id, key, content, n)."""
    keys = keys or META_KEYS + [f"og:{k}" for k in OG_KEYS] + [f"twitter:{k}" for k in TWITTER_KEYS]
    entries = "array(" + ", ".join(struct(
        key=lit(k), content=meta_value("_m", k), n=f"size({meta_matches('_m', k)})") for k in keys) + ")"
    return explode_items(parsed.selectExpr("page_id", f"{meta_array('markup')} AS _m"), entries).drop("pos").filter(
        "n > 0")


def extract_page_identity(parsed: DataFrame) -> DataFrame:
    return parsed.selectExpr(
        "page_id", "url", "origin", "protocol", f"{_LANG} AS lang",
        f"{any_of(meta_array('markup'), lambda m: f'{m}.charset')} AS has_charset_tag")


def extract_canonical(parsed: DataFrame) -> DataFrame:
    return (
        parsed.selectExpr("page_id", "base", f"{link_tag_array('markup')} AS _link_tags")
        .selectExpr("page_id", "base", f"{_CANONICALS} AS _c")
        .selectExpr("page_id", "base", f"{_first_canonical('_c')} AS canonical_raw", "size(_c) AS canonical_count")
        .selectExpr("page_id", "canonical_raw", f"{absolute_or('base', 'canonical_raw', 'null')} AS canonical",
                    "canonical_count"))


def extract_headings(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    return explode_items(parsed, first_n(heading_array("markup"), cap))


def extract_links(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    """links(page_id, origin, pos, raw, href, text, ..., total, truncated): all rows unless `cap` is given, true total."""
    rows = parsed.selectExpr("page_id", "origin", f"{link_array('markup', 'base')} AS _l").selectExpr(
        "*", "size(_l) AS total")
    links = explode_items(rows, first_n("_l", cap), ["page_id", "origin", "total"])
    truncated = "false" if cap is None else f"total > {cap}"
    return links.drop("declared", "named").selectExpr("*", f"{truncated} AS truncated")


def extract_images(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    return explode_items(parsed, first_n(image_array("markup", "base"), cap), index="index")


def extract_hreflang(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    rows = parsed.selectExpr("page_id", "base", f"{link_tag_array('markup')} AS _link_tags")
    return explode_items(rows, _resolved_alternates(_ALTERNATES, cap))


def extract_jsonld_types(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    return explode_items(parsed, jsonld_type_array("scripts", cap)).withColumnRenamed("value", "type")


def word_counts(parsed: DataFrame) -> DataFrame:
    return parsed.selectExpr("page_id", f"{count_words(visible_text('markup'))} AS word_count")


def extract_page_facts(parsed: DataFrame, samples: int = 5) -> DataFrame:
    """One row of unjudged facts per page, the input of the page audit. Narrow projections only."""
    extra = ["captured_at"] if "captured_at" in parsed.columns else []
    kept = ["page_id", "url", "origin", "protocol", "base", *extra]
    images = each(tags("markup", "img"), lambda t: struct(alt=attr(t, "alt"), src=attr(t, "src")))
    arrays = parsed.selectExpr(
        *kept, f"{meta_array('markup')} AS _metas", f"{link_tag_array('markup')} AS _link_tags",
        f"{title_array('markup')} AS _titles", f"{heading_array('markup')} AS _headings",
        f"{link_array('markup', 'base')} AS _links", f"{images} AS _imgs", f"{_LANG} AS lang",
        f"{jsonld_type_array('scripts')} AS structured_data",
        f"{count_words(visible_text('markup'))} AS word_count")

    # anchors, scripts, mail and phone links are not navigation; an empty href resolves to nothing
    counted = keep("_links", lambda s: f"NOT {matches(s + '.declared', '(?i)^(?:javascript:|mailto:|tel:|#)')} "
                                       f"AND {s}.declared <> '' AND {s}.href IS NOT NULL")
    meta = lambda key: meta_value("_metas", key)
    plain = {k.replace(":", "_"): meta(f"og:{k}") for k in OG_KEYS}
    cards = {k: meta(f"twitter:{k}") for k in TWITTER_KEYS}
    chosen = arrays.selectExpr(
        "*", f"{counted} AS _counted", f"{_CANONICALS} AS _canonicals", f"{_ALTERNATES} AS _alternates",
        f"{keep('_imgs', lambda i: f'{i}.alt IS NULL')} AS _missing",
        f"{meta('description')} AS description", f"size({meta_matches('_metas', 'description')}) AS description_count",
        f"{meta('viewport')} AS viewport", f"{meta('robots')} AS robots", f"{meta('author')} AS author",
        f"{meta('theme-color')} AS theme_color", f"{struct(**plain)} AS _og", f"{struct(**cards)} AS _twitter")
    more = chosen.selectExpr(
        "*", f"{_first_canonical('_canonicals')} AS canonical_raw",
        f"{keep('_counted', lambda s: f'NOT {s}.named')} AS _unnamed",
        f"{absolute_or('base', '_og.image', 'null')} AS _og_image",
        f"{absolute_or('base', '_twitter.image', 'null')} AS _twitter_image")

    n = lambda array, test: f"size({keep(array, test)})"
    inside = lambda s: f"startswith({s}.href, origin)"
    og = {k.replace(":", "_"): "_og_image" if k == "image" else f"_og.{k.replace(':', '_')}" for k in OG_KEYS}
    twitter = {k: "_twitter_image" if k == "image" else f"_twitter.{k}" for k in TWITTER_KEYS}
    image_counts = struct(
        total="size(_imgs)", missing_alt="size(_missing)",
        decorative_alt=n("_imgs", lambda i: f"{js_trim(i + '.alt')} = ''"),
        missing_alt_samples=each(f"slice(_missing, 1, {samples})", lambda i: f"coalesce(nullif({i}.src, ''), '(no src)')"))
    link_counts = struct(
        total="size(_links)", internal=n("_counted", inside), external=n("_counted", lambda s: f"NOT {inside(s)}"),
        nofollow=n("_counted", lambda s: f"contains({s}.rel, 'nofollow')"), empty_text="size(_unnamed)",
        empty_text_samples=each(f"slice(_unnamed, 1, {samples})", lambda s: f"{s}.href"))
    return more.selectExpr(
        "page_id", "url", "origin", "protocol", "lang", "CAST(NULL AS STRING) AS charset",
        f"{any_of('_metas', lambda m: f'{m}.charset')} AS has_charset_tag", "viewport",
        f"{clip('get(_titles, 0)', MAX_TEXT, 'null')} AS title", "size(_titles) AS title_count",
        "description", "description_count",
        f"{absolute_or('base', 'canonical_raw', 'null')} AS canonical", "canonical_raw",
        "size(_canonicals) AS canonical_count", "robots", "author", "theme_color",
        f"{struct(**og)} AS og", f"{struct(**twitter)} AS twitter",
        "_headings AS headings", f"{n('_headings', lambda h: f'{h}.level = 1')} AS h1_count",
        f"{image_counts} AS images", f"{link_counts} AS links",
        f"{_resolved_alternates('_alternates', None)} AS hreflang", "structured_data", "word_count", *extra)


def seo_link_counts(parsed: DataFrame, samples: int = 5) -> DataFrame:
    return extract_page_facts(parsed, samples).select("page_id", "links.*")


def seo_image_counts(parsed: DataFrame, samples: int = 5) -> DataFrame:
    return extract_page_facts(parsed, samples).select("page_id", "images.*")
