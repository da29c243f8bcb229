"""Page audit: essentials, social sharing, structure. Rules over one `page_facts` row, so no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlsift.extract.facts import where_computed
from crawlsift.functions.sql import case, let
from crawlsift.functions.text import js_length, text_or_empty
from crawlsift.functions.urls import host_of, is_absolute_http_url
from crawlsift.operators.findings import explode_findings, finding, say

# Thresholds and headings of the audit.
TITLE_MIN, TITLE_MAX = 30, 60
DESC_MIN, DESC_MAX = 70, 160
OG_TITLE_MAX, OG_DESC_MAX = 90, 200
GROUPS = [
    ("essentials", "SEO essentials"),
    ("social", "Social sharing"),
    ("structure", "Structure & accessibility"),
]


def _group(group: str):
    return lambda id_, label, status, message, value=None: finding(group, id_, label, status, message, value)


def _missing(column: str) -> str:
    return f"{text_or_empty(column)} = ''"


def _measured(id_: str, label: str, text: str, count: str, noun: str, low: int, high: int,
              missing: str, too_long: str) -> str:
    rule = _group("essentials")

    def judge(t: str) -> str:
        size = js_length(t)
        return case(
            (f"{count} > 1", rule(id_, label, "error", say(f"={count}", f" {noun} found. Keep exactly one."),
                                  f"nullif({t}, '')")),
            (f"{t} = ''", rule(id_, label, "error", missing)),
            (f"{size} < {low}", rule(id_, label, "warning", say(
                f"={size}", f" characters - short. Aim for {low}-{high}."), t)),
            (f"{size} > {high}", rule(id_, label, "warning", say(f"={size}", too_long), t)),
            otherwise=rule(id_, label, "ok", say(f"={size}", " characters."), t))

    return let(text_or_empty(text), judge)


def essentials_rules() -> list[str]:
    rule = _group("essentials")
    robots = lambda word: f"contains(lower({text_or_empty('robots')}), '{word}')"
    return [
        _measured("title", "Title", "title", "title_count", "<title> tags", TITLE_MIN, TITLE_MAX,
                  "Missing. Every page needs a unique <title>.", " characters - likely truncated in search results."),
        _measured("description", "Meta description", "description", "description_count", "description tags",
                  DESC_MIN, DESC_MAX, "Missing. Search engines will invent a snippet instead.",
                  " characters - likely truncated."),
        case(("canonical_count > 1", rule("canonical", "Canonical URL", "error", say(
                 "=canonical_count", " canonical links found. Keep exactly one."), "canonical")),
             (_missing("canonical_raw"), rule("canonical", "Canonical URL", "warning",
                                              "Missing. Duplicate URLs may compete against each other.")),
             (f"NOT {is_absolute_http_url('canonical')}", rule(
                 "canonical", "Canonical URL", "error", "Not a valid absolute http(s) URL.", "canonical_raw")),
             otherwise=rule("canonical", "Canonical URL", "ok", "Present and absolute.", "canonical")),
        case((robots("noindex"), rule("robots", "Robots", "warning",
                                      "This page asks search engines not to index it.", "robots")),
             (robots("nofollow"), rule("robots", "Robots", "warning",
                                       "Links on this page will not be followed.", "robots")),
             (_missing("robots"), rule("robots", "Robots", "info", "No robots meta tag - defaults to indexable.")),
             otherwise=rule("robots", "Robots", "ok", "Indexable.", "robots")),
        case((_missing("lang"), rule("lang", "Language", "error",
                                     "No lang attribute on <html>. Screen readers cannot pick a voice.")),
             otherwise=rule("lang", "Language", "ok", "Declared.", "lang")),
        case(("has_charset_tag", rule("charset", "Charset", "ok", "Declared.", "charset")),
             otherwise=rule("charset", "Charset", "warning",
                            "No charset declaration found in the markup.", "charset")),
        case((_missing("viewport"), rule("viewport", "Viewport", "warning",
                                         "Missing. The page will not scale correctly on mobile.")),
             otherwise=rule("viewport", "Viewport", "ok", "Declared.", "viewport")),
        case(("protocol <> 'https:'", rule("https", "HTTPS", "warning", say(
            "Served over ", "=replace(protocol, ':', '')", "."), "protocol"))),
    ]


def social_rules() -> list[str]:
    rule = lambda id_, status, message, value=None: finding("social", id_, id_, status, message, value)

    def sized(id_: str, column: str, limit: int) -> str:
        return let(text_or_empty(column), lambda t: case(
            (f"{t} = ''", rule(id_, "warning", "Missing. Shared links will fall back to page content.")),
            (f"{js_length(t)} > {limit}", rule(id_, "warning", say(
                f"={js_length(t)}", f" characters - over the {limit} character guideline."), t)),
            otherwise=rule(id_, "ok", say(f"={js_length(t)}", " characters."), t)))

    return [
        sized("og:title", "og.title", OG_TITLE_MAX),
        sized("og:description", "og.description", OG_DESC_MAX),
        case((_missing("og.image"), rule("og:image", "warning",
                                         "Missing. Shared links will have no preview image.")),
             (f"NOT {is_absolute_http_url('og.image')}", rule(
                 "og:image", "error", "Must be an absolute http(s) URL.", "og.image")),
             otherwise=rule("og:image", "ok", "Present and absolute.", "og.image")),
        case((_missing("og.type"), rule("og:type", "info", 'Not set - defaults to "website".')),
             otherwise=rule("og:type", "ok", "Declared.", "og.type")),
        case((_missing("twitter.card"), rule(
                 "twitter:card", "warning", "Missing. X/Twitter falls back to Open Graph, with less control.")),
             otherwise=rule("twitter:card", "ok", "Declared.", "twitter.card")),
    ]


def heading_skip_struct(headings: str) -> str:
    """First heading more than one level below the one before it, else NULL: struct<from, to, pos, text>.

    Levels outside 1-6 are ignored.
    """
    valid = (f"filter(transform({headings}, (h, i) -> named_struct('level', h.level, 'pos', i, 'text', h.text)), "
             "h -> h.level BETWEEN 1 AND 6)")
    return let(valid, lambda v: (
        f"get(filter(zip_with({v}, slice({v}, 2, greatest(size({v}) - 1, 0)), (a, b) -> "
        "named_struct('from', a.level, 'to', b.level, 'pos', b.pos, 'text', b.text)), p -> p.to > p.from + 1), 0)"))


def structure_rules() -> list[str]:
    rule = _group("structure")
    h1 = "transform(filter(headings, h -> h.level = 1), h -> h.text)"
    return [
        case(("h1_count = 0", rule("h1", "H1 heading", "error", "No H1 found. The page has no main heading.")),
             ("h1_count > 1", rule("h1", "H1 heading", "warning", say(
                 "=h1_count", " H1 headings. One per page is clearer."), f"array_join({h1}, ' | ')")),
             otherwise=rule("h1", "H1 heading", "ok", "Exactly one.", f"get({h1}, 0)")),
        case(("_skip IS NOT NULL", rule("outline", "Heading outline", "warning", say(
                 "Jumps from H", "=_skip.from", " to H", "=_skip.to", ". Do not skip levels."), "_skip.text")),
             ("size(headings) > 0", rule("outline", "Heading outline", "ok", say(
                 "=size(headings)", " headings, no skipped levels."))),
             otherwise=rule("outline", "Heading outline", "warning", "No headings at all on this page.")),
        case(("images.total = 0", rule("alt", "Image alt text", "info", "No images on this page.")),
             ("images.missing_alt > 0", rule("alt", "Image alt text", "warning", say(
                 "=images.missing_alt", " of ", "=images.total", " images have no alt attribute."),
                 "array_join(images.missing_alt_samples, '\\n')")),
             otherwise=rule("alt", "Image alt text", "ok", say(
                 "All ", "=images.total", " images have an alt attribute."))),
        case(("links.empty_text > 0", rule("link-text", "Link labels", "warning", say(
                 "=links.empty_text", " links have no discernible text."),
                 "array_join(links.empty_text_samples, '\\n')")),
             ("links.total > 0", rule("link-text", "Link labels", "ok", "All links are labelled."))),
        rule("links", "Links", "info", say("=links.internal", " internal, ", "=links.external", " external, ",
                                           "=links.nofollow", " nofollow.")),
        case(("array_contains(structured_data, 'Invalid JSON-LD')", rule(
                 "jsonld", "Structured data", "error", "A JSON-LD block failed to parse.",
                 "array_join(structured_data, ', ')")),
             ("size(structured_data) > 0", rule("jsonld", "Structured data", "ok", say(
                 "=size(structured_data)", " JSON-LD block(s)."), "array_join(structured_data, ', ')")),
             otherwise=rule("jsonld", "Structured data", "info", "No JSON-LD found.")),
        case(("size(hreflang) > 0", rule("hreflang", "hreflang", "info", say(
            "=size(hreflang)", " alternate language link(s)."), "array_join(hreflang.lang, ', ')"))),
        rule("words", "Word count", "info", say("=word_count", " words.")),
    ]


def audit_pages(facts: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """findings(page_id, audit, id, group, label, status, message, value, seq) for every page."""
    judged = facts.selectExpr("*", f"{heading_skip_struct('headings')} AS _skip")
    return explode_findings(judged, essentials_rules() + social_rules() + structure_rules(), "seo", carry)


def heading_skip(facts: DataFrame) -> DataFrame:
    skip = facts.selectExpr("page_id", f"{heading_skip_struct('headings')} AS _s")
    return where_computed(skip, "_s IS NOT NULL").select("page_id", "_s.*")


def social_preview(facts: DataFrame) -> DataFrame:
    """What a shared link would show. Pages with nothing to show are left out."""
    rows = facts.selectExpr(
        "page_id", "coalesce(og.title, title) AS title", "coalesce(og.description, description) AS description",
        "og.image AS image", "coalesce(og.image_alt, '') AS image_alt",
        f"{host_of('coalesce(og.url, url)')} AS host")
    shown = where_computed(rows, "title IS NOT NULL OR description IS NOT NULL OR image IS NOT NULL")
    return shown.selectExpr("page_id", "coalesce(title, '(no title)') AS title", "description", "image", "image_alt",
                            "host")
