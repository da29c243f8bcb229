"""Markup expressions over the html column.

Every page is one row, so everything a flat fact needs is computed inside that row: no shuffle, and the same
expressions run on a stream. `parse_pages` brings the html into a canonical form in which every `<` starts a
real tag and every `>` ends one; the element expressions below then are simple linear patterns.
All quantifiers over page text are possessive or over single characters: anything else can overflow the stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlsift.functions.sql import case, each, extract, extract_all, keep, let, lit, matches, struct, substitute
from crawlsift.functions.text import decode_entities
from crawlsift.functions.urls import normalise_url, origin_of, parse_base, protocol_of, resolve_url

_ATTRS = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
_RAW = "script|style|title|textarea|noscript|iframe|noframes|xmp"

# comment | declaration | raw-text element, whole | tag | text | stray <
TOKEN_RE = (
    r"(?is)<!--(?:>|->|.*?(?:--!?>|\z))|<[!?][^>]*>"
    rf"|<({_RAW})(?=[\s/>]){_ATTRS}>.*?(?:</\1\s*>|\z)"
    rf"|</?[a-z][^\s/>]*{_ATTRS}>|[^<]++|<"
)
# the same grammar with ordinary tags and text taken as one run: few matches per page
_KEPT_RUN = rf"(?:[^<]++|<(?!(?:{_RAW})[\s/>])/?[a-z][^\s/>]*+{_ATTRS}>)++"
_SKIPPED = r"<!--(?:>|->|.*?(?:--!?>|\z))|<[!?][^>]*>"
_FAST_RE = (
    rf"(?is){_SKIPPED}|(<(script|style|noscript|iframe|noframes|xmp)(?=[\s/>]){_ATTRS}>).*?(</\2\s*>|\z)"
    rf"|(<(title|textarea)(?=[\s/>]){_ATTRS}>.*?(?:</\5\s*>|\z)|{_KEPT_RUN}|<)"
)
_SCRIPT_RE = (
    rf"(?is){_SKIPPED}|(<script(?=[\s/>]){_ATTRS}>.*?(?:</script\s*>|\z))"
    rf"|<({_RAW})(?=[\s/>]){_ATTRS}>.*?(?:</\2\s*>|\z)|{_KEPT_RUN}|<"
)
_CANONICAL_RE = r"(?s)^(?:[^<>]++|</?[a-zA-Z][^<>]*+>)*+\z"
_OPEN_RE = rf"(?i)^</?[a-z][^\s/>]*{_ATTRS}>"
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


def html_tokens(html: str) -> str:
    """Document-order tokens as ARRAY<STRING>; joined back together they are the html."""
    return extract_all(html, TOKEN_RE)


def _escape_text(text: str) -> str:
    return f"replace(replace({text}, '<', '&lt;'), '>', '&gt;')"


def _canonical_tag(tag: str) -> str:
    """Angle brackets inside attribute values become references (they are decoded with the value)."""
    return f"concat('<', {_escape_text(f'substr({tag}, 2, length({tag}) - 2)')}, '>')"


def _canonical_raw(token: str) -> str:
    """Open tag and close tag; only title and textarea keep their text."""

    def build(opened: str) -> str:
        name = f"lower({extract(opened, '^<([A-Za-z]+)', 1)})"
        body = substitute(f"substr({token}, length({opened}) + 1)", r"(?i)</[a-z]+\s*>\z")
        kept = case((f"{name} IN ('title', 'textarea')", _escape_text(body)), otherwise="''")
        return f"concat({_canonical_tag(opened)}, {kept}, '</', {name}, '>')"

    return let(extract(token, _OPEN_RE), build)


def canonical_markup(html: str) -> str:
    """Html with comments and raw text gone and every `<` and `>` part of a tag.

    One replacement does it for ordinary pages. Pages with angle brackets in text, titles or attribute
    values are rebuilt token by token.
    """
    def clean(m: str) -> str:
        stray = matches(m, r"(?i)<(title|textarea)(?:\s[^>]*)?>[^<]*<(?!/\1[\s>])")
        return f"{matches(m, _CANONICAL_RE)} AND NOT {stray}"

    fast = let(substitute(html, _FAST_RE, "$1$3$4"),
               lambda m: case((clean(m), m), otherwise=_rebuilt(html_tokens(html))))
    return let(let(fast, _drop_templates), _rename_svg)


def _rebuilt(tokens: str) -> str:
    return "array_join(" + each(tokens, lambda t: case(
        (f"NOT startswith({t}, '<')", f"replace({t}, '>', '&gt;')"),
        (f"{t} = '<'", "'&lt;'"),
        (matches(t, "^<[!?]"), "''"),
        (matches(t, rf"(?i)^<(?:{_RAW})[\s/>]"), _canonical_raw(t)),
        otherwise=_canonical_tag(t))) + ", '')"


def _drop_templates(markup: str) -> str:
    """Template content is inert at any depth; of the outermost templates the open tags stay. An unclosed one holds the rest of the page."""
    pieces = f"split({markup}, {lit(r'(?i)(?=</?template[\s/>])')})"
    opens, closes = (matches("p", rf"(?i)^<{slash}template[\s/>]") for slash in ("", "/"))
    state = lambda depth, kept: f"named_struct('d', {depth}, 'out', {kept})"
    step = (
        f"CASE WHEN {opens} THEN {state('s.d + 1', f'if(s.d = 0, array_append(s.out, {extract("p", "^<[^>]*>")}), s.out)')} "
        f"WHEN s.d > 0 AND {closes} THEN {state('s.d - 1', f'if(s.d = 1, array_append(s.out, {substitute("p", "^<[^>]*>")}), s.out)')} "
        f"ELSE {state('s.d', 'if(s.d = 0, array_append(s.out, p), s.out)')} END")
    dropped = f"aggregate({pieces}, {state('0', 'CAST(array() AS ARRAY<STRING>)')}, (s, p) -> {step}, s -> array_join(s.out, ''))"
    return case((f"contains(lower({markup}), '<template')", dropped), otherwise=markup)


def _rename_svg(markup: str) -> str:
    """`a`, `title`, `script` and `style` inside inline SVG are not the HTML elements of that name."""
    parts = f"split({markup}, {lit(r'(?i)(?=<svg[\s/>])|(?<=</svg>)')})"
    renamed = each(parts, lambda p: case(
        (matches(p, r"(?i)^<svg[\s/>]"), substitute(p, r"(?i)<(/?)(a|title|script|style)(?=[\s/>])", "<$1svg-$2")),
        otherwise=p))
    return case((f"contains(lower({markup}), '<svg')", f"array_join({renamed}, '')"), otherwise=markup)


def attr_raw(tag: str, name: str) -> str:
    """Attribute value of an open tag, undecoded; NULL when absent, '' when empty. First duplicate wins."""
    value = r"""(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?"""
    sep = r"""(?:[\s/]+|(?<=["']))"""
    pattern = (
        rf"(?i)^<[^\s/>]+(?:{sep}(?!{name}(?:[\s=/>]))[^\s/>=]+{value})*+"
        rf"{sep}({name}(?=[\s=/>]){value})"
    )
    value_of = lambda t: substitute(f"nullif({extract(t, pattern, 1)}, '')",
                                    r"""(?s)^[^\s=]+\s*(?:=\s*)?(?:"(.*)"|'(.*)'|(.*))\z""", "$1$2$3")
    # most tags lack most attributes, and a text search says so sooner than the pattern
    return let(tag, lambda t: case((f"contains(lower({t}), {lit(name.lower())})", value_of(t))))


def attr(tag: str, name: str) -> str:
    """Attribute value with character references decoded."""
    return decode_entities(attr_raw(tag, name))


def attr_or(tag: str, name: str, default: str = "") -> str:
    return f"coalesce({attr(tag, name)}, {lit(default)})"


def has_attr(tag: str, name: str) -> str:
    return f"{attr_raw(tag, name)} IS NOT NULL"


def open_tag(fragment: str) -> str:
    return extract(fragment, "^<[^>]*>")


def text_content(fragment: str) -> str:
    """All text inside a fragment, tags removed and references decoded."""
    return decode_entities(substitute(fragment, "<[^>]*>"))


def tags(markup: str, names: str) -> str:
    """Open tags of the given names (`a|b`) in document order."""
    return extract_all(markup, rf"(?i)<(?:{names})(?:[\s/][^>]*)?>")


def elements(markup: str, names: str) -> str:
    """Fragments `<x ...>content` of elements that do not nest in themselves; the next one ends an open one."""
    return extract_all(markup, rf"(?is)<(?:{names})(?:[\s/][^>]*)?>(?:[^<]++|<(?!/?(?:{names})[\s/>])[^>]*+>)*+")


def head_of(markup: str) -> str:
    return extract(markup, r"(?is)^.*?(?=</head\s*>|<body[\s>]|\z)")


def body_of(markup: str) -> str:
    """Everything after the body tag; without one, everything after the head."""
    return substitute(markup, r"(?is)^(?:.*?<body(?:[\s/][^>]*)?>|.*?</head\s*>)|</body\s*>.*\z")


def script_array(html: str) -> str:
    """Scripts as ARRAY<STRUCT<tag, body>> in document order, bodies verbatim."""
    found = keep(extract_all(html, _SCRIPT_RE, 1), lambda t: f"{t} <> ''")
    return each(found, lambda t: let(extract(t, _OPEN_RE), lambda o: struct(
        tag=_canonical_tag(o), body=substitute(f"substr({t}, length({o}) + 1)", r"(?i)</script\s*>\z"))))


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> the same without html, plus canonical markup, scripts and the base URL.

    Adds `address` (canonical url), `origin`, `protocol`, `base` (struct used to resolve links), `markup`, and
    `scripts`. A narrow projection: no shuffle, and columns nobody reads are never computed.
    """
    base_tag = f"get({keep(tags('markup', 'base'), lambda t: has_attr(t, 'href'))}, 0)"
    base_url = case(("contains(lower(markup), '<base')", resolve_url("page_base", attr(base_tag, "href"))))
    carried = [c for c in pages.columns if c != "html"]
    first = pages.selectExpr(*carried, f"{normalise_url('url')} AS address", f"{canonical_markup('html')} AS markup",
                             f"{script_array('html')} AS scripts")
    second = first.selectExpr("*", f"{origin_of('address')} AS origin", f"{protocol_of('url')} AS protocol",
                              f"{parse_base('address')} AS page_base")
    third = second.selectExpr("*", f"{base_url} AS base_url")
    return third.selectExpr(*carried, "address", "markup", "scripts", "origin", "protocol",
                            f"coalesce({parse_base('base_url')}, page_base) AS base")
