"""Document-order tokens as rows, and the elements around them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlsift.extract.markup import VOID_TAGS, html_tokens
from crawlsift.functions.sql import case, each, extract_all, in_list, let, matches, struct
from crawlsift.functions.text import decode_entities

_RAW = "script|style|title|textarea|noscript|iframe|noframes|xmp"


def _attributes(tag: str) -> str:
    """Attributes of an open tag as MAP<STRING, STRING>; the first of a repeated name wins."""
    found = extract_all(tag, r"""(?<=[\s/"'])[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
    name = lambda a: f"lower(regexp_extract({a}, '^[^\\\\s=]+', 0))"
    value = lambda a: decode_entities(
        f"regexp_replace({a}, '(?s)^[^\\\\s=]+\\\\s*(?:=\\\\s*)?(?:\"(.*)\"|\\'(.*)\\'|(.*))\\\\z', '$1$2$3')")
    pairs = each(found, lambda a: struct(k=name(a), v=value(a)))
    return let(pairs, lambda p: f"map_from_entries(filter({p}, (x, i) -> array_position({p}.k, x.k) = i + 1))")


def extract_tokens(pages: DataFrame) -> DataFrame:
    """tokens(page_id, pos, raw, kind, tag, closing, attrs); `raw` of a page joined in order is its html.

    `kind` is comment, declaration, element (script, style, title and the like, taken whole), tag or text.
    """
    rows = pages.selectExpr("page_id", f"posexplode({html_tokens('html')}) AS (pos, raw)")
    kind = case(
        ("startswith(raw, '<!--')", "'comment'"), ("raw RLIKE '^<[!?]'", "'declaration'"),
        (matches("raw", rf"(?i)^<(?:{_RAW})[\s/>]"), "'element'"), (matches("raw", "(?i)^</?[a-z]"), "'tag'"),
        otherwise="'text'")
    opened = "regexp_extract(raw, '^<[A-Za-z](?:[^\"\\'>]++|\"[^\"]*+\"|\\'[^\\']*+\\')*+>', 0)"
    return rows.selectExpr("*", f"{kind} AS kind").selectExpr(
        "page_id", "pos", "raw", "kind",
        "if(kind IN ('tag', 'element'), lower(regexp_extract(raw, '^</?([A-Za-z][^\\\\s/>]*)', 1)), NULL) AS tag",
        "startswith(raw, '</') AS closing", f"if(kind IN ('tag', 'element') AND NOT startswith(raw, '</'), {_attributes(opened)}, "
                                            "NULL) AS attrs")


def with_context(tokens: DataFrame, names: list[str]) -> DataFrame:
    """Tokens plus `in_<name>`: how many open elements of that name are around each. One sort serves all of them.

    A stray close tag never brings a depth below zero; void elements hold nothing.
    """
    order = "OVER (PARTITION BY page_id ORDER BY pos)"
    step = lambda n: (f"CASE WHEN kind = 'tag' AND tag = '{n}' AND NOT {in_list('tag', VOID_TAGS)} "  # noqa: E731
                      "THEN if(closing, -1, 1) ELSE 0 END")
    sums = tokens.selectExpr("*", *[f"sum({step(n)}) {order} AS _s{i}" for i, n in enumerate(names)])
    depth = [f"_s{i} - least(0, min(_s{i}) {order}) AS in_{n}" for i, n in enumerate(names)]
    return sums.selectExpr(*tokens.columns, *depth)
