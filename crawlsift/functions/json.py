"""JSON expressions. Text is kept beside VARIANT values: VARIANT sorts object keys, pages keep source order."""

from __future__ import annotations

from crawlsift.functions.sql import case, let, lit, substitute
from crawlsift.functions.text import js_trim


def normalise_type(value: str) -> str:
    """Bare type name of an @type or itemtype text: the last / or # segment."""
    text = js_trim(value)
    return let(text, lambda t: case(
        (f"{t} = ''", "''"),
        otherwise=f"coalesce(nullif(regexp_extract({t}, {lit('([^/#]+)[/#]*' + chr(92) + 'z')}, 1), ''), {t})"))


def number_text(raw: str) -> str:
    """A JSON number as a browser prints it: no trailing zeros after the point."""
    return substitute(substitute(raw, r"^(-?[0-9]+)\.0+$", "$1"), r"^(-?[0-9]+\.[0-9]*[1-9])0+$", "$1")


def whole_json(text: str) -> str:
    """VARIANT of a text that is one JSON value and nothing else; NULL otherwise (the parser alone stops after the first value)."""
    # the mark, which no text holds of itself, comes second only where the text is one value and goes to its end
    mark = f"md5({text})"
    listed = f"try_variant_get(try_parse_json(concat('[', {text}, ',\"', {mark}, '\"]')), '$', 'array<variant>')"
    return let(listed, lambda x: f"if(size({x}) = 2 AND try_variant_get(get({x}, 1), '$', 'string') = {mark}, get({x}, 0), NULL)")
