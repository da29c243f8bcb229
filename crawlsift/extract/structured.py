"""Structured data: JSON-LD blocks and Microdata items."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.extract.facts import explode_items, is_jsonld
from crawlsift.extract.folds import attribute, closes, folded, tokens_of
from crawlsift.extract.json_folds import ENTITIES, entities_of
from crawlsift.extract.markup import attr, attr_or
from crawlsift.functions.json import normalise_type, whole_json
from crawlsift.functions.sql import case, each, in_list, keep, lit, struct
from crawlsift.functions.text import WS, clip, decode_entities, first_n
from crawlsift.functions.urls import absolute_or

def extract_jsonld(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    """jsonld_blocks(page_id, block, ok, raw, data VARIANT, error, excerpt)."""
    bodies = first_n(keep("scripts", is_jsonld), cap)
    rows = explode_items(parsed, each(bodies, lambda s: struct(raw=f"trim({s}.body)")), index="block")
    return rows.selectExpr("page_id", "block", "raw", f"{whole_json('raw')} AS data").selectExpr(
        "page_id", "block", "data IS NOT NULL AS ok", "raw", "data",
        "if(data IS NULL, 'Invalid JSON', NULL) AS error",
        f"if(data IS NULL, substr({clip('raw', 500)}, 1, 200), NULL) AS excerpt")


def type_name(types: str) -> str:
    """Normalised names of an array of @type values, joined; '' where none is usable."""
    return f"array_join({keep(each(types, normalise_type), lambda t: f"{t} <> ''")}, ', ')"


def flatten_jsonld(blocks: DataFrame, max_depth: int | None = None, raw: bool = True) -> DataFrame:
    """(page_id, block, level, path, ord, type, raw, filled): every typed object, at any depth, of every block that parsed.

    An array contributes its items, an @graph its members and nothing else of that node, other objects themselves
    and their nested objects, all inside the block's row. Without `raw` the objects' own texts, which hold those of all
    objects inside them, are left out.
    """
    rows = blocks.filter("ok").select("page_id", "block", "raw")
    nodes = folded(rows, "raw", _nodes=(lambda text: list(entities_of(text, max_depth, raw)), ENTITIES))
    found = explode_items(nodes, "_nodes", ["page_id", "block"], index="_at").drop("_at")
    return found.selectExpr("page_id", "block", "level", "concat('block', block, path) AS path", "ord", f"{type_name('types')} AS type", "raw",
                            "filled").filter("type <> ''")


# --- Microdata ------------------------------------------------------------------------------------

_SRC_TAGS = ["img", "audio", "embed", "iframe", "source", "track", "video"]
_ITEM = re.compile(r"(?i)item(?:scope|prop)")
MICRODATA = ("array<struct<item: int, scope: int, parent_scope: int, scope_prop: string, tag_text: string, names: string, pos: int, tok: string, "
             "tag: string, content: string, nested: int>>")


def microdata_of(markup: str) -> list[tuple]:
    """A row for each property of a page's items (one without a property for an empty item), with the scope that holds it.

    Scopes nest as their elements do, so a stack tells each property's owner. A nested scope without itemprop is no item of its own: its
    properties go to the outer one. Items without itemtype are left out with all they hold.
    """
    tokens = tokens_of(markup)
    if not any(name and _ITEM.search(text) for text, name, _ in tokens):
        return []
    ends = closes(tokens)
    open_: list[tuple[int, dict | None]] = []  # where each open scope ends, and its item unless it is none of its own
    items, count = [], -1
    for pos, (text, name, closing) in enumerate(tokens):
        while open_ and open_[-1][0] <= pos:
            open_.pop()
        if closing or not name or not _ITEM.search(text):
            continue
        scope, names = attribute(text, "itemscope") is not None, attribute(text, "itemprop")
        if not scope and names is None:
            continue
        owner = next((item for _, item in reversed(open_) if item is not None), None)
        own = scope and (not open_ or names is not None)
        if names is not None and owner is not None:
            content = "" if scope else "".join(t for t, n, _ in tokens[pos + 1 : ends[pos]] if not n)
            owner["props"].append((names, pos, text, name, content, pos if scope else None))
        if scope:
            item = None
            if own:
                top = not open_ and attribute(text, "itemtype") is not None
                count += top
                item = {"scope": pos, "parent": owner and owner["scope"], "prop": names, "text": text, "props": [], "item": count, "kept": owner["kept"] if owner else top}
                items.append(item)
            open_.append((ends[pos], item))
            # an element that ends before one it was opened in (its close tag is missing) keeps the order of ends
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] > open_[i - 1][0]:
                    open_[i] = (open_[i - 1][0], open_[i][1])
    return [
        (i["item"], i["scope"], i["parent"], i["prop"], i["text"], *p)
        for i in items if i["kept"] for p in i["props"] or [(None,) * 6]]


def _property_value(p: str, text: str) -> str:
    tag, tok = f"{p}.tag", f"{p}.tok"
    link = lambda name: absolute_or("base", attr_or(tok, name), "raw")
    return case(
        (f"{p}.nested IS NOT NULL OR {p}.names IS NULL", "CAST(NULL AS STRING)"), (f"{tag} = 'meta'", clip(attr(tok, "content"), None, "empty")),
        (f"{tag} IN ('a', 'area', 'link')", link("href")), (in_list(tag, _SRC_TAGS), link("src")),
        (f"{tag} = 'object'", link("data")), (f"{tag} IN ('data', 'meter')", clip(attr(tok, "value"), None, "empty")),
        (f"{tag} = 'time'", clip(f"coalesce(nullif({attr(tok, 'datetime')}, ''), {text})", None, "empty")),
        otherwise=clip(text, None, "empty"))


def microdata_array(props: str) -> str:
    """Rows of `microdata_of` with one entry per name, and values read from the tags: ARRAY<STRUCT<item, scope, parent_scope, scope_prop,
    type, id, pos, prop, value, nested>>."""
    def entry(p: str, name: str) -> str:
        return struct(
            item=f"{p}.item", scope=f"{p}.scope", parent_scope=f"{p}.parent_scope", scope_prop=f"{p}.scope_prop",
            type=clip(attr(f"{p}.tag_text", "itemtype"), None, "empty"), id=clip(attr(f"{p}.tag_text", "itemid"), None, "empty"), pos=f"{p}.pos",
            prop=name, value=_property_value(p, decode_entities(f"{p}.content")), nested=f"{p}.nested")

    split = lambda p: keep(f"split({clip(f'{p}.names', None, 'empty')}, {lit(WS + '+')})", lambda n: f"{n} <> ''")
    named = lambda p: case((f"{p}.names IS NULL", f"array({entry(p, 'CAST(NULL AS STRING)')})"), otherwise=each(split(p), lambda n: entry(p, n)))
    return f"flatten({each(props, named)})"


def extract_microdata(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    """microdata_props(page_id, item, scope, parent_scope, scope_prop, type, id, pos, prop, value, nested).

    One row per property of an item or nested item (one row with prop NULL for an empty item); `item` numbers the
    top-level items of a page, `scope` is the position of the element holding the property, `nested` the scope a
    property leads to. A nested scope without itemprop is no item of its own: its properties go to the outer one. `cap` keeps a page's
    first items only.
    """
    pages = parsed.filter("contains(lower(markup), 'itemscope')").select("page_id", "base", "markup")
    rows = folded(pages, "markup", _props=(microdata_of, MICRODATA)).selectExpr("page_id", f"{microdata_array('_props')} AS _props")
    array = "_props" if cap is None else keep("_props", lambda p: f"{p}.item < {cap}")
    return explode_items(rows, array, index="_at").drop("_at")


def items_of(props: list[dict]) -> list[tuple]:
    """(item, type, filled, raw) of a page's top-level items: the names of properties that carry a value, and all properties as a JSON
    object. Repeated names give an array, nested scopes an object of type, id and properties."""
    scopes: dict[int, dict] = {}
    for p in props:
        scope = scopes.setdefault(p["scope"], {**p, "values": {}})
        if p["prop"] is not None:
            scope["values"].setdefault(p["prop"], []).append(p)
    texts: dict[int, str] = {}
    for at in sorted(scopes, reverse=True):  # inner scopes come after the ones that hold them
        scope, parts = scopes[at], []
        for name, values in scope["values"].items():
            shown = [texts.get(v["nested"], "null") if v["nested"] is not None else json.dumps(v["value"], ensure_ascii=False) for v in values]
            parts.append(f"{json.dumps(name, ensure_ascii=False)}:{shown[0] if len(shown) == 1 else '[' + ','.join(shown) + ']'}")
        scope["raw"] = "{" + ",".join(parts) + "}"
        kind, id_ = (json.dumps(scope[k] or None, ensure_ascii=False) for k in ("type", "id"))
        texts[at] = f'{{"type":{kind},"id":{id_},"properties":{scope["raw"]}}}'
    filled = lambda values: len(values) > 1 or values[0]["nested"] is not None or bool((values[0]["value"] or "").strip())
    return [(s["item"], s["type"], [n for n, v in s["values"].items() if filled(v)], s["raw"]) for _, s in sorted(scopes.items()) if s["parent_scope"] is None]


ITEMS = "array<struct<item: int, type: string, filled: array<string>, raw: string>>"


def microdata_entities(microdata: DataFrame) -> DataFrame:
    """(page_id, item, type, filled, raw): top-level items with the names of properties that carry a value, and the properties as JSON."""
    fields = "pos, item, scope, parent_scope, type, id, prop, value, nested"
    rows = folded(microdata.groupBy("page_id").agg(F.expr(f"array_sort(collect_list(struct({fields})))").alias("_props")), "_props", _items=(items_of, ITEMS))
    found = explode_items(rows, "_items", index="_at").drop("_at")
    return found.selectExpr("page_id", "item", f"{normalise_type('type')} AS type", "filled", "raw").filter("type <> ''")
