"""HTML tables: their cells with spans, and what a picker shows of each.

One walk over a page's table tags (see `folds`) finds the tables, in the page's row; a table then is one row with its cells in order.
Nothing is shuffled, and the same code runs on a stream.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from crawlsift.extract.facts import explode_items
from crawlsift.extract.folds import folded
from crawlsift.extract.markup import attr, attr_or
from crawlsift.functions.sql import each, extract, keep, struct
from crawlsift.functions.text import clip, decode_entities

MAX_TEXT = None
#: Fixed value: the largest span that html knows.
MAX_SPAN = 65534
_MARK = re.compile(r"<(/?)(table|tr|td|th|caption|thead|tbody|tfoot)(?=[\s/>])[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"<[^>]*>")
_SECTIONS = {"thead": 0, "tbody": 1, "tfoot": 2}
TABLES = ("array<struct<opened: string, nested: boolean, caption: string, row_count: int, "
          "cells: array<struct<row: int, cell: int, opened: string, header: boolean, text: string>>>>")


def tables_of(markup: str) -> list[tuple]:
    """Every table in the order of its open tag, with its cells in display order (head, body, foot).

    A cell straight after its table, a section or a closed row opens a row of its own, as browsers do. A nested table keeps its own rows;
    its text is also part of the cell that holds it: a cell runs to the next mark of its own table.
    """
    marks = list(_MARK.finditer(markup))
    ends = [m.start() for m in marks[1:]] + [len(markup)]
    texts = [_TAG.sub("", markup[m.end() : end]) for m, end in zip(marks, ends)]
    found: list[dict] = []
    stack: list[dict] = []

    def content(t: dict, until: int) -> None:
        if t["open"]:
            into, start = t["open"]
            into.append("".join(texts[start : max(until, start + 1)]))
            t["open"] = None

    for i, m in enumerate(marks):
        closing, tag = m[1] == "/", m[2].lower()
        if tag == "table" and not closing:
            stack.append({"opened": m[0], "nested": bool(stack), "caption": [], "rows": [], "rank": 1, "before": (tag, False), "open": None})
            found.append(stack[-1])
            continue
        if not stack:
            continue
        t = stack[-1]
        content(t, i)
        if tag == "table":
            stack.pop()
            continue
        before, after = t["before"]
        t["before"] = tag, closing
        if tag in _SECTIONS:
            t["rank"] = 1 if closing else _SECTIONS[tag]
        cell = tag in ("td", "th") and not closing
        if tag == "tr" and not closing or cell and (before == "table" or before in _SECTIONS or before in ("tr", "caption") and after):
            t["rows"].append((t["rank"], []))
        if cell and t["rows"]:
            text: list[str] = []
            t["rows"][-1][1].append((m[0], tag == "th", text))
            t["open"] = text, i
        elif tag == "caption" and not closing and not t["caption"]:
            t["open"] = t["caption"], i
    for t in found:
        content(t, 0)
    return [
        (t["opened"], t["nested"], "".join(t["caption"]), len(t["rows"]), [
            (r, c, opened, header, text[0]) for r, (_, cells) in enumerate(sorted(t["rows"], key=lambda row: row[0]))
            for c, (opened, header, text) in enumerate(cells)])
        for t in found]


def page_tables(parsed: DataFrame, cap: int | None = None, row_cap: int | None = None) -> DataFrame:
    """(page_id, table_index, caption, id, nested, row_count, truncated, cells), cells as ARRAY<STRUCT<row, cell, text, colspan, rowspan,
    header>> in display order; caps on tables per page and rows per table are opt-in."""
    rows = folded(parsed.filter("contains(lower(markup), '<table')").select("page_id", "markup"), "markup", _tables=(tables_of, TABLES))
    span = lambda c, name, least: (
        f"least(greatest(coalesce(try_cast({extract(attr_or(f'{c}.opened', name), r'^\s*\+?([0-9]{1,9})', 1)} AS INT), 1), {least}), {MAX_SPAN})")
    shown = lambda text: clip(decode_entities(text), MAX_TEXT, "empty")
    kept = "cells" if row_cap is None else keep("cells", lambda c: f"{c}.row < {row_cap}")
    cells = each(kept, lambda c: struct(
        row=f"{c}.row", cell=f"{c}.cell", text=shown(f"{c}.text"), colspan=f"if(contains(lower({c}.opened), 'colspan'), {span(c, 'colspan', 1)}, 1)",
        rowspan=f"if(contains(lower({c}.opened), 'rowspan'), {span(c, 'rowspan', 0)}, 1)", header=f"{c}.header"))
    tables = explode_items(rows, "_tables" if cap is None else f"slice(_tables, 1, {cap})", index="table_index")
    # a row cap also bounds the height that grids are padded to
    return tables.selectExpr(
        "page_id", "table_index", f"{shown('caption')} AS caption", f"coalesce({attr('opened', 'id')}, '') AS id", "nested",
        "row_count" if row_cap is None else f"least(row_count, {row_cap}) AS row_count",
        "false AS truncated" if row_cap is None else f"row_count > {row_cap} AS truncated", f"{cells} AS cells")


def extract_tables(parsed: DataFrame, cap: int | None = None, row_cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """tables(page_id, table_index, caption, id, nested, row_count, truncated, headings, preview) and
    table_cells(page_id, table_index, row, cell, text, colspan, rowspan, header, row_count).

    Rows count in display order (head, body, foot); cells outside a row open one.
    """
    tables = page_tables(parsed, cap, row_cap)
    first = keep("cells", lambda c: f"{c}.row = 0")
    described = tables.selectExpr(*[c for c in tables.columns if c != "cells"], f"{first} AS first").selectExpr(
        *[c for c in tables.columns if c != "cells"], "filter(first, x -> x.header).text AS headings", "slice(first.text, 1, 4) AS preview")
    cells = explode_items(tables, "cells", ["page_id", "table_index", "row_count"], index="_at")
    return described, cells.select("page_id", "table_index", "row", "cell", "text", "colspan", "rowspan", "header", "row_count")
