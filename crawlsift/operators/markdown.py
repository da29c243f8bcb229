"""Blocks to Markdown: one document per page, in the page's row."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.extract.blocks import BLOCKS, blocks_of
from crawlsift.extract.facts import explode_items, heading_array, meta_array, meta_matches, title_array
from crawlsift.extract.folds import folded
from crawlsift.functions.markdown import MARKS, inline_piece, markdown_escape, render_code, render_figure, render_table
from crawlsift.functions.sql import case, each, let, lit, struct
from crawlsift.functions.text import WHITESPACE, js_trim, squish

_EDGES = re.compile(rf"^[{WHITESPACE}]+|[{WHITESPACE}]+\Z")
_BREAK = "  \n"


def _inline(pieces: list[dict], links: bool) -> str:
    """A block's pieces put together: wrappers trimmed inside, empty ones dropped, at any depth."""
    open_: list[tuple[str, str, list[str]]] = [("", "", [])]

    def close() -> None:
        kind, target, parts = open_.pop()
        text = _EDGES.sub("", "".join(parts))
        if text:
            plain = kind == "a" and not (target and links)
            open_[-1][2].append(text if plain else f"[{text}]({target})" if kind == "a" else MARKS[kind] + text + MARKS[kind])

    for piece in pieces:
        kind, text = piece["kind"], piece["text"]
        sign, name = kind[0], kind[1:]
        if sign not in "+-":
            open_[-1][2].append(_BREAK if kind == "br" else text)
        elif sign == "+" and name != "a":
            open_.append((name, "", []))
        else:
            # the element that ends, and those opened in it, which go on behind it
            at = max((i for i, level in enumerate(open_) if level[0] == name), default=0)
            inner = [level[:2] for level in open_[at + 1 :]] if at else []
            for _ in range(len(inner) + 1 if at else 0):
                close()
            open_.extend((k, t, []) for k, t in inner)
            if sign == "+":
                open_.append((name, text, []))
    while len(open_) > 1:
        close()
    return _EDGES.sub("", "".join(open_[0][2]))


def _quoted(levels: list[tuple], line: str, old: int, first: bool) -> str:
    """A line with the quotes and indents of its levels; the first line of a new item shows its marker."""
    for at in range(len(levels) - 1, -1, -1):
        kind, _, _, marker = levels[at]
        if kind == "blockquote":
            line = f"> {line}" if line else ">"
        elif first and at >= old:
            line = marker + line
        elif line:
            line = " " * len(marker) + line
    return line


def _nested(blocks: list[dict], links: bool) -> list[tuple]:
    """(pos, type, text, piece): text with list markers and quote prefixes, led by the separator from the block before.

    The items of a list are numbered from its start, one more for each that is not empty.
    """
    out, before, numbers = [], None, {}
    for block in blocks:
        text = block["text"]
        if text is None:
            text = _inline(block["pieces"], links)
            text = f"{'#' * block['level']} {text}" if text and block["type"] == "heading" else text
        if not _EDGES.sub("", text):
            continue
        levels = []
        for c in block["chain"]:
            last, number = numbers.get(c["pos"], (None, c["start"] - 1))
            number += last != c["item"]
            numbers[c["pos"]] = (c["item"], number)
            levels.append((c["kind"], c["pos"], c["item"], {"ol": f"{number}. ", "ul": "- "}.get(c["kind"], "> ")))
        shared = 0
        while before is not None and shared < min(len(levels), len(before)) and levels[shared] == before[shared]:
            shared += 1
        lines = "\n".join(_quoted(levels, line, shared, i == 0) for i, line in enumerate(text.split("\n")))
        # items of one list, and a list inside an item, follow directly; anything else after a blank line
        here = levels[shared] if shared < len(levels) else None
        next_item = here and before and shared < len(before) and here[1] == before[shared][1]
        inner_list = here and shared and "blockquote" not in (levels[shared - 1][0], here[0])
        gap = "" if before is None else "\n" if next_item or inner_list else f"\n{_quoted(levels[:shared], '', shared, False)}\n"
        out.append((block["pos"], block["type"], text, gap + lines))
        before = levels
    return out


_LINES = "array<struct<pos: int, type: string, text: string, piece: string>>"


def _readied(blocks: str, base: str, images: bool) -> str:
    """Blocks with the text of every piece, and of what is read whole."""
    whole = lambda b: case(
        (f"{b}.type = 'code-block'", render_code(f"{b}.raw")), (f"{b}.type = 'table'", render_table(f"{b}.raw")),
        (f"{b}.type = 'hr'", "'---'"), (f"{b}.type = 'figure'", render_figure(f"{b}.raw", base) if images else "''"))
    text = lambda p: struct(kind=f"{p}.kind", text=f"coalesce({inline_piece(f'{p}.kind', f'{p}.tok', base, images)}, '')")
    return each(blocks, lambda b: struct(
        pos=f"{b}.pos", type=f"{b}.type", level=f"{b}.level", text=whole(b), pieces=each(f"{b}.pieces", text), chain=f"{b}.chain"))


def _with_lines(pages: DataFrame, links: bool, images: bool) -> DataFrame:
    """Pages with `_lines`, the rendered blocks, in place of `_blocks` and `base`."""
    ready = pages.selectExpr(*[c for c in pages.columns if c not in ("_blocks", "base")], f"{_readied('_blocks', 'base', images)} AS _ready")
    return folded(ready, "_ready", _lines=(lambda blocks: _nested(blocks, links), _LINES))


def _of_pages(blocks: DataFrame) -> DataFrame:
    """Rows of blocks back in one row per page."""
    fields = "pos, type, level, raw, pieces, chain"
    return blocks.groupBy("page_id").agg(F.expr(f"array_sort(collect_list(struct({fields})))").alias("_blocks"), F.first("base").alias("base"))


def render_blocks(blocks: DataFrame, links: bool = True, images: bool = True) -> DataFrame:
    """(page_id, pos, type, text, piece): each block's own Markdown, and as it stands in the document, with the markers of the lists and
    quotes around it and the gap to the block before."""
    return explode_items(_with_lines(_of_pages(blocks), links, images), "_lines", index="_at").drop("_at")


def header_columns(markup: str = "markup") -> list[str]:
    """title (first h1, else the title) and description of a page."""
    h1 = f"get(filter({heading_array(markup)}, h -> h.level = 1), 0).text"
    return [f"coalesce(nullif({h1}, ''), {squish(f'get({title_array(markup)}, 0)')}, '') AS title",
            let(meta_array(markup), lambda m: f"coalesce({js_trim(f'get({meta_matches(m, 'description')}, 0).content')}, '')") + " AS description"]


def page_headers(parsed: DataFrame) -> DataFrame:
    """(page_id, url, title, description)."""
    return parsed.selectExpr("page_id", "url", *header_columns())


def _documents(rows: DataFrame, front_matter: bool) -> DataFrame:
    quote = lambda c: f"concat('\"', replace({c}, '\"', {lit(chr(92) + chr(34))}), '\"')"
    line = lambda name, c: f"if(coalesce({c}, '') = '', NULL, concat('{name}: ', {quote(c)}))"
    captured = [line("captured", "CAST(captured_at AS STRING)")] if "captured_at" in rows.columns else []
    matter = (f"concat_ws('\\n', '---', concat('title: ', {quote('title')}), {line('source', 'url')}, "
              f"{', '.join([line('description', 'description'), *captured])}, '---')")
    opening = "get(filter(_lines, x -> x.type <> 'figure'), 0)"
    opens = (f"{opening}.type = 'heading' AND lower(regexp_replace({opening}.text, '^#+ ', '')) = "
             f"lower({js_trim(markdown_escape('title'))})")
    lead = matter if front_matter else (
        f"if(title <> '' AND NOT coalesce({opens}, false), concat('# ', {markdown_escape('title')}), NULL)")
    body = "nullif(array_join(_lines.piece, ''), '')"
    whole = let(f"concat_ws('\\n\\n', {lead}, {body})", lambda t: case(
        (f"{t} = ''", "''"), otherwise=f"concat({js_trim(f'regexp_replace({t}, {lit(chr(10) + '{3,}')}, {lit(chr(10) * 2)})')}, '\\n')"))
    return rows.selectExpr("page_id", "url", f"{whole} AS markdown")


def page_markdown(parsed: DataFrame, links: bool = True, images: bool = True, front_matter: bool = False) -> DataFrame:
    """(page_id, url, markdown): title unless the text opens with it, blocks, one newline at the end; '' if empty.

    A page stays one row from its html to its document: nothing is shuffled, and streams run in append mode.
    """
    carried = ["page_id", "url", *(["captured_at"] if "captured_at" in parsed.columns else [])]
    pages = parsed.selectExpr(*carried, "base", "markup", *header_columns())
    pages = folded(pages, "markup", _blocks=(blocks_of, BLOCKS))
    return _documents(_with_lines(pages, links, images), front_matter)


def render_markdown(blocks: DataFrame, headers: DataFrame, links: bool = True, images: bool = True,
                    front_matter: bool = False) -> DataFrame:
    """As `page_markdown`, from rows of blocks, which may have been filtered or changed."""
    lines = _with_lines(_of_pages(blocks), links, images)
    return _documents(headers.join(lines, "page_id", "left"), front_matter)
