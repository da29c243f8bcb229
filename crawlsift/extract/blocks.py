"""Readable blocks of a page: the content root, then flat leaf blocks with the lists and quotes around them.

Both are found by one walk over the page's tags (see `folds`), in the page's row: nothing is shuffled, any depth of lists, quotes and
marks is kept, and the same code runs on a stream in append mode.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from crawlsift.extract.facts import explode_items
from crawlsift.extract.folds import Token, attribute, closes, folded, tokens_of

# Elements that are never read, elements that flow inside a line, roots in order of preference.
SKIPPED = ("script style noscript template iframe canvas svg form button select textarea input label nav header footer "
           "aside dialog video audio object embed map").split()
INLINE = ("a abbr b bdi bdo br cite code data dfn em i img kbd mark q rp rt ruby s samp small span strong sub sup time u "
          "var wbr font del").split()
ROOTS = ["article", "main", "[role=main]", "#content", ".post", "body"]
#: Text that a root must hold, in characters.
ROOT_TEXT = 200
_FORMATS = {"strong": "strong", "b": "strong", "em": "em", "i": "em", "s": "strike", "del": "strike",
            "code": "code", "kbd": "code", "samp": "code", "a": "a"}
_SKIPPED, _INLINE = frozenset(SKIPPED), frozenset(INLINE)
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_START = re.compile(r"\s*([+-]?[0-9]{1,9})\s*\Z")

BLOCKS = ("array<struct<pos: int, type: string, level: int, raw: string, pieces: array<struct<kind: string, tok: string>>, "
          "chain: array<struct<kind: string, pos: int, start: int, item: int>>>>")


def _rank(tag: str, name: str) -> int | None:
    if name in ("article", "main", "body"):
        return ROOTS.index(name)
    if "role" in tag and attribute(tag, "role") == "main":
        return 2
    if "content" in tag and attribute(tag, "id") == "content":
        return 3
    return 4 if "post" in tag and "post" in (attribute(tag, "class") or "").split() else None


def _root(tokens: list[Token], ends: list[int]) -> tuple[int, int, int] | None:
    """(rank, first, end) of the first candidate of each rank that holds enough text, else of the body."""
    first: dict[int, int] = {}
    seen = [0]
    for pos, (text, name, closing) in enumerate(tokens):
        seen.append(seen[-1] if name else seen[-1] + len(text.strip(" ")))
        if name and not closing:
            rank = _rank(text, name)
            if rank is not None:
                first.setdefault(rank, pos)
    for rank, pos in sorted(first.items()):
        if rank == 5 or seen[min(ends[pos] + 1, len(tokens))] - seen[pos + 1] > ROOT_TEXT:
            return rank, pos, ends[pos]
    return None


def _hidden(tag: str) -> bool:
    low = tag.lower()
    return ("hidden" in low and (attribute(tag, "hidden") is not None or attribute(tag, "aria-hidden") == "true")
            or "style" in low and bool(_UNSEEN.search(attribute(tag, "style") or "")))


def _read(tokens: list[Token], ends: list[int], first: int, end: int) -> list[int]:
    """Positions between the root's tags without what is hidden or never read."""
    read, pos = [], first
    while pos < end:
        text, name, closing = tokens[pos]
        if name and not closing and (name in _SKIPPED or _hidden(text)):
            pos = ends[pos]
        else:
            read.append(pos)
        pos += 1
    return read


def blocks_of(markup: str) -> list[tuple]:
    """Blocks of the page. A block's pieces are its texts and pictures, and the marks that open and close in it; marks that an earlier
    block left open come first."""
    tokens = tokens_of(markup)
    ends = closes(tokens)
    root = _root(tokens, ends)
    read = _read(tokens, ends, root[1] + 1 if root else 0, root[2] if root else len(tokens))
    pictures = sorted(p for p in read if tokens[p][1] == "img")
    pictured = lambda pos: any(pos < p < ends[pos] for p in pictures)
    depth = dict.fromkeys(("strong", "em", "strike", "code", "a"), 0)
    lists: list[list] = []
    out: list[dict] = []
    link, whole_until, in_whole = "", -1, False

    def begin(pos: int, name: str, opens: bool) -> dict:
        heading = opens and len(name) == 2 and name[0] == "h" and name[1] in "123456"
        kind = "heading" if heading else "hr" if name == "hr" else "paragraph"
        carried = [(f"+{f}", "") for f in ("strong", "em", "strike") for _ in range(depth[f])]
        carried += [("+a", link)] * (depth["a"] > 0) + [("code", "")] * (depth["code"] > 0)
        return {"pos": pos, "type": kind, "level": int(name[1]) if heading else None, "raw": [], "pieces": carried, "chain": []}

    for pos in read:
        text, name, closing = tokens[pos]
        opens = bool(name) and not closing
        if pos <= whole_until:
            out[-1]["raw"].append(text)
            in_whole = True
            continue
        if not out or in_whole or name and name not in _INLINE:
            out.append(begin(pos, name, opens))
        in_whole, block = False, out[-1]
        if opens and (name in ("pre", "table") or name == "figure" and pictured(pos)):  # read whole
            whole_until = ends[pos]
            block["type"], block["raw"] = {"pre": "code-block"}.get(name, name), [text]
        if name in ("ul", "ol", "blockquote"):
            if opens:
                start = _START.match(attribute(text, "start") or "") if name == "ol" else None
                lists.append([name, pos, int(start[1]) or 1 if start else 1, 0])
            elif lists:
                lists.pop()
        elif name == "li" and opens and lists:
            lists[-1] = [*lists[-1][:3], lists[-1][3] + 1]
        block["chain"] = block["chain"] if not name or name in _INLINE else [tuple(level) for level in lists]
        mark, pieces = _FORMATS.get(name), block["pieces"]
        before = depth[mark] if mark else 0
        if mark:
            depth[mark] = before + 1 if opens else max(0, before - 1)
        if mark == "a" and opens:
            link = text
        if mark == "code":
            if opens and not before:
                pieces.append(("code", ""))
        elif depth["code"]:
            if not name and pieces and pieces[-1][0] == "code":
                pieces[-1] = ("code", pieces[-1][1] + text)
        elif not name:
            pieces.append(("text", text))
        elif name in ("br", "img"):
            pieces.append((name, text))
        elif mark and (opens or before):
            pieces.append((f"+{mark}" if opens else f"-{mark}", text if mark == "a" and opens else ""))
    found = []
    for b in out:
        raw = "".join(b["raw"]) if b["raw"] else None
        if b["type"] in ("code-block", "table", "figure", "hr") or any(k in ("img", "text", "code") and t.strip() for k, t in b["pieces"]):
            found.append((b["pos"], b["type"], b["level"], raw, [] if raw else b["pieces"], b["chain"]))
    return found


def root_of(markup: str) -> str:
    tokens = tokens_of(markup)
    root = _root(tokens, closes(tokens))
    return ROOTS[root[0]] if root else "body"


def select_content_root(parsed: DataFrame) -> DataFrame:
    """(page_id, root): the selector whose first match holds the page's text."""
    return folded(parsed.select("page_id", "markup"), "markup", root=(root_of, "string"))


def extract_blocks(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    """blocks(page_id, base, pos, type, level, raw, pieces, chain).

    `type` is heading, paragraph, code-block, table, figure or hr. `pieces` are the texts, pictures and marks of a heading or paragraph
    as the page has them, `raw` the markup of code, tables and figures. `chain` lists the quotes and lists around the block, outermost
    first: ARRAY<STRUCT<kind, pos, start, item>>. `cap` keeps a page's first blocks only.
    """
    rows = folded(parsed.select("page_id", "base", "markup"), "markup", _blocks=(blocks_of, BLOCKS))
    array = "_blocks" if cap is None else f"slice(_blocks, 1, {cap})"
    return explode_items(rows, array, ["page_id", "base"], index="_at").drop("_at")
