"""JSON texts of any depth: one scan over the tokens builds the value, one walk over it gives every leaf or object once, with its path.

Order keys sort as text in document order: each step is the length of its index, then the index. Neither scan nor walk recurses. Of a
repeated key the last value counts, where the first one stands.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from crawlsift.functions.text import WHITESPACE

_TOKEN = re.compile(r'[\[\]{}:,]|"(?:[^"\\]|\\.)*"|[^\s\[\]{}:,"]+', re.DOTALL)
_BLANK = re.compile(rf"[{WHITESPACE}]*\Z")
_ZEROS = re.compile(r"(-?[0-9]+)\.0+\Z")
_TAIL = re.compile(r"(-?[0-9]+\.[0-9]*[1-9])0+\Z")
#: Rows of the walks, as Spark has them.
LEAVES = "array<struct<ord: string, path: string, value: string>>"
ENTITIES = "array<struct<level: int, path: string, ord: string, types: array<string>, filled: array<string>, raw: string>>"


class Items(dict):
    """An object or array (then keyed by position) with its place in the text."""

    __slots__ = ("listed", "start", "end")

    def __init__(self, listed: bool, start: int):
        self.listed, self.start, self.end = listed, start, start


def parsed(text: str) -> Items | str | None:
    """The value of a JSON text: its items, or a scalar as its token. None where brackets do not pair or something is left over."""
    top = Items(True, 0)
    stack, key, comma = [top], None, False
    for m in _TOKEN.finditer(text):
        token, into = m[0], stack[-1]
        if token == ",":
            if comma or key is not None or into is top or not into:
                return None
            comma = True
            continue
        if token == ":":
            continue
        if token in "]}":
            if into is top or into.listed != (token == "]") or key is not None or comma:
                return None
            stack.pop().end = m.end()
            continue
        if not into.listed and key is None:
            if token[0] != '"':
                return None
            key = json.loads(token, strict=False)
            continue
        value = Items(token == "[", m.start()) if token in "[{" else token
        into[len(into) if into.listed else key] = value
        key, comma = None, False
        if isinstance(value, Items):
            stack.append(value)
    return top[0] if len(stack) == 1 and len(top) == 1 else None


def scalar(token: str) -> str:
    """Text of a scalar: a string's own, a number as a browser prints it."""
    return json.loads(token, strict=False) if token[0] == '"' else _TAIL.sub(r"\1", _ZEROS.sub(r"\1", token))


def below(order: str, index: int) -> str:
    digits = str(index)
    return f"{order}{len(digits)}{digits}/"


def _cut(text: str, n: int) -> str:
    """At most n UTF-16 units, then an ellipsis."""
    if len(text) + sum(c > "￿" for c in text) <= n:
        return text
    units = 0
    for i, c in enumerate(text):
        if units >= n:
            return text[:i] + "…"
        units += 2 if c > "￿" else 1
    return text + "…"


def leaves_of(text: str, max_depth: int | None = None, clean: bool = False) -> Iterator[tuple[str, str, str]]:
    """(ord, path, value) of every leaf; empty containers are leaves. Below `max_depth`, where one is given, stands [Depth limit]; `clean`
    also caps what one entry may hold: 2000 characters per text, 500 items per array (then `[n more]`), 200 keys per object."""
    root = parsed(text)
    if root is None:
        return
    show = (lambda t: _cut(scalar(t), 2000) if t[0] == '"' else scalar(t)) if clean else scalar
    stack = [("", "", root, 0)]
    while stack:
        order, path, node, depth = stack.pop()
        if isinstance(node, str):
            yield order, path, show(node) if depth else scalar(node)
        elif not node:
            yield order, path, "[]" if node.listed else "{}"
        elif max_depth is not None and depth >= max_depth:
            yield order, path, "[Depth limit]"
        else:
            items = list(node.items())
            more = len(items) - (500 if node.listed else 200) if clean else 0
            items = items[:-more] if more > 0 else items
            # top-level array items are plain numbers, deeper ones are bracketed
            step = (lambda k: f"{path}[{k}]" if path else str(k)) if node.listed else (lambda k: f"{path}.{k}" if path else k)
            if more > 0 and node.listed:
                yield below(order, 500), step(500), f"[{more} more]"
            stack.extend((below(order, i), step(k), v, depth + 1) for i, (k, v) in reversed(list(enumerate(items))))


def has_value(node: Items | str) -> bool:
    """Present and carrying something: not null, blank text, [] or {}. Numbers and booleans count."""
    return bool(node) if isinstance(node, Items) else node != "null" and not (node[0] == '"' and _BLANK.match(scalar(node)))


def entities_of(text: str, max_depth: int | None = None, raw: bool = True) -> Iterator[tuple]:
    """(level, path, ord, types, filled, raw) of every object with an @type. An array contributes its items, an @graph its members and
    nothing else of that object, other objects themselves and what their keys without @ hold. `filled` names the keys that carry a
    value; `raw` is the object's own text."""
    root = parsed(text)
    stack = [("", "", root, 0)] if isinstance(root, Items) else []
    while stack:
        order, path, node, level = stack.pop()
        if max_depth is not None and level > max_depth:
            continue
        graph = None if node.listed else node.get("@graph")
        if node.listed:
            inside = [(f"{path}[{i}]", i, v) for i, v in node.items()]
        elif isinstance(graph, Items) and graph.listed:
            inside = [(f"{path}@graph[{i}]", i, v) for i, v in graph.items()]
        else:
            kind = node.get("@type", "null")
            named = [kind] if isinstance(kind, str) else list(kind.values()) if kind.listed else []
            types = [scalar(t) for t in named if isinstance(t, str) and t != "null"]
            if types:
                yield level, path, order, types, [k for k, v in node.items() if has_value(v)], text[node.start : node.end] if raw else None
            inside = [(f"{path}.{k}", i, v) for i, (k, v) in enumerate(node.items()) if not k.startswith("@")]
        stack.extend((below(order, i), p, v, level + 1) for p, i, v in reversed(inside) if isinstance(v, Items))
