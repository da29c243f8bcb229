"""Folds over a page's own tags, in the page's row.

What depends on the elements around a tag needs a stack, which neither an expression nor a window can carry without moving the page. A
fold walks the canonical markup (every `<` starts a tag) once, in Arrow batches, and says only how the page is built: which text lies
where, and what is around it. Reading, escaping, resolving and judging stay Spark expressions on what a fold returns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pages that a task holds as Python objects at a time.
ROWS = 64

#: Elements that hold nothing, and those that may be left unclosed.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
IMPLIED_END = frozenset("p li dt dd td th tr option".split())
_TOKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)[^>]*>|[^<]+")
_ATTRIBUTE = re.compile(r"""(?<=[\s/"'])([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))?)?""")

Token = tuple[str, str, bool]


def tokens_of(markup: str) -> list[Token]:
    """(text, lower-case tag name or '', closing) of every tag and text, in order."""
    return [(m[0], m[2].lower() if m[2] else "", m[1] == "/") for m in _TOKEN.finditer(markup)]


def attribute(tag: str, name: str) -> str | None:
    """Value of an attribute of an open tag, decoded; None when absent. The first of a repeated name wins."""
    for m in _ATTRIBUTE.finditer(tag, 1):
        if m[1].lower() == name:
            return html.unescape(m[2] or m[3] or m[4] or "")
    return None


def closes(tokens: list[Token]) -> list[int]:
    """Where each open tag's element ends: its own close tag, or the end of the page; void elements and other tokens end where they are.

    An element that may be left unclosed ends at its next sibling when the page does not balance it; no unclosed element goes on beyond
    the one around it.
    """
    ends, open_, surplus = list(range(len(tokens))), {}, {}
    for pos, (_, name, closing) in enumerate(tokens):
        if not name or name in VOID:
            continue
        surplus[name] = surplus.get(name, 0) + (-1 if closing else 1)
        stack = open_.setdefault(name, [])
        if not closing:
            ends[pos] = len(tokens)
            stack.append(pos)
        elif stack:
            ends[stack.pop()] = pos
    loose = {name for name in IMPLIED_END if surplus.get(name)}
    if loose:
        last: dict[str, int] = {}
        for pos in range(len(tokens) - 1, -1, -1):
            name = tokens[pos][1]
            if name in loose:
                if not tokens[pos][2]:
                    ends[pos] = last.get(name, len(tokens))
                last[name] = pos
    around: list[int] = []
    for pos, (_, name, closing) in enumerate(tokens):
        while around and around[-1] <= pos:
            around.pop()
        if not name or closing or name in VOID:
            continue
        end, limit = ends[pos], around[-1] if around else len(tokens)
        if end < len(tokens) and tokens[end][1:] == (name, True):
            around.append(min(end, limit))
        else:
            ends[pos] = min(end, limit)
    return ends


def folded(df: DataFrame, source: str, **targets: tuple[Callable, str]) -> DataFrame:
    """df with what each target's function makes of a value of `source`, in place of that column; NULL stays NULL.

    An operator of its own rather than a column function, so that the markup is computed once, below it.
    """
    kept = [c for c in df.columns if c != source]
    kinds = StructType.fromDDL(", ".join(f"`{name}` {ddl}" for name, (_, ddl) in targets.items()))
    arrow, ones = [f.type for f in to_arrow_schema(kinds)], [one for one, _ in targets.values()]
    schema = StructType([*(df.schema[c] for c in kept), *kinds])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                values = batch.column(source).to_pylist()
                made = [pa.array([None if v is None else one(v) for v in values], kind) for one, kind in zip(ones, arrow)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=schema.names)

    return df.mapInArrow(run, schema)
