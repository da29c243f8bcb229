"""Literals, one-time evaluation and small helpers for expression text."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import count

_names = count()
_NAME = re.compile(r"(?!(?i:null|true|false)\Z)[A-Za-z_]\w*(?:\.\w+)*\Z")


def lit(value: str | int | float | bool | None) -> str:
    """A SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{escaped}'"


def fresh(prefix: str = "v") -> str:
    """A lambda variable name no other expression uses."""
    return f"{prefix}_{next(_names)}"


def each(array: str, body: Callable[[str], str]) -> str:
    x = fresh()
    return f"transform({array}, {x} -> {body(x)})"


def keep(array: str, test: Callable[[str], str]) -> str:
    x = fresh()
    return f"filter({array}, {x} -> {test(x)})"


def any_of(array: str, test: Callable[[str], str]) -> str:
    x = fresh()
    return f"exists({array}, {x} -> {test(x)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate `value` once and use it many times inside `body`. A column, field or variable is there already."""
    return body(value) if _NAME.match(value) else f"get({each(f'array({value})', body)}, 0)"


def matches(text: str, pattern: str) -> str:
    return f"rlike({text}, {lit(pattern)})"


def extract(text: str, pattern: str, group: int = 0) -> str:
    """First match, '' when there is none."""
    return f"regexp_extract({text}, {lit(pattern)}, {group})"


def extract_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


def substitute(text: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)})"


def case(*branches: tuple[str, str], otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN {c} THEN {r}" for c, r in branches)
    return f"(CASE {whens}{f' ELSE {otherwise}' if otherwise is not None else ''} END)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def constant_map(entries: dict[str, str]) -> str:
    """A constant map as one small expression; the optimizer folds it to a literal."""
    packed = "\x02".join(f"{k}\x01{v}" for k, v in entries.items())
    return f"str_to_map({lit(packed)}, {lit(chr(2))}, {lit(chr(1))})"


def in_list(text: str, values) -> str:
    return f"{text} IN ({', '.join(lit(v) for v in values)})"
