"""RFC 4180 fields and lines, guarded against formulas."""

from __future__ import annotations

from crawlsift.functions.sql import case, let, lit, matches
from crawlsift.functions.text import WS

BOM = "\ufeff"


def csv_field(value: str, delimiter: str = ",") -> str:
    """NULL is ''; text that a spreadsheet would run as a formula gets an apostrophe; quotes where needed."""
    guarded = let(f"CAST({value} AS STRING)", lambda v: case(
        (matches(v, r"^[=+\-@\t\r]"), f"concat(\"'\", {v})"), otherwise=v))
    must_quote = lambda f: (
        f"contains({f}, {lit(delimiter)}) OR " + matches(f, rf'["\r\n]|^{WS}|{WS}\z'))
    quoted = let(guarded, lambda f: case((must_quote(f), f"concat('\"', replace({f}, '\"', '\"\"'), '\"')"), otherwise=f))
    return f"coalesce({quoted}, '')"


def csv_line(columns: list[str], delimiter: str = ",") -> str:
    return f"concat_ws({lit(delimiter)}, {', '.join(csv_field(c, delimiter) for c in columns)})"
