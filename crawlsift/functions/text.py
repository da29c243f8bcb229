"""Text expressions with browser string semantics (UTF-16 lengths, Unicode whitespace)."""

from __future__ import annotations

from html.entities import name2codepoint

from crawlsift.functions.sql import case, constant_map, each, extract, extract_all, keep, let, lit, substitute

# What a browser treats as whitespace (plain \s in Java misses the Unicode spaces and the BOM).
WHITESPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# the same set for Java, which tries the parts of a class one by one: letters are done after three
WS = r"[\x09-\x0d \u00a0[\u1680-\ufeff&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]"
_WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ELLIPSIS = "\u2026"
FILLER = "\ue000"
# a map is searched from its start
_FREQUENT = "amp nbsp quot lt gt apos mdash ndash hellip rsquo lsquo rdquo ldquo copy reg trade raquo laquo bull middot times euro".split()


def collapse(text: str) -> str:
    """Every run of whitespace becomes one space."""
    return substitute(text, WS + "+", " ")


def js_trim(text: str) -> str:
    """Trim all Unicode whitespace, not only spaces. No pattern: it would be tried at every character."""
    return f"trim(BOTH {lit(_WS_CHARS)} FROM {text})"


def squish(text: str) -> str:
    return f"trim({collapse(text)})"


def js_length(text: str) -> str:
    """Length in UTF-16 code units."""
    return f"CAST(octet_length(encode({text}, 'UTF-16LE')) / 2 AS INT)"


def js_cut(text: str, n: int, mark: str = ELLIPSIS) -> str:
    """At most n UTF-16 units, then `mark`. A filler after each astral character makes it count as two."""
    doubled = substitute(text, r"([\x{10000}-\x{10ffff}])", "$1" + FILLER)
    return f"replace({substitute(doubled, rf'(?s)^(.{{{n}}}).+\z', '$1' + mark)}, {lit(FILLER)}, '')"


def clip(text: str, n: int | None, blank: str = "keep") -> str:
    """Squish, then cut to n units plus an ellipsis; whole where n is None. Blank text: '' ('keep') or NULL ('null'); 'empty' also turns
    NULL into ''."""
    cut = squish(text) if n is None else js_cut(squish(text), n)
    if blank == "null":
        return let(cut, lambda x: case((f"{x} <> ''", x)))
    return f"coalesce({cut}, '')" if blank == "empty" else cut


def nonblank(text: str) -> str:
    """The trimmed text, NULL when nothing is left."""
    return let(js_trim(text), lambda x: case((f"{x} <> ''", x)))


def text_or_empty(text: str) -> str:
    return f"coalesce({js_trim(text)}, '')"


def either(*values: str) -> str:
    """First value that is neither NULL nor ''; '' when there is none."""
    return "coalesce(" + ", ".join(f"nullif({v}, '')" for v in values) + ", '')"


def normalise_alnum(text: str) -> str:
    return substitute(f"lower({text})", "[^a-z0-9]+")


def _code_point(cp: str) -> str:
    # References 128-159 mean their Windows-1252 characters.
    legacy = constant_map({str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)})
    return case(
        (f"{cp} IS NULL OR {cp} = 0 OR {cp} > 1114111 OR {cp} BETWEEN 55296 AND 57343", lit("\ufffd")),
        (f"{cp} BETWEEN 128 AND 159", f"try_element_at({legacy}, CAST({cp} AS STRING))"),
        otherwise=f"decode(unhex(lpad(hex({cp}), 8, '0')), 'UTF-32')")


def decode_entities(text: str) -> str:
    """Character references to characters, in one pass (so `&amp;lt;` stays `&lt;`)."""
    codes = {**name2codepoint, "apos": 39}
    named = constant_map({name: chr(codes[name]) for name in [*_FREQUENT, *(n for n in codes if n not in _FREQUENT)]})

    def piece(p: str) -> str:
        decimal = f"try_cast({extract(p, '^&#([0-9]+)', 1)} AS INT)"
        hexa = f"try_cast(conv({extract(p, '^&#[xX]([0-9A-Fa-f]+)', 1)}, 16, 10) AS INT)"
        return case(
            (f"NOT startswith({p}, '&')", p),
            (f"startswith({p}, '&#')", let(f"coalesce({decimal}, {hexa})", _code_point)),
            otherwise=f"coalesce(try_element_at({named}, {extract(p, '^&([A-Za-z0-9]+);$', 1)}), {p})")

    pieces = lambda t: extract_all(t, "&(?:#[0-9]{1,7};?|#[xX][0-9A-Fa-f]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)|[^&]++|&")
    return let(text, lambda t: case((f"contains({t}, '&')", f"array_join({each(pieces(t), piece)}, '')"), otherwise=t))


def first_n(array: str, n: int | None) -> str:
    """First n elements of an array; all of them when n is None."""
    return array if n is None else f"slice({array}, 1, {n})"


def map_get(values: str, key: str) -> str:
    """Map lookup with '' for a missing key; `key` is an expression."""
    return f"coalesce(try_element_at({values}, {key}), '')"


def count_words(text: str) -> str:
    return f"size({keep(f'split({text}, {lit(WS + chr(43))})', lambda w: f'{w} <> {lit(str())}')})"


def contains_ci(text: str, needle: str) -> str:
    return f"contains(lower({text}), {lit(needle.lower())})"


