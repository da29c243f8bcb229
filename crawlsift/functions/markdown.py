"""Markdown expressions: escaping, code spans, link targets, whole blocks."""

from __future__ import annotations

from crawlsift.extract.markup import attr_or, tags, text_content
from crawlsift.functions.sql import case, each, extract, extract_all, keep, let, lit, matches, substitute
from crawlsift.functions.text import WS, collapse, decode_entities, js_trim, squish
from crawlsift.functions.urls import absolute_or

# The marks of inline elements.
MARKS = {"strong": "**", "em": "*", "strike": "~~"}


def markdown_escape(text: str) -> str:
    """Backslashes where text would be read as Markdown, also at the start of a line."""
    inline = substitute(text, r"([\\`*_\[\]<>])", r"\\$1")
    # * and > are escaped already by the first rule
    symbol = substitute(inline, rf"^({WS}*)([-+#])(?={WS})", r"$1\\$2")
    return substitute(symbol, rf"^({WS}*[0-9]+)([.)])(?={WS})", r"$1\\$2")


def _fence(text: str, pattern: str, least: int) -> str:
    runs = each(extract_all(text, pattern), lambda r: f"length({r})")
    return f"repeat('`', coalesce(array_max(concat({runs}, array({least}))), {least}) + 1)"


def inline_code(text: str) -> str:
    def wrap(t: str) -> str:
        pad = case((f"startswith({t}, '`') OR endswith({t}, '`')", "' '"), otherwise="''")
        return case((f"{t} = ''", "''"), otherwise=let(_fence(t, "`+", 0), lambda f: f"concat({f}, {pad}, {t}, {pad}, {f})"))

    return let(squish(text), wrap)


def link_target(url: str) -> str:
    return let(js_trim(url), lambda u: case((matches(u, rf"[()]|{WS}"), f"concat('<', {u}, '>')"), otherwise=u))


def image_markdown(alt: str, src: str) -> str:
    return case((f"coalesce({src}, '') = ''", "''"),
                otherwise=f"concat('![', {markdown_escape(alt)}, '](', {link_target(src)}, ')')")


def inline_piece(kind: str, tok: str, base: str, images: bool = True) -> str:
    """What one piece of a block contributes: escaped text, a code span, a picture, or where a link leads."""
    picture = image_markdown(js_trim(attr_or(tok, "alt")), absolute_or(base, attr_or(tok, "src"), "empty")) if images else "''"
    return case(
        (f"{kind} = 'text'", markdown_escape(collapse(decode_entities(tok)))), (f"{kind} = 'code'", inline_code(decode_entities(tok))),
        (f"{kind} = 'img'", picture), (f"{kind} = '+a'", link_target(absolute_or(base, attr_or(tok, "href"), "empty"))), otherwise="''")


def code_language(markup: str) -> str:
    """Language named by the class of the code element, or of the pre around it."""
    klass = lambda tag: attr_or(f"get({tags(markup, tag)}, 0)", "class")
    return f"lower({extract(f'concat({klass('code')}, {lit(' ')}, {klass('pre')})', '(?i)(?:language|lang|highlight)-([a-z0-9+#-]+)', 1)})"


def render_code(markup: str) -> str:
    code = f"coalesce(nullif({extract(markup, r'(?is)<code(?:\s[^>]*)?>(.*?)</code', 1)}, ''), {markup})"
    return let(substitute(text_content(code), rf"{WS}(?<!{WS}{{2}}){WS}*+\z"), lambda t: case(
        (f"{js_trim(t)} = ''", "''"), otherwise=let(_fence(t, "`{3,}", 2), lambda f: (
            f"concat({f}, {code_language(markup)}, '\\n', {t}, '\\n', {f})"))))


def render_table(markup: str) -> str:
    """Pipe table as wide as its widest row; the first row is the head."""
    cut = lambda text, tag: keep(f"split({text}, {lit(rf'(?i)(?=<(?:{tag})[\s>])')})",
                                 lambda p: matches(p, rf"(?i)^<(?:{tag})[\s>]"))
    cell = lambda c: js_trim(f"replace({markdown_escape(collapse(text_content(c)))}, '|', {lit(chr(92) + '|')})")
    grid = each(cut(markup, 'tr'), lambda r: each(cut(r, 'td|th'), cell))

    def lines(g: str) -> str:
        width = f"array_max({each(g, lambda r: f'size({r})')})"

        def build(w: str) -> str:
            line = lambda r: f"concat('| ', array_join(concat({r}, array_repeat('', {w} - size({r}))), ' | '), ' |')"
            rule = f"concat('| ', array_join(array_repeat('---', {w}), ' | '), ' |')"
            return case((f"coalesce({w}, 0) = 0", "''"), otherwise=(
                f"array_join(concat(array({line(f'get({g}, 0)')}, {rule}), {each(f'slice({g}, 2, size({g}))', line)}), '\\n')"))

        return let(width, build)

    return let(grid, lines)


def render_figure(markup: str, base: str) -> str:
    img = f"get({tags(markup, 'img')}, 0)"
    picture = image_markdown(js_trim(attr_or(img, "alt")), absolute_or(base, attr_or(img, "src"), "empty"))
    caption = squish(text_content(extract(markup, r"(?is)<figcaption(?:\s[^>]*)?>.*?(?=</figcaption|\z)")))
    return let(caption, lambda c: case((f"{c} = ''", picture), otherwise=(
        f"concat({picture}, '\\n\\n*', {markdown_escape(c)}, '*')")))
