"""Nesting of any depth, found in the page's row: no exchange, no window, the same on a stream."""

import random
import re

import pytest

from crawlsift.extract.blocks import extract_blocks, select_content_root
from crawlsift.extract.folds import attribute, closes, tokens_of
from crawlsift.extract.markup import parse_pages
from crawlsift.extract.tables import extract_tables, page_tables
from crawlsift.operators import tables as T
from crawlsift.operators.markdown import page_headers, page_markdown, render_blocks, render_markdown


def markdown(page, *html, **options):
    rows = page_markdown(parse_pages(page(*html)), **options).orderBy("page_id").collect()
    return [r.markdown for r in rows]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_closes_pair_with_their_opens():
    tokens = tokens_of("<div><p>a<p>b<div></div><br></div><ul><li>1<ul><li>2</ul><li>3</ul></p><i>")
    ends = closes(tokens)
    of = {i: (text, ends[i]) for i, (text, name, closing) in enumerate(tokens) if name and not closing}
    assert of[0] == ("<div>", 8) and of[5] == ("<div>", 6) and of[7] == ("<br>", 7)
    assert of[1] == ("<p>", 3) and of[9][0] == "<ul>" and tokens[of[9][1]][0] == "</ul>"
    assert of[len(tokens) - 1] == ("<i>", len(tokens))


def test_attributes_of_a_tag():
    tag = "<a class=\"x class='no'\" CLASS=second data-id=7 id = 'q&amp;r' hidden href=/p>"
    assert [attribute(tag, n) for n in ("class", "id", "hidden", "href", "no", "data")] == ["x class='no'", "q&r", "", "/p", None, None]


def test_lists_of_any_depth_keep_their_levels(page):
    depth = 40
    got = markdown(page, "".join(f"<ul><li>l{i}" for i in range(depth)) + "</ul>" * depth)[0]
    assert got == "".join(f"{'  ' * i}- l{i}\n" for i in range(depth))
    quotes = markdown(page, "<blockquote>" * 30 + "deep" + "</blockquote>" * 30 + "<p>flat")[0]
    assert quotes == "> " * 30 + "deep\n\nflat\n"


def test_numbers_go_on_over_items_that_hold_more(page):
    html = ("<ol start=3><li>a<ul><li>x</ul><p>more</p></li><li> </li><li>b<pre>code</pre></li><li><ol><li>i<li>ii</ol></li></ol>"
            "<ol start=oops><li>n</ol>")
    assert markdown(page, html)[0] == (
        "3. a\n   - x\n\n   more\n4. b\n\n   ```\n   code\n   ```\n5. 1. i\n   2. ii\n\n1. n\n")


def test_empty_wrappers_vanish_at_any_depth(page):
    empty = "<b><i><s><a href=/x>" * 9 + " <br> " + "</a></s></i></b>" * 9
    assert markdown(page, f"<p>a{empty}b</p><p>{empty}</p>")[0] == "ab\n"
    nested = "<b> <i> <a href=/y> <s> x </s> </a> </i> </b>"
    assert markdown(page, f"<p>{nested}</p>")[0] == "***[~~x~~](https://example.com/y)***\n"


def test_marks_left_open_go_on_in_the_next_block(page):
    assert markdown(page, "<p>a <b>bold<p>still</b> not</p>")[0] == "a **bold**\n\n**still** not\n"
    assert markdown(page, "<p><b>x <i>y</b> z</i></p>")[0] == "**x *y*** *z*\n".replace("*** *z*", "****z*")
    assert markdown(page, "<p><a href=/1>one <a href=/2>two</a></p>")[0] == "[one](https://example.com/1)[two](https://example.com/2)\n"


def test_options_and_front_matter(page):
    html = '<title>T "q"</title><meta name=description content="D &amp; E"><body><p><a href=/l>l</a><img src=/i.png alt="[x]"></p><figure><img src=f.png alt=f><figcaption>Cap *</figcaption></figure>'
    full, bare = markdown(page, html), markdown(page, html, links=False, images=False)
    assert full[0] == '# T "q"\n\n[l](https://example.com/l)![\\[x\\]](https://example.com/i.png)\n\n![f](https://example.com/a/f.png)\n\n*Cap \\**\n'
    assert bare[0] == '# T "q"\n\nl\n'
    front = markdown(page, html, front_matter=True)[0]
    assert front.startswith('---\ntitle: "T \\"q\\""\nsource: "https://example.com/a/b?q=1"\ndescription: "D & E"\n---\n\n[l]')


def test_roots_by_text_and_rank(page):
    words = "word " * 60
    rows = select_content_root(parse_pages(page(
        f"<body><article>short</article><main>{words}</main>", f"<div role=main>{words}</div><div id=content>{words}</div>",
        f"<div class='a post b'>{words}</div><div class=posts>{words}", f"<p>{words}", f"<article>{words}"))).orderBy("page_id").collect()
    assert [r.root for r in rows] == ["main", "[role=main]", ".post", "body", "article"]


def test_rows_of_blocks_make_the_same_documents(page):
    p = parse_pages(page("<h1>T</h1><p>a<ul><li>b<li>c</ul><table><tr><td>1</table>", "", "<p>x"))
    rows = {r.page_id: r.markdown for r in render_markdown(extract_blocks(p), page_headers(p)).collect()}
    assert rows == {r.page_id: r.markdown for r in page_markdown(p).collect()} and rows[2] == ""
    pieces = render_blocks(extract_blocks(p).where("type <> 'table'")).where("page_id = 1").orderBy("pos").collect()
    assert "".join(r.piece for r in pieces) == "# T\n\na\n\n- b\n- c"
    assert extract_blocks(p, cap=1).count() == 2


def test_documents_and_grids_need_no_exchange(page):
    p = parse_pages(page("<table><tr><td>1</table>"))
    grids = T.grid_rows(page_tables(p))
    for df in (page_markdown(p), select_content_root(p), T.grid_cells(grids), T.grid_cells(T.trimmed_rows(grids)), T.grid_lines(grids), T.grid_measures(grids)):
        text = plan(df)
        assert "Exchange" not in text and "Window" not in text and text.count("Scan") == 1


def test_a_stream_of_pages_gives_the_same_documents(spark, page, tmp_path):
    pages = page("<h1>T</h1><p>a", "<ul><li>b<ul><li>c</ul></ul><table><tr><td rowspan=2>x<td>y<tr><td>z</table>")
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    for name, of in (("docs", page_markdown), ("grids", lambda p: T.grid_cells(T.grid_rows(page_tables(p))))):
        query = of(parse_pages(stream)).writeStream.format("memory").queryName(name).outputMode("append").option(
            "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, of(parse_pages(pages)).collect()))


# --- grids ----------------------------------------------------------------------------------------


def grids_of(page, html):
    rows = T.grid_rows(page_tables(parse_pages(page(html)))).orderBy("table_index", "row").collect()
    return [r["values"] for r in rows]


def test_tall_rowspans_are_whole(page):
    rows = 5000
    html = "<table><tr><td rowspan=3000>tall<td>0" + "".join(f"<tr><td>{i}" for i in range(1, rows)) + "</table>"
    got = grids_of(page, html)
    assert len(got) == rows and [r[0] for r in got] == ["tall"] * 3000 + [str(i) for i in range(3000, rows)]
    assert [r[1] for r in got[:3000]] == [str(i) for i in range(3000)] and all(r[1] == "" for r in got[3000:])


def test_spans_of_zero_and_beyond_the_bounds(page):
    assert grids_of(page, "<table><tr><td rowspan=0>a<td colspan=0>b<tr><td>c<tr><td colspan=x rowspan=-1>d</table>") == [
        ["a", "b"], ["a", "c"], ["a", "d"]]
    wide = grids_of(page, "<table><tr><td colspan=70000>w<td>x</table>")
    assert len(wide[0]) == 1001 and wide[0][-2:] == ["w", "x"]


def brute_grid(rows):
    """Every cell marks its places one by one; the later cell wins, and no row grows beyond the table."""
    grid, width = [{} for _ in rows], 0
    claimed = [set() for _ in rows]
    for r, cells in enumerate(rows):
        col = 0
        for text, cs, rs in cells:
            while col in claimed[r]:
                col += 1
            for y in range(r, min(len(rows), r + rs)):
                for x in range(col, col + cs):
                    grid[y][x] = text
                    if y > r:
                        claimed[y].add(x)
            col += cs
            width = max(width, col)
    width = max([width, *(max(g, default=-1) + 1 for g in grid)])
    return [[g.get(x, "") for x in range(width)] for g in grid]


def test_random_grids_are_what_marking_every_place_gives(page):
    rng = random.Random(4)
    tables = [[[(f"{t}.{r}.{c}", rng.choice([1, 1, 1, 2, 4]), rng.choice([1, 1, 1, 2, 3, 9])) for c in range(rng.randint(0, 4))]
               for r in range(rng.randint(1, 7))] for t in range(60)]
    html = "".join("<table>" + "".join("<tr>" + "".join(f"<td colspan={cs} rowspan={rs}>{t}</td>" for t, cs, rs in row) + "</tr>" for row in rows) + "</table>" for rows in tables)
    got = {}
    for r in T.grid_rows(page_tables(parse_pages(page(html)))).orderBy("row").collect():
        got.setdefault(r.table_index, []).append(r["values"])
    want = {i: brute_grid(rows) for i, rows in enumerate(tables)}
    assert got == {i: g for i, g in want.items() if any(rows for rows in tables[i])}


def test_trimmed_and_measured_grids_agree_with_rows_of_cells(page):
    html = "<table><tr><td> <td>&nbsp;<td>x<tr><td><td><tr><td rowspan=2>y<td><td>=1<tr><td>\u3000</table>"
    p = parse_pages(page(html))
    rows, cells = T.grid_rows(page_tables(p)), T.expand_grid(extract_tables(p)[1])
    flat = lambda df: sorted(tuple(r[c] for c in ("row", "col", "value")) for r in df.collect())
    assert flat(T.grid_cells(rows)) == flat(cells)
    assert flat(T.grid_cells(T.trimmed_rows(rows))) == flat(T.trim_grid(cells)) == [(0, 0, ""), (0, 1, "x"), (1, 0, "y"), (1, 1, "=1"), (2, 0, "y"), (2, 1, "")]
    names = ("rows", "columns", "cells", "empty")
    assert [tuple(r[n] for n in names) for r in T.grid_measures(rows).collect()] == [tuple(r[n] for n in names) for r in T.measure_grid(cells).collect()]
    assert sorted(r.line for r in T.grid_lines(rows, ";").collect()) == sorted(r.line for r in T.grid_csv(cells, ";").collect())


def test_tables_inside_tables_inside_tables(page):
    depth = 30
    html = "".join(f"<table id=t{i}><tr><td>{i} " for i in range(depth)) + "</td></tr></table>" * depth
    tables, cells = extract_tables(parse_pages(page(html)))
    found = {r.table_index: r.text for r in cells.collect()}
    assert found == {i: " ".join(map(str, range(i, depth))) for i in range(depth)}
    assert [(r.id, r.nested) for r in tables.orderBy("table_index").collect()] == [(f"t{i}", i > 0) for i in range(depth)]


@pytest.mark.parametrize("html", ["</table><tr><td>x", "<table>", "<table><td>a<table><td>b", "<table></tr></td><caption>c", "<TABLE><TR><TH>h</TABLE></table>"])
def test_broken_tables_are_read(page, html):
    p = parse_pages(page(html))
    assert extract_tables(p)[0].count() == len(re.findall("(?i)<table", html))
    T.grid_rows(page_tables(p)).collect()
