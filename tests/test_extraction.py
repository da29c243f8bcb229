"""Extraction against small pages whose facts are known, hostile ones included."""

from crawlsift.extract.blocks import extract_blocks, select_content_root
from crawlsift.extract.events import extract_layers
from crawlsift.extract.facts import extract_headings, extract_images, extract_links, extract_page_facts, extract_title
from crawlsift.extract.markup import html_tokens, parse_pages
from crawlsift.extract.signals import stack_signals, tracking_signals
from crawlsift.extract.structured import extract_jsonld, extract_microdata, flatten_jsonld
from crawlsift.extract.tables import extract_tables
from crawlsift.operators import detect, links
from crawlsift.operators.events import clean_json_payload, flatten_json
from crawlsift.operators.markdown import page_headers, render_markdown
from crawlsift.operators.tables import expand_grid, trim_grid


def test_hostile_markup_is_lossless_and_parsed(spark, page):
    bad = ["<a title=\"" + "x" * 1_000_000 + "\" href=/q>t</a>", "<a " + "y" * 100_000 + ">z", "<div " + " ".join(f"a{i}=1" for i in range(20_000)) + ">",
           "<script>if (a < b) { '</p>'", "<!-- open", "5 < 6 <", "<" * 5000, " " * 50_000 + "x"]
    df = page(*bad)
    assert df.filter(f"array_join({html_tokens('html')}, '') <> html").count() == 0
    assert extract_page_facts(parse_pages(df)).count() == len(bad)


def test_tokens_and_context(page):
    from crawlsift.extract.tokens import extract_tokens, with_context

    df = page("</nav><!-- c --><nav><nav><A HREF='x&amp;y' href=z Title=\"a > b\">t</a></nav>u</nav><title>a<b></title>v")
    tokens = with_context(extract_tokens(df), ["nav"]).orderBy("pos").collect()
    assert "".join(t.raw for t in tokens) == df.first().html
    link = next(t for t in tokens if t.tag == "a" and not t.closing)
    assert link.attrs == {"href": "x&y", "title": "a > b"} and link.in_nav == 2
    assert [t.in_nav for t in tokens if t.raw in "uv"] == [1, 0]
    assert next(t for t in tokens if t.tag == "title").kind == "element"


def test_comments_scripts_and_templates_hide_elements(page):
    df = page('<!-- <a href=1>x</a> --><script>"<a href=2>y</a>"</script><noscript><img src=n></noscript><template><a href=3>z</a>'
              '<template><img></template></template><svg role="img"><title>T</title><a href=4>s</a></svg><a href="5" href="6">r<b>e</b>al</a><a name=x>n</a>')
    got = extract_links(parse_pages(df)).collect()
    assert [(r.raw, r.href, r.text) for r in got] == [("5", "https://example.com/a/5", "real")]
    images = extract_images(parse_pages(df)).collect()
    assert [(r.kind, r.alt) for r in images] == [("svg", "T")]


def test_title_headings_and_base(page):
    df = page("<base href='/root/'><title>A &amp; <b></title></head><body><title>no</title><h1>One<h3>Th<i>ree</i></h3><a href=x>l</a>")
    p = parse_pages(df)
    assert extract_title(p).first()[1:] == ("A & <b>", 1)
    assert [(r.level, r.text) for r in extract_headings(p).collect()] == [(1, "One"), (3, "Three")]
    assert extract_links(p).first().href == "https://example.com/root/x"


def test_links_are_classified_by_parsed_origin(page):
    df = page('<a href="https://example.com.evil.test/">a</a><a href="//example.com:443/x">b</a><a href="#t">c</a><a href="MAILTO:x">d</a>'
              '<a href="https://bad host/">e</a><a href="/y" rel="nofollowing">f</a><a href="/y" rel="UGC nofollow"></a>')
    rows = links.annotate_links(extract_links(parse_pages(df))).orderBy("pos").collect()
    assert [r.kind for r in rows] == ["external", "internal", "anchor", "mailto", "other", "internal", "internal"]
    assert [r.nofollow for r in rows][-2:] == [False, True]
    kept = links.filter_links(links.annotate_links(extract_links(parse_pages(df))), dedupe=True)
    assert kept.count() == 6 and kept.filter("href = 'https://example.com/y'").first().pos == 5


def test_trackers_need_the_domain_not_a_lookalike(spark, page):
    df = page('<script src="https://evilclarity.ms/t"></script><script src="//www.clarity.ms/tag/abcdef1"></script><script>gtag("x")</script>')
    runtime = spark.createDataFrame([(1, ["fbq"], ["_ga_X1", "other"])], "page_id long, globals array<string>, cookie_names array<string>")
    static = {r.id: r.evidence for r in detect.detect_trackers(tracking_signals(parse_pages(df))).collect()}
    assert static == {"clarity": ["clarity.ms"], "ga4": ["window.gtag"]}
    live = {r.id: r.evidence for r in detect.detect_trackers(tracking_signals(parse_pages(df), runtime)).collect()}
    assert live == {"clarity": ["clarity.ms"], "meta": ["window.fbq"], "ga4": ["cookie _ga"]}
    more = [*detect.TRACKERS, {"id": "mine", "name": "Mine", "category": "analytics", "hosts": ["evilclarity.ms"]}]
    assert "mine" in {r.id for r in detect.detect_trackers(tracking_signals(parse_pages(df)), more).collect()}


def test_angular_rules_out_angularjs(spark, page):
    df = page('<div ng-version="15" ng-app></div>', "<div ng-app></div>")
    got = {(r.page_id, r.id, r.version) for r in detect.detect_stack(stack_signals(parse_pages(df))).collect()}
    assert got == {(1, "angular", "15"), (2, "angularjs", "")}


def test_jsonld_shapes(page):
    df = page('<script type="application/ld+json">[{"@type":"A","z":{"@type":["B","http://s/C"]},"a":[{"@type":"D"}]},{"@graph":[{"@type":"E"}],"x":{"@type":"no"}}]</script>'
              "<script type='Application/LD+JSON'>{bad</script>")
    blocks = extract_jsonld(parse_pages(df))
    assert [(r.block, r.ok, r.excerpt) for r in blocks.orderBy("block").collect()] == [(0, True, None), (1, False, "{bad")]
    assert [(r.path, r.type) for r in flatten_jsonld(blocks).orderBy("ord").collect()] == [
        ("block0[0]", "A"), ("block0[0].z", "B, C"), ("block0[0].a[0]", "D"), ("block0[1]@graph[0]", "E")]


def test_microdata_scopes(page):
    df = page('<div itemscope itemtype=X><div itemprop=o itemscope itemtype=Y><b itemprop=p>1</b></div><div itemscope><i itemprop="q r">2</i></div></div><p itemprop=s>3')
    got = {(r.type, r.prop, r.value) for r in extract_microdata(parse_pages(df)).collect()}
    assert got == {("X", "o", None), ("Y", "p", "1"), ("X", "q", "2"), ("X", "r", "2")}


def grid(df):
    rows = {}
    for r in df.collect():
        rows.setdefault((r.table_index, r.row), {})[r.col] = r.value
    return {k: [v[c] for c in sorted(v)] for k, v in sorted(rows.items())}


def test_table_spans_nesting_and_trimming(page):
    df = page("<table><tr><td rowspan=99999>a<td colspan=2>b</tr><tr><td>c<table><tr><td>n</table><td>d</tr><tr></tr></table><table><tr><td> <td>x<tr><td><td></table>")
    tables, cells = extract_tables(parse_pages(df))
    full = expand_grid(cells)
    assert grid(full) == {(0, 0): ["a", "b", "b"], (0, 1): ["a", "cn", "d"], (0, 2): ["a", "", ""], (1, 0): ["n"], (2, 0): ["", "x"], (2, 1): ["", ""]}
    assert grid(trim_grid(full))[(2, 0)] == ["x"]
    assert [(r.nested, r.row_count) for r in tables.orderBy("table_index").collect()] == [(False, 3), (True, 1), (False, 2)]


def test_colliding_spans_last_writer_wins(page):
    df = page("<table><tr><td>a<td rowspan=2>b<tr><td colspan=2>c</table>")
    assert grid(expand_grid(extract_tables(parse_pages(df))[1])) == {(0, 0): ["a", "b"], (0, 1): ["c", "c"]}


def test_markdown_of_a_whole_page(page):
    df = page("<title>T</title><body><nav>no</nav><article><h1>H*</h1><p>a <b> b <i>c</i> </b> <code>x`y</code><ul><li>1<ul><li>2</ul><li></li><li><p>3<p>4</ul>"
              "<blockquote>q<ol start=4><li>z</ol></blockquote><pre class=lang-PY>f()\n</pre><div hidden>h</div>tail<br></article>", "<body></body>")
    p = parse_pages(df)
    got = {r.page_id: r.markdown for r in render_markdown(extract_blocks(p), page_headers(p)).collect()}
    assert got[1] == ("# H\\*\n\na **b *c*** ``x`y``\n\n- 1\n  - 2\n- 3\n\n  4\n\n> q\n>\n> 4. z\n\n```py\nf()\n```\n\ntail\n")
    assert got[2] == ""
    assert {r.root for r in select_content_root(p).collect()} == {"body"}


def test_layers_and_flattening(spark, page):
    df = page('<script>dataLayer.push({"event":"buy","a":{"b":[1,{"c":"x"}],"e":[],"n":null},"s":"{no}"});</script>')
    leaves = flatten_json(extract_layers(parse_pages(df)), "raw", ["index"]).orderBy("ord").collect()
    assert [(r.path, r.value) for r in leaves] == [("event", "buy"), ("a.b[0]", "1"), ("a.b[1].c", "x"), ("a.e", "[]"), ("a.n", "null"), ("s", "{no}")]
    big = spark.createDataFrame([(1, "[" + ",".join("1" * 1 for _ in range(502)) + "]")], "id long, raw string")
    capped = {r.path: r.value for r in clean_json_payload(big, "raw", ["id"]).collect()}
    assert len(capped) == 501 and capped["500"] == "[2 more]"
