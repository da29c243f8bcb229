"""Pages with known content, derived row by row from the given relations.

The real pages carry no images, metadata, tables, trackers or products. These do, and what they carry follows from a
key's remainder, so an independent query over the same relation says what every operator must find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.sources import spread, spread_rows


def _read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spread_rows(spark.read.parquet(f"{directory}/{table}.parquet"))


def _pages(rows: DataFrame, key: str, url: str, head: list[str], body: list[str], lang: str = "en") -> DataFrame:
    html = ", ".join([f"'<!DOCTYPE html><html lang=\"{lang}\"><head>'", *head, "'</head><body>'", *body, "'</body></html>'"])
    return rows.selectExpr(f"CAST({key} AS BIGINT) AS page_id", f"concat({url}) AS url", f"concat({html}) AS html")


def page_captures(spark: SparkSession, directory: str) -> DataFrame:
    """Three captures of every page: as it is, and two of a later, equal time, of which the one with the larger id is the newest. Remainders
    of page_id say what it changes: title, first heading, a link at the end, a last paragraph. Every seventh page has a new neighbour."""
    pages = spread(spark.read.parquet(f"{directory}/pages.parquet")).selectExpr("page_id", "concat(url, '?p=', page_id) AS url", "html", "url AS address")
    title = "if(page_id % 5 = 0, regexp_replace(html, '<title>', '<title>New '), html)"
    heading = f"if(page_id % 3 = 0, regexp_replace({title}, '<h1>', '<h1>New '), {title})"
    tail = "concat(if(page_id % 4 = 0, '<p><a href=\"/new\">fresh</a></p>', ''), if(page_id % 2 = 0, '<p>tie</p>', ''))"
    newest = f"if(contains(html, '</body>'), replace({heading}, '</body>', concat({tail}, '</body>')), concat({heading}, {tail}))"
    return (
        pages.selectExpr("page_id", "url", "html", "1 AS captured_at")
        .unionByName(pages.selectExpr("page_id", "url", "'<p>never the newest</p>' AS html", "2 AS captured_at"))
        .unionByName(pages.selectExpr("page_id + 1000000 AS page_id", "url", f"{newest} AS html", "2 AS captured_at"))
        .unionByName(pages.filter("page_id % 7 = 0").selectExpr("page_id", "concat(address, '?new=', page_id) AS url", "html", "2 AS captured_at")))


def product_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per part: metadata, JSON-LD (every 11th broken), an image whose alt follows p_partkey % 3."""
    k = "p_partkey"
    jsonld = (
        "if({k} % 11 = 0, '{{\"@type\":\"Product\",', concat('{{\"@context\":\"https://schema.org\",\"@graph\":[{{\"@type\":\"Product\",\"name\":\"', "
        "p_name, '\",\"sku\":\"', if({k} % 2 = 0, CAST({k} AS STRING), ''), '\",\"brand\":{{\"@type\":\"Organization\",\"name\":\"', p_brand, "
        "'\"}},\"offers\":[{{\"@type\":\"http://schema.org/Offer\",\"price\":', CAST(p_retailprice AS DECIMAL(12,2)), "
        "if({k} % 3 = 0, ',\"priceCurrency\":\"USD\"', ''), '}}]}}]}}'))").format(k=k)
    head = [
        "'<meta charset=\"utf-8\"><title>', p_name, ' &amp; more</title>'",
        f"if({k} % 4 <> 0, concat('<meta name=\"description\" content=\"Buy ', p_name, ' of ', p_brand, '\">'), '')",
        f"if({k} % 2 = 0, concat('<meta property=\"og:title\" content=\"', p_name, '\">'), '')",
        f"if({k} % 3 = 0, concat('<META PROPERTY=\"og:image\" CONTENT=''/img/', {k}, '.png''>'), '')",
        f"if({k} % 5 <> 0, concat('<link rel=\"Canonical\" href=\" /part/', {k}, ' \">'), '')",
        f"if({k} % 7 = 0, '<meta name=\"robots\" content=\"NOINDEX, follow\">', '')",
        f"if({k} % 13 = 0, '<link rel=alternate hreflang=fr href=\"/fr\"><link rel=alternate hreflang=de href=\"/de\">', '')",
        f"'<script type=\"application/ld+json\">', {jsonld}, '</script>'"]
    body = [
        f"'<h1>', p_name, '</h1>', if({k} % 6 = 0, '<h3>Details</h3>', '<h2>Details</h2>')",
        f"'<img src=\"/img/', {k}, '.png\"', CASE {k} % 3 WHEN 0 THEN '' WHEN 1 THEN ' alt=\"\"' ELSE concat(' alt=\"', p_name, '\"') END, '>'",
        f"'<a href=\"/zoom/', {k}, '\"><img src=\"/img/big-', {k}, '.png\" alt=\"', if({k} % 2 = 0, 'icon', concat('big ', {k})), '\"></a>'",
        "'<p>Size ', p_size, ' <b>in stock</b> &mdash; <a href=\"/brand?b=1&amp;c=2\" rel=\"NoFollow\">', p_brand, '</a></p>'"]
    return _pages(_read(spark, directory, "part"), k, f"'https://shop.example.com/part/', {k}", head, body)


def microdata_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per part: a Product item with a nested Offer; every second page has a scope without itemprop inside."""
    body = [
        "'<div itemscope itemtype=\"https://schema.org/Product\"><span itemprop=\"name\">', p_name, '</span>'",
        "'<div itemprop=\"offers\" itemscope itemtype=\"https://schema.org/Offer\"><meta itemprop=\"price\" content=\"', "
        "CAST(p_retailprice AS DECIMAL(12,2)), '\"><div>x</div></div>'",
        "if(p_partkey % 2 = 0, concat('<div itemscope><i itemprop=\"sku mpn\">', p_partkey, '</i></div>'), '')",
        "'<a itemprop=\"url\" href=\"/p/', p_partkey, '\">go</a></div><p itemprop=\"stray\">no</p>'"]
    return _pages(_read(spark, directory, "part"), "p_partkey", "'https://shop.example.com/item/', p_partkey", [], body)


def review_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per supplier: an item whose reviews repeat and hold items in items, s_suppkey % 30 + 1 deep, beside an empty and an untyped one."""
    k, deep = "s_suppkey", "(s_suppkey % 30 + 1)"
    body = [
        "'<div itemscope itemtype=\"https://schema.org/OnlineBusiness\" itemid=\"urn:', s_suppkey, '\"><h1 itemprop=name>', s_name, '</h1>'",
        f"'<p itemprop=review>good</p><p itemprop=review>', {k}, '</p>'",
        f"array_join(transform(sequence(1, {deep}), i -> concat('<div itemprop=about itemscope itemtype=Thing><b itemprop=level>', i, '</b>')), '')",
        f"repeat('</div>', {deep}), '</div><div itemscope itemtype=Empty></div><div itemscope><i itemprop=lost>x</i></div>'"]
    return _pages(_read(spark, directory, "supplier"), k, f"'https://books.example.com/', {k}", [], body)


#: Levels of the texts of `deep_entries` and the blocks of `deep_pages`.
DEEP = 40


def _deep(name: str) -> str:
    return f"concat(repeat('{{\"@type\":\"Part\",\"part\":', {DEEP - 1}), '{{\"@type\":\"Leaf\",\"name\":\"', {name}, '\"}}', repeat('}}', {DEEP - 1}))"


def deep_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per supplier with a JSON-LD object in an object in an object, DEEP levels in all."""
    head = [f"'<script type=\"application/ld+json\">', {_deep('s_name')}, '</script>'"]
    return _pages(_read(spark, directory, "supplier"), "s_suppkey", "'https://deep.example.com/', s_suppkey", head, [])


def deep_entries(spark: SparkSession, directory: str) -> DataFrame:
    """layer_entries of the same depth, one per supplier."""
    return _read(spark, directory, "supplier").selectExpr(
        "CAST(s_suppkey AS BIGINT) AS page_id", "'dataLayer' AS layer", "0 AS index", f"{_deep('s_name')} AS raw").selectExpr("*", "try_parse_json(raw) AS value")


def table_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per part: a table of p_size % 4 + 1 body rows, the first column spanning them all, and one blank row."""
    body = [
        "'<table id=\"t\"><caption>', p_brand, '</caption><thead><tr><th colspan=\"2\">', p_name, '</th><th>n</th></tr></thead>'",
        "'<tfoot><tr><td colspan=3> </td></tr></tfoot><tbody>'",
        "array_join(transform(sequence(0, p_size % 4), i -> concat('<tr>', if(i = 0, concat('<td rowspan=\"', p_size % 4 + 1, "
        "'\">', p_type, '</td>'), ''), '<td>', i, '</td><td>=', p_partkey + i, '</td></tr>')), '')", "'</tbody></table>'"]
    return _pages(_read(spark, directory, "part"), "p_partkey", "'https://shop.example.com/table/', p_partkey", [], body)


def article_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per part: headings, emphasis, nested lists, a quote, code, a table - inside an article longer than a line."""
    filler = "repeat('lorem ipsum ', 20)"
    body = [
        "'<nav><a href=\"/\">home</a></nav><article><h1>', p_name, '</h1><p>It is <strong>', p_type, ' </strong> and <em>', p_size, "
        "'</em> big; see <a href=\"/b/', p_partkey, '\">', p_brand, '</a>.</p>'",
        "'<ul><li>one</li><li></li><li>two<ol start=\"', p_size, '\"><li>', p_partkey, '</li><li>x_y</li></ol></li></ul>'",
        f"'<blockquote><p>', {filler}, '</p></blockquote>'",
        "'<pre class=\"lang-SQL\"><code>select ', p_partkey, '\\n</code></pre><hr>'",
        "'<table><tr><th>k<th>v</tr><tr><td>', p_partkey, '<td>a|b</tr></table></article><footer>bye</footer>'"]
    return _pages(_read(spark, directory, "part"), "p_partkey", "'https://shop.example.com/read/', p_partkey",
                  ["'<title>', p_name, '</title>'"], body)


def gallery_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per supplier with an image of every kind and one for every verdict; every fifth has a good image alone."""
    k = "s_suppkey"
    rest = [
        "'<img src=/h.png aria-hidden=true><img src=/l.png aria-label=\"lab\"><img src=/m.png><a href=/x><img src=/e.png alt=\"\"></a><img src=/d.png alt=\"\">'",
        f"'<img src=/w.png alt=\"', repeat('w', 126), '\"><img src=/f.png alt=\" Photo \"><img src=/r.png alt=\"An image of ', {k}, '\">'",
        f"'<img src=\"/team-photo-', {k}, '.png\" alt=\"Team photo ', {k}, '\"><input type=image src=/go.png alt=\"Go ', {k}, '\"><input type=text alt=no>'",
        f"'<map><area href=\"/area-', {k}, '\" alt=\"North\"></map><svg role=img aria-label=\"Chart ', {k}, '\"><title>t</title></svg><svg><title>no</title></svg>'",
        "'<img src=/p.gif alt=\"\">'"]
    body = [f"'<img src=\"/a-', {k}, '.png\" alt=\"', s_name, ' at work\">'", f"if({k} % 5 = 0, '', concat({', '.join(rest)}))"]
    return _pages(_read(spark, directory, "supplier"), k, f"'https://pics.example.com/', {k}", [], body)


def tag_id_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per supplier with an id of every kind that tags carry, and JSON-LD of several shapes at its top."""
    k = "s_suppkey"
    head = [
        f"'<script src=\"https://www.googletagmanager.com/gtm.js?id=GTM-AB', 1000 + {k}, '\"></script><script src=\"https://www.clarity.ms/tag/abc', 1000 + {k}, '\"></script>'",
        f"'<script>gtag(\"config\", \"G-ABCD', 1000 + {k}, '\"); ga(\"create\", \"UA-', 10000 + {k}, '-1\"); gtag(\"config\", \"AW-', 1000000 + {k}, '\");'",
        f"'gtag(\"config\", \"DC-', 2000000 + {k}, '\"); fbq(\"init\", \"', 3000000 + {k}, '\"); h._hjSettings = {{hjid:', 40000 + {k}, '}};</script>'",
        "'<script type=\"application/ld+json\">[{\"@type\":\"Product\"},{\"@type\":[\"Article\",\"NewsArticle\"]}]</script>'",
        f"if({k} % 2 = 0, '<script type=\"application/ld+json\">{{\"@type\":\"Person\"}}</script>', '')"]
    return _pages(_read(spark, directory, "supplier"), k, f"'https://ids.example.com/', {k}", head, [])


def store_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One product page per part: theme, analytics and a product JSON island with p_size % 3 + 1 variants."""
    k, cents = "p_partkey", "CAST(round(p_retailprice * 100) AS BIGINT)"
    variants = (
        f"array_join(transform(sequence(0, p_size % 3), i -> concat('{{\"id\":', {k} * 10 + i, ',\"title\":\"V', i, '\",\"sku\":\"', "
        f"if(i = 1, '', concat('S', {k}, '-', i)), '\",\"price\":', {cents} + i * 100, if({k} % 5 = 0, '', concat(',\"available\":', "
        f"if(({k} + i) % 4 = 0, 'false', 'true'))), '}}')), ',')")
    island = (
        f"'<script type=\"application/json\" id=\"ProductJson-', {k}, '\">{{\"id\":', {k} + 1, ',\"title\":\"', p_name, '\",\"vendor\":\"', "
        f"if({k} % 9 = 0, '', p_brand), '\",\"price\":', {cents}, if({k} % 4 = 0, concat(',\"compare_at_price\":', {cents} * 2), ''), "
        f"',\"description\":\"', repeat('d', p_size * 4), '\",\"images\":[\"/a.jpg\"', if({k} % 2 = 0, ',\"/b.jpg\",\"/c.jpg\"', ''), "
        f"'],\"variants\":[', {variants}, ']}}</script>'")
    head = [
        f"'<link rel=\"canonical\" href=\"/s/', {k}, '\"><script src=\"https://cdn.shopify.com/extensions/', {k}, '.js\"></script>'",
        f"if({k} % 3 = 0, '<script src=\"//static.klaviyo.com/k.js\"></script><script src=\"https://notloox.io/x.js\"></script>', '')",
        f"'<script>Shopify.shop = \"shop', {k} % 10, '.example.com\";Shopify.theme = {{\"name\":\"Dawn\",\"role\":\"', if({k} % 6 = 0, "
        f"'development', 'main'), '\"}};var meta = {{\"page\":{{\"pageType\":\"product\"}}}};</script>'"]
    return _pages(_read(spark, directory, "part"), k, f"'https://store.example.com/s/', {k}", head, [island])


def tagged_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per supplier: trackers, consent tools, lookalike hosts, tag ids and technologies by remainders."""
    k = "s_suppkey"
    head = [
        f"if({k} % 2 = 0, concat('<script src=\"https://www.googletagmanager.com/gtag/js?id=G-ABCDEF', {k} % 7, '\"></script>'), '')",
        f"if({k} % 3 = 0, concat('<script>window.dataLayer = window.dataLayer || []; fbq(\"init\", \"10000', {k} % 5, '\");</script>'), '')",
        f"if({k} % 4 = 0, '<script src=\"//cdn.cookielaw.org/x.js\"></script>', '')",
        f"if({k} % 5 = 0, '<script src=\"/_next/static/a.js\"></script>', '')",
        f"if({k} % 7 = 0, '<meta name=\"generator\" content=\"WordPress 6.1\"><link rel=stylesheet href=\"/wp-content/a.css\">', '')",
        f"if({k} % 11 = 0, '<script>angular.module(\"a\"); angular = 1;</script>', '')"]
    body = [
        f"if({k} % 6 = 0, '<iframe src=\"https://static.hotjar.com/h\"></iframe>', '<iframe src=\"https://evilhotjar.com/\"></iframe>')",
        f"if({k} % 22 = 0, '<div ng-version=\"17.1\"></div>', '')", "'<p>', s_name, '</p>'"]
    return _pages(_read(spark, directory, "supplier"), k, f"'https://site', {k} % 9, '.example.com/', {k}", head, body)


def linked_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per customer with one link of every kind, a repeated one, and a link to the next customer."""
    k = "c_custkey"
    body = [
        f"'<a href=\"/c/', {k} + 1, '\"', if({k} % 5 = 0, ' rel=\"ugc NOFOLLOW\"', ''), '>', c_name, '</a>'",
        "'<a href=\"https://partner.example.org/', c_nationkey, '\" target=\"_blank\"><img src=\"/l.png\" alt=\"Partner\"></a>'",
        "'<a href=\"https://crm.example.com.evil.test/\">look</a><a href=\"mailto:a@example.com\">mail</a><a href=\"TEL:+1\">call</a>'",
        f"'<a href=\"#top\">top</a><a href=\"javascript:void(0)\">run</a><a href=\"/c/', {k} + 1, '\"', if({k} % 3 = 0, "
        "' aria-label=\"again\"', ''), '></a><a href=\"ftp://f.example.com/\">ftp</a><a name=x>no link</a>'"]
    return _pages(_read(spark, directory, "customer"), k, f"'https://crm.example.com/c/', {k}", [], body)


def event_entries(spark: SparkSession, directory: str) -> DataFrame:
    """layer_entries from events: objects for even ids, command arrays for odd ones, every 10th without a name."""
    raw = (
        "CASE WHEN event_id % 10 = 0 THEN concat('{\"value\":', event_id, ',\"user\":', user_id, '}') WHEN event_id % 2 = 0 THEN "
        "concat('{\"event\":\"', event_type, '\",\"props\":', props, ',\"tags\":[]}') ELSE concat('[\"event\",\"', event_type, "
        "'\",', props, ']') END")
    return _read(spark, directory, "events").selectExpr(
        "user_id AS page_id", "'dataLayer' AS layer", "event_id AS index", f"{raw} AS raw").selectExpr(
        "*", "try_parse_json(raw) AS value")


def layer_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per event, its push spelled in one of four ways by event_id % 4; every third one names a tag-manager container."""
    k, name = "event_id", "event_type"
    relaxed = (f"concat('window.dataLayer = window.dataLayer || [];\\ndataLayer.push({{event: ''', {name}, ''', id: ', {k}, "
               "', a: {b: {c: {d: {e: {f: [1, {}]}}}}},});')")
    initial = f"concat('dataLayer = [{{''event'': \"', {name}, '\", ''n'': ', {k}, '}}, ''it\\\\''s \"x\"''];')"
    command = (f"concat('function gtag(){{dataLayer.push(arguments);}} gtag(''js'', new Date()); gtag(''event'', ''', {name}, "
               f"''', {{value: ', {k}, ', ok: !0}})')")
    comments = (f"concat('/* dataLayer.push({{\"no\":1}}) */ _mtm.push({{\"event\":\"', {name}, '\",\"id\":', {k}, "
                "'}, {b: undefined}); // _mtm.push({\"x\":1})')")
    head = [
        f"if({k} % 3 = 0, concat('<script src=\"https://www.googletagmanager.com/gtm.js?id=GTM-ABC', {k} % 9, 'X\"></script>'), '')",
        f"'<script>', CASE {k} % 4 WHEN 0 THEN {relaxed} WHEN 1 THEN {initial} WHEN 2 THEN {command} ELSE {comments} END, '</script>'"]
    return _pages(_read(spark, directory, "events"), k, f"'https://events.example.com/', {k}", head, [])


def long_table_pages(spark: SparkSession, directory: str) -> DataFrame:
    """One page per supplier with all its line items in one table; every row without a close tag, the first cell without a row."""
    rows = spread(spark.read.parquet(f"{directory}/lineitem.parquet")).groupBy("l_suppkey").agg(F.expr(
        "array_join(array_sort(collect_list(concat('<td>', lpad(l_orderkey, 12, '0'), '<td>', l_linenumber))), '<tr>')").alias("cells"))
    return _pages(rows, "l_suppkey", "'https://lines.example.com/', l_suppkey", [], ["'<table>', cells, '</table>'"])


def captured_cookies(spark: SparkSession, directory: str) -> DataFrame:
    """What a live browser saw on the tagged pages: cookie names by s_suppkey."""
    return _read(spark, directory, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS page_id", (
        "array_compact(array(if(s_suppkey % 2 = 0, concat('_ga_X', s_suppkey), NULL), if(s_suppkey % 5 = 0, '_hjSessionUser_1', NULL), "
        "if(s_suppkey % 7 = 0, '_fb', NULL), '', 'sid')) AS cookie_names"))
