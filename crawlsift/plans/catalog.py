"""Every operator as a named query over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.extract import blocks as B
from crawlsift.extract import events as E
from crawlsift.extract import facts as X
from crawlsift.extract import signals as G
from crawlsift.extract import store as ST
from crawlsift.extract import structured as SD
from crawlsift.extract import tables as TB
from crawlsift.extract.markup import html_tokens, parse_pages
from crawlsift.extract.tokens import extract_tokens, with_context
from crawlsift.functions.csv import csv_field
from crawlsift.functions.markdown import inline_code, link_target, markdown_escape
from crawlsift.functions.money import discount_percent, offer_available, offer_price_cents
from crawlsift.functions.text import clip, count_words, js_length, normalise_alnum
from crawlsift.functions.urls import file_name_of, host_of
from crawlsift.operators import captures as CP
from crawlsift.operators import corpus as C
from crawlsift.operators import detect as D
from crawlsift.operators import events as EV
from crawlsift.operators import findings as FD
from crawlsift.operators import images as IM
from crawlsift.operators import links as LK
from crawlsift.operators import markdown as MD
from crawlsift.operators import schema as SC
from crawlsift.operators import seo, store, tables
from crawlsift.plans import site_audit
from crawlsift.plans import synthetic as S
from crawlsift.registry.technologies import STACK_CATEGORIES
from crawlsift.registry.trackers import TRACKER_CATEGORIES
from crawlsift.shared import shared_folder, written
from crawlsift.sinks import audit_json, csv_documents, export_key, layers_json, schema_documents, schema_report, stack_report, store_rows, tracker_report, tracker_rows
from crawlsift.sinks import documents
from crawlsift.sources import describe_blocked, load_pages
from crawlsift.streaming import first_sightings, split_late

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _pages(spark, d) -> DataFrame:
    return parse_pages(load_pages(spark, d))


def _read(spark, d, table) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- the real pages -------------------------------------------------------------------------------

_UNESCAPE = "replace(replace(replace(replace({}, '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '\"'), '&amp;', '&')"
_TITLE = "trim(regexp_replace(" + _UNESCAPE.format("regexp_extract(html, '<title>([^<]*)', 1)") + ", '\\s+', ' ', 'g'))"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
# references are decoded last here, so nothing decoded can look like a tag
_BODY = ("regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<!--.*?-->|</?b>', '', 'g'), '<[^>]*>', ' ', 'g')")
_WORDS = f"len(list_filter(regexp_split_to_array({_UNESCAPE.format(_BODY)}, '\\s+'), lambda w: w <> ''))"

_REAL_FINDINGS = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, url, length({_TITLE}) AS n FROM pages)
SELECT host, id, status, CAST(count(*) AS BIGINT) AS pages FROM (
  SELECT host, 'title' AS id, CASE WHEN n = 0 THEN 'error' WHEN n < 30 OR n > 60 THEN 'warning' ELSE 'ok' END AS status FROM p
  UNION ALL SELECT host, 'https', 'warning' FROM p WHERE url LIKE 'http://%'
  UNION ALL SELECT host, v.id, v.status FROM p CROSS JOIN (VALUES ('description','error'), ('canonical','warning'),
    ('robots','info'), ('lang','ok'), ('charset','ok'), ('viewport','warning'), ('og:title','warning'),
    ('og:description','warning'), ('og:image','warning'), ('og:type','info'), ('twitter:card','warning'), ('h1','ok'),
    ('outline','ok'), ('alt','info'), ('link-text','ok'), ('links','info'), ('jsonld','info'), ('words','info')) v(id, status)
) GROUP BY ALL"""

query("site_audit", _REAL_FINDINGS)(lambda s, d: site_audit(load_pages(s, d)))

query("tokens", "SELECT page_id, CAST(length(html) AS BIGINT) AS chars, true AS lossless FROM pages")(
    lambda s, d: load_pages(s, d).selectExpr("page_id", "html", f"array_join({html_tokens('html')}, '') AS j").selectExpr(
        "page_id", "CAST(length(j) AS BIGINT) AS chars", "j = html AS lossless"))

query("tag_contexts", """SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links,
  CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*)</nav>', 1),
  '<a ')) AS BIGINT) AS in_nav, CAST(len(regexp_extract_all(html, '<!--')) AS BIGINT) AS comments FROM pages""")(
    lambda s, d: with_context(extract_tokens(load_pages(s, d)), ["nav"]).groupBy("page_id").agg(
        F.expr("count_if(tag = 'a' AND attrs['href'] IS NOT NULL)").alias("links"),
        F.expr("count_if(tag = 'li' AND NOT closing)").alias("items"),
        F.expr("count_if(tag = 'a' AND NOT closing AND in_nav = 1)").alias("in_nav"),
        F.expr("count_if(kind = 'comment')").alias("comments")))

query("page_titles", f"SELECT page_id, {_TITLE} AS title, 1 AS title_count FROM pages")(
    lambda s, d: X.extract_title(_pages(s, d)))

query("page_identity", f"""SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin,
  regexp_extract(url, '^[a-z]+:') AS protocol, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  true AS has_charset_tag FROM pages""")(lambda s, d: X.extract_page_identity(_pages(s, d)))

query("page_headings", f"""SELECT page_id, 0 AS pos, 1 AS level, trim(regexp_replace({_UNESCAPE.format(
    "regexp_extract(html, '<h1>([^<]*)', 1)")}, '\\s+', ' ', 'g')) AS text FROM pages""")(
    lambda s, d: X.extract_headings(_pages(s, d)))

query("word_counts", f"SELECT page_id, CAST({_WORDS} AS INTEGER) AS word_count FROM pages")(
    lambda s, d: X.word_counts(_pages(s, d)))

_LINKS = """SELECT page_id, url, unnest(range(len(l))) AS pos, unnest(l) AS raw, len(l) AS total FROM (
  SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)"""
_RESOLVED = "regexp_extract(url, '^[a-z]+://[^/?#]+') || '/' || replace(url_encode(substr(raw, 2)), '%2C', ',')"

query("page_links", f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, raw, {_RESOLVED} AS href, substr(raw, 2) AS text,
  CAST(total AS INTEGER) AS total, 'internal' AS kind FROM ({_LINKS})""")(
    lambda s, d: LK.annotate_links(X.extract_links(_pages(s, d))).select("page_id", "pos", "raw", "href", "text", "total", "kind"))

query("dangling_links", f"""WITH l AS ({_LINKS}), t AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS u FROM pages)
SELECT href, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_RESOLVED} AS href FROM l) WHERE href NOT IN (SELECT u FROM t)
GROUP BY href""")(
    lambda s, d: C.dangling_links(LK.annotate_links(X.extract_links(_pages(s, d))), load_pages(s, d)))

query("duplicate_titles", f"""SELECT lower({_TITLE}) AS value, CAST(count(*) AS BIGINT) AS pages, min(page_id) AS first_page
FROM pages GROUP BY 1 HAVING count(*) > 1""")(lambda s, d: C.duplicate_values(X.extract_title(_pages(s, d)), "title"))

query("blocked_pages", """SELECT page_id, u AS url, CASE WHEN page_id % 5 = 0 THEN 'Local files are blocked by default.'
  WHEN page_id % 5 IN (1, 3) THEN 'Chrome does not allow extensions on this page.'
  WHEN page_id % 5 = 2 THEN 'Chrome does not allow extensions on the Web Store.' END AS blocked_reason
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'file:///a' || page_id WHEN 1 THEN 'chrome://settings/' || page_id
  WHEN 2 THEN 'https://chromewebstore.google.com/' || page_id WHEN 3 THEN 'view-source:' || url ELSE url END AS u FROM pages)""")(
    lambda s, d: describe_blocked(load_pages(s, d).selectExpr("page_id", """CASE page_id % 5 WHEN 0 THEN concat('file:///a',
    page_id) WHEN 1 THEN concat('chrome://settings/', page_id) WHEN 2 THEN concat('https://chromewebstore.google.com/', page_id)
    WHEN 3 THEN concat('view-source:', url) ELSE url END AS url""")).drop("blocked_hint"))

query("content_roots", """SELECT page_id, CASE WHEN list_sum(list_transform(regexp_split_to_array(regexp_extract(html,
  '(?s)<article>(.*)</article>', 1), '<[^>]*>'), lambda t: length(trim(t)))) > 200 THEN 'article' ELSE 'body' END AS root FROM pages""")(lambda s, d: B.select_content_root(_pages(s, d)))

query("page_markdown_sizes")(lambda s, d: MD.page_markdown(_pages(s, d)).selectExpr("page_id", "length(markdown) AS chars"))

query("latest_captures", """SELECT host, max(page_id) AS page_id FROM (SELECT page_id, """ + _HOST + """ AS host FROM pages)
GROUP BY host""")(lambda s, d: C.latest_capture(C.with_host(load_pages(s, d)).drop("html").withColumn(
    "captured_at", F.timestamp_seconds("page_id")), "host").select("host", "page_id"))

query("capture_changes", """SELECT url, 'changed' AS change, 'size' AS changed FROM (SELECT url, min(page_id) AS k FROM pages
GROUP BY url) WHERE k % 3 = 0 UNION ALL SELECT url || '#new', 'added', '' FROM (SELECT url, min(page_id) AS k FROM pages GROUP BY url)
WHERE k % 4 = 0 UNION ALL SELECT url, 'removed', '' FROM (SELECT url, min(page_id) AS k FROM pages GROUP BY url) WHERE k % 7 = 1
AND k % 3 <> 0""")(lambda s, d: _capture_changes(s, d))


def _capture_changes(spark, d) -> DataFrame:
    old = load_pages(spark, d).groupBy("url").agg(F.min("page_id").alias("k")).selectExpr("url", "k", "k AS size")
    new = old.filter("NOT (k % 7 = 1 AND k % 3 <> 0)").selectExpr("url", "k", "if(k % 3 = 0, size + 1, size) AS size").unionByName(
        old.filter("k % 4 = 0").selectExpr("concat(url, '#new') AS url", "k", "size"))
    return C.diff_captures(old, new, ["size"]).selectExpr("url", "change", "array_join(changed, ',') AS changed")


query("page_changes", """SELECT url || '?p=' || page_id AS url, 'changed' AS change, concat_ws(',', CASE WHEN page_id % 5 = 0 THEN 'title' END,
  CASE WHEN page_id % 3 = 0 THEN 'headings' END, CASE WHEN page_id % 4 = 0 THEN 'links' END, CASE WHEN page_id % 3 = 0 OR page_id % 4 = 0 OR
  page_id % 2 = 0 THEN 'text' END) AS changed, CASE WHEN page_id % 4 = 0 THEN 1 END AS new_links, CASE WHEN page_id % 3 = 0 OR page_id % 2 = 0 THEN
  (CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END) END AS new_text,
  CASE WHEN page_id % 3 = 0 THEN 1 END AS gone_headings FROM pages WHERE page_id % 5 = 0 OR page_id % 3 = 0 OR page_id % 2 = 0
UNION ALL SELECT url || '?new=' || page_id, 'added', '', NULL, NULL, NULL FROM pages WHERE page_id % 7 = 0""")(
    lambda s, d: CP.capture_diff(S.page_captures(s, d), "1", "2", parse_pages).selectExpr(
        "url", "change", "array_join(changed, ',') AS changed", "added['links'] AS new_links", "added['text'] AS new_text", "removed['headings'] AS gone_headings"))


# --- product pages: metadata, images, page audit, structured data ---------------------------------

_SHOP = "'https://shop.example.com"
_META_SQL = """SELECT p_partkey AS page_id, k.key AS key, k.content AS content, 1 AS n FROM part, LATERAL (VALUES
  ('description', CASE WHEN p_partkey % 4 <> 0 THEN 'Buy ' || p_name || ' of ' || p_brand END),
  ('robots', CASE WHEN p_partkey % 7 = 0 THEN 'NOINDEX, follow' END),
  ('og:title', CASE WHEN p_partkey % 2 = 0 THEN p_name END),
  ('og:image', CASE WHEN p_partkey % 3 = 0 THEN '/img/' || p_partkey || '.png' END)) k(key, content) WHERE k.content IS NOT NULL"""
query("meta_tags", _META_SQL)(lambda s, d: X.extract_meta(parse_pages(S.product_pages(s, d))))

query("canonical_links", f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 <> 0 THEN '/part/' || p_partkey END AS canonical_raw,
  CASE WHEN p_partkey % 5 <> 0 THEN {_SHOP}/part/' || p_partkey END AS canonical,
  CASE WHEN p_partkey % 5 <> 0 THEN 1 ELSE 0 END AS canonical_count FROM part""")(
    lambda s, d: X.extract_canonical(parse_pages(S.product_pages(s, d))))

query("hreflang_links", f"""SELECT p_partkey AS page_id, pos, lang, {_SHOP}/' || lang AS href FROM part,
  (VALUES (0, 'fr'), (1, 'de')) v(pos, lang) WHERE p_partkey % 13 = 0""")(
    lambda s, d: X.extract_hreflang(parse_pages(S.product_pages(s, d))))

_IMAGES_SQL = f"""SELECT page_id, "index", src, alt, status, reason, type, in_link FROM (
  SELECT p_partkey AS page_id, 0 AS "index", {_SHOP}/img/' || p_partkey || '.png' AS src,
    CASE p_partkey % 3 WHEN 0 THEN '(missing)' WHEN 1 THEN '' ELSE p_name END AS alt,
    CASE p_partkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'info' ELSE 'ok' END AS status,
    CASE p_partkey % 3 WHEN 0 THEN 'No alt attribute. Screen readers will read the file name instead.'
      WHEN 1 THEN 'Decorative (alt="").' ELSE length(p_name) || ' characters.' END AS reason, 'img' AS type, 'no' AS in_link FROM part
  UNION ALL SELECT p_partkey, 1, {_SHOP}/img/big-' || p_partkey || '.png',
    CASE WHEN p_partkey % 2 = 0 THEN 'icon' ELSE 'big ' || p_partkey END, 'warning',
    CASE WHEN p_partkey % 2 = 0 THEN '"icon" describes the medium, not the content.' ELSE 'Alt text is just the file name.' END,
    'img', 'yes' FROM part)"""


def _images(s, d) -> DataFrame:
    return IM.annotate_images(X.extract_images(parse_pages(S.product_pages(s, d))))


query("image_verdicts", _IMAGES_SQL)(lambda s, d: IM.image_rows(_images(s, d)))
query("image_problems", f"SELECT * FROM ({_IMAGES_SQL}) WHERE status IN ('error', 'warning')")(
    lambda s, d: IM.image_rows(IM.filter_images(_images(s, d), "issues")))
_GALLERY_SQL = """SELECT s_suppkey AS page_id, v.kind, v.alt, v.status, v.reason, v.in_link FROM supplier, LATERAL (
  SELECT 'img' AS kind, s_name || ' at work' AS alt, 'ok' AS status, CAST(length(s_name) + 8 AS VARCHAR) || ' characters.' AS reason, 'no' AS in_link
  UNION ALL SELECT * FROM (VALUES ('img', '(missing)', 'info', 'Hidden from assistive technology on purpose.', 'no'),
  ('img', '(missing)', 'warning', 'No alt attribute, but aria-label is present.', 'no'),
  ('img', '(missing)', 'error', 'No alt attribute. Screen readers will read the file name instead.', 'no'),
  ('img', '', 'error', 'Empty alt inside a link, which leaves the link with no name.', 'yes'), ('img', '', 'info', 'Decorative (alt="").', 'no'),
  ('img', repeat('w', 126), 'warning', '126 characters. Over 125 usually belongs in a caption.', 'no'),
  ('img', 'Photo', 'warning', '"Photo" describes the medium, not the content.', 'no'),
  ('img', 'An image of ' || s_suppkey, 'warning', 'Starts with a redundant prefix; screen readers already say "image".', 'no'),
  ('img', 'Team photo ' || s_suppkey, 'warning', 'Alt text is just the file name.', 'no'),
  ('input', 'Go ' || s_suppkey, 'ok', CAST(3 + length(CAST(s_suppkey AS VARCHAR)) AS VARCHAR) || ' characters.', 'no'),
  ('area', 'North', 'ok', '5 characters.', 'no'),
  ('svg', 'Chart ' || s_suppkey, 'ok', CAST(6 + length(CAST(s_suppkey AS VARCHAR)) AS VARCHAR) || ' characters.', 'no'),
  ('img', '', 'info', 'Tracking pixel, correctly marked decorative.', 'no')) x WHERE s_suppkey % 5 <> 0) v"""


def _gallery(s, d) -> DataFrame:
    # sizes as a browser reports them; static html has none
    found = X.extract_images(parse_pages(S.gallery_pages(s, d))).selectExpr(
        "* EXCEPT (natural_width, natural_height)", "if(raw_src = '/p.gif', 1, 640) AS natural_width", "if(raw_src = '/p.gif', 1, 480) AS natural_height")
    return IM.annotate_images(found)


query("image_kinds", _GALLERY_SQL)(lambda s, d: IM.image_rows(_gallery(s, d)).selectExpr("page_id", "type AS kind", "alt", "status", "reason", "in_link"))
query("image_defaults", f"""SELECT page_id, status, CAST(count(*) AS BIGINT) AS n FROM ({_GALLERY_SQL}) WHERE status IN ('error', 'warning') OR
  page_id % 5 = 0 GROUP BY ALL""")(
    lambda s, d: IM.default_filter(_gallery(s, d)).groupBy("page_id", "status").agg(F.count(F.lit(1)).alias("n")))
query("image_summary", f"""SELECT page_id, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS ok,
  CAST(count(*) FILTER (status = 'warning') AS BIGINT) AS warning, CAST(count(*) FILTER (status = 'error') AS BIGINT) AS error,
  CAST(count(*) FILTER (status = 'info') AS BIGINT) AS info, CAST(count(*) AS BIGINT) AS total,
  CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'error' WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warning' ELSE 'ok'
  END AS status FROM ({_IMAGES_SQL}) GROUP BY page_id""")(
    lambda s, d: IM.summarize_images(_images(s, d), S.product_pages(s, d)))


def _facts(s, d) -> DataFrame:
    return X.extract_page_facts(parse_pages(S.product_pages(s, d)))


_DESC = "('Buy ' || p_name || ' of ' || p_brand)"
_FINDINGS_SQL = f"""SELECT p_partkey AS page_id, f.id, f.status, f.message FROM part, LATERAL (VALUES
  ('title', CASE WHEN length(p_name) + 7 < 30 THEN 'warning' ELSE 'ok' END, CASE WHEN length(p_name) + 7 < 30 THEN
    (length(p_name) + 7) || ' characters - short. Aim for 30-60.' ELSE (length(p_name) + 7) || ' characters.' END),
  ('description', CASE WHEN p_partkey % 4 = 0 THEN 'error' ELSE 'warning' END, CASE WHEN p_partkey % 4 = 0 THEN
    'Missing. Search engines will invent a snippet instead.' ELSE length({_DESC}) || ' characters - short. Aim for 70-160.' END),
  ('canonical', CASE WHEN p_partkey % 5 = 0 THEN 'warning' ELSE 'ok' END, CASE WHEN p_partkey % 5 = 0 THEN
    'Missing. Duplicate URLs may compete against each other.' ELSE 'Present and absolute.' END),
  ('robots', CASE WHEN p_partkey % 7 = 0 THEN 'warning' ELSE 'info' END, CASE WHEN p_partkey % 7 = 0 THEN
    'This page asks search engines not to index it.' ELSE 'No robots meta tag - defaults to indexable.' END),
  ('lang', 'ok', 'Declared.'), ('charset', 'ok', 'Declared.'),
  ('viewport', 'warning', 'Missing. The page will not scale correctly on mobile.'),
  ('og:title', CASE WHEN p_partkey % 2 = 0 THEN 'ok' ELSE 'warning' END, CASE WHEN p_partkey % 2 = 0 THEN
    length(p_name) || ' characters.' ELSE 'Missing. Shared links will fall back to page content.' END),
  ('og:description', 'warning', 'Missing. Shared links will fall back to page content.'),
  ('og:image', CASE WHEN p_partkey % 3 = 0 THEN 'ok' ELSE 'warning' END, CASE WHEN p_partkey % 3 = 0 THEN 'Present and absolute.'
    ELSE 'Missing. Shared links will have no preview image.' END),
  ('og:type', 'info', 'Not set - defaults to "website".'),
  ('twitter:card', 'warning', 'Missing. X/Twitter falls back to Open Graph, with less control.'),
  ('h1', 'ok', 'Exactly one.'),
  ('outline', CASE WHEN p_partkey % 6 = 0 THEN 'warning' ELSE 'ok' END, CASE WHEN p_partkey % 6 = 0 THEN
    'Jumps from H1 to H3. Do not skip levels.' ELSE '2 headings, no skipped levels.' END),
  ('alt', CASE WHEN p_partkey % 3 = 0 THEN 'warning' ELSE 'ok' END, CASE WHEN p_partkey % 3 = 0 THEN
    '1 of 2 images have no alt attribute.' ELSE 'All 2 images have an alt attribute.' END),
  ('link-text', 'ok', 'All links are labelled.'), ('links', 'info', '2 internal, 0 external, 1 nofollow.'),
  ('jsonld', CASE WHEN p_partkey % 11 = 0 THEN 'error' ELSE 'ok' END, CASE WHEN p_partkey % 11 = 0 THEN
    'A JSON-LD block failed to parse.' ELSE '1 JSON-LD block(s).' END),
  ('hreflang', CASE WHEN p_partkey % 13 = 0 THEN 'info' END, '2 alternate language link(s).'),
  ('words', 'info', (2 * 0 + len(string_split(p_name, ' ')) + 1 + 2 + 3 + len(string_split(p_brand, ' '))) || ' words.')
) f(id, status, message) WHERE f.status IS NOT NULL"""

query("page_findings", _FINDINGS_SQL)(lambda s, d: seo.audit_pages(_facts(s, d)).select("page_id", "id", "status", "message"))
query("page_issues", f"SELECT * FROM ({_FINDINGS_SQL}) WHERE status IN ('error', 'warning')")(
    lambda s, d: FD.issues_only(seo.audit_pages(_facts(s, d))).select("page_id", "id", "status", "message"))
_SUMMARY = """SELECT page_id, CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (status = 'warning') AS BIGINT)
AS warning, CAST(count(*) FILTER (status = 'error') AS BIGINT) AS error, CAST(count(*) FILTER (status = 'info') AS BIGINT) AS info,
CAST(count(*) AS BIGINT) AS total, CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'error' WHEN count(*) FILTER
(status = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS status FROM ({}) GROUP BY page_id"""
query("findings_summary", _SUMMARY.format(_FINDINGS_SQL))(
    lambda s, d: FD.summarize_findings(seo.audit_pages(_facts(s, d)), S.product_pages(s, d)))
query("findings_rollup", f"""SELECT id, status, CAST(count(*) AS BIGINT) AS n, CAST(grouping(id, status) AS BIGINT) AS level
FROM ({_FINDINGS_SQL}) GROUP BY ROLLUP (id, status)""")(
    lambda s, d: FD.rollup_findings(seo.audit_pages(_facts(s, d)), S.product_pages(s, d), []))
query("heading_skips", "SELECT p_partkey AS page_id, 1 AS \"from\", 3 AS \"to\", 1 AS pos, 'Details' AS text FROM part WHERE p_partkey % 6 = 0")(
    lambda s, d: seo.heading_skip(_facts(s, d)))


def _audit_json(facts: DataFrame) -> DataFrame:
    return audit_json(facts, seo.audit_pages(facts), tool="t")


query("audit_documents", f"""SELECT page_id, 't' AS tool, 'https://shop.example.com/part/' || page_id AS url, p_name || ' & more' AS title, status,
  CAST(error AS VARCHAR) AS errors, CAST(warning AS VARCHAR) AS warnings, CAST(total AS INTEGER) AS findings FROM ({_SUMMARY.format(_FINDINGS_SQL)})
JOIN part ON p_partkey = page_id""")(lambda s, d: _audit_json(written(_facts(s, d))).selectExpr(
    "page_id", "get_json_object(json, '$.tool') AS tool", "get_json_object(json, '$.url') AS url", "get_json_object(json, '$.page.title') AS title",
    "get_json_object(json, '$.summary.status') AS status", "get_json_object(json, '$.summary.error') AS errors",
    "get_json_object(json, '$.summary.warning') AS warnings", "json_array_length(get_json_object(json, '$.findings')) AS findings"))
query("social_previews", f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' & more' END AS title,
  CASE WHEN p_partkey % 4 <> 0 THEN {_DESC} END AS description,
  CASE WHEN p_partkey % 3 = 0 THEN {_SHOP}/img/' || p_partkey || '.png' END AS image, '' AS image_alt,
  'shop.example.com' AS host FROM part""")(lambda s, d: seo.social_preview(_facts(s, d)))
query("seo_link_counts", """SELECT p_partkey AS page_id, 2 AS total, 2 AS internal, 0 AS "external", 1 AS nofollow, 0 AS empty_text
FROM part""")(lambda s, d: X.seo_link_counts(parse_pages(S.product_pages(s, d))).drop("empty_text_samples"))
query("seo_image_counts", """SELECT p_partkey AS page_id, 2 AS total, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS missing_alt,
  CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS decorative_alt FROM part""")(
    lambda s, d: X.seo_image_counts(parse_pages(S.product_pages(s, d))).drop("missing_alt_samples"))


def _blocks(s, d) -> DataFrame:
    return SD.extract_jsonld(parse_pages(S.product_pages(s, d)))


query("jsonld_blocks", """SELECT p_partkey AS page_id, 0 AS block, p_partkey % 11 <> 0 AS ok, CASE WHEN p_partkey % 11 = 0 THEN
  'Invalid JSON' END AS error, CASE WHEN p_partkey % 11 = 0 THEN '{"@type":"Product",' END AS excerpt FROM part""")(
    lambda s, d: _blocks(s, d).drop("raw", "data"))
query("jsonld_types", """SELECT p_partkey AS page_id, 0 AS pos, CASE WHEN p_partkey % 11 = 0 THEN 'Invalid JSON-LD' ELSE 'Unknown' END
AS type FROM part""")(lambda s, d: X.extract_jsonld_types(parse_pages(S.product_pages(s, d))))
_ENTITIES_SQL = """SELECT p_partkey AS page_id, 'json-ld' AS source, e.path, e.type FROM part, (VALUES ('block0@graph[0]', 'Product'),
  ('block0@graph[0].brand', 'Organization'), ('block0@graph[0].offers[0]', 'Offer')) e(path, type) WHERE p_partkey % 11 <> 0"""
query("schema_entities", _ENTITIES_SQL)(
    lambda s, d: SC.flatten_entities(_blocks(s, d)).select("page_id", "source", "path", "type"))
_SCHEMA_SQL = """SELECT p_partkey AS page_id, f.path, f.label, f.status, CASE f.status WHEN 'ok' THEN 'Present.' WHEN 'error' THEN
  'Required by ' || f.type || '.' ELSE 'Recommended for ' || f.type || '.' END AS message FROM part, LATERAL (VALUES
  ('block0@graph[0]', 'Product', 'name', 'ok'), ('block0@graph[0]', 'Product', 'image', 'warning'),
  ('block0@graph[0]', 'Product', 'description', 'warning'), ('block0@graph[0]', 'Product', 'offers', 'ok'),
  ('block0@graph[0]', 'Product', 'sku', CASE WHEN p_partkey % 2 = 0 THEN 'ok' ELSE 'warning' END),
  ('block0@graph[0]', 'Product', 'brand', 'ok'), ('block0@graph[0].brand', 'Organization', 'name', 'ok'),
  ('block0@graph[0].brand', 'Organization', 'url', 'warning'), ('block0@graph[0].brand', 'Organization', 'logo', 'warning'),
  ('block0@graph[0].brand', 'Organization', 'sameAs', 'warning'), ('block0@graph[0].offers[0]', 'Offer', 'price', 'ok'),
  ('block0@graph[0].offers[0]', 'Offer', 'priceCurrency', CASE WHEN p_partkey % 3 = 0 THEN 'ok' ELSE 'error' END),
  ('block0@graph[0].offers[0]', 'Offer', 'availability', 'warning'), ('block0@graph[0].offers[0]', 'Offer', 'url', 'warning')
) f(path, type, label, status) WHERE p_partkey % 11 <> 0"""
query("schema_findings", _SCHEMA_SQL)(
    lambda s, d: SC.validate_entities(SC.flatten_entities(_blocks(s, d), raw=False)).select("page_id", "path", "label", "status", "message"))


query("schema_summary", """SELECT p_partkey AS page_id, CAST(CASE WHEN bad THEN 0 ELSE 3 END AS BIGINT) AS entities,
  CASE WHEN bad THEN '' ELSE 'Product, Organization, Offer' END AS types,
  CAST(CASE WHEN bad THEN 1 WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS errors,
  CAST(CASE WHEN bad THEN 0 WHEN p_partkey % 2 = 0 THEN 7 ELSE 8 END AS BIGINT) AS warnings,
  CAST(CASE WHEN bad THEN 1 ELSE 0 END AS BIGINT) AS parse_errors,
  CASE WHEN bad OR p_partkey % 3 <> 0 THEN 'error' ELSE 'warning' END AS status
FROM (SELECT *, p_partkey % 11 = 0 AS bad FROM part)""")(
    lambda s, d: SC.summarize_pages(parse_pages(S.product_pages(s, d))).withColumn("types", F.array_join("types", ", ")))

query("microdata", """SELECT p_partkey AS page_id, 0 AS item, m.type, m.prop, m.value, m.nested FROM part, LATERAL (VALUES
  ('https://schema.org/Product', 'name', p_name, false), ('https://schema.org/Product', 'offers', NULL, true),
  ('https://schema.org/Offer', 'price', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), false),
  ('https://schema.org/Product', 'url', 'https://shop.example.com/p/' || p_partkey, false),
  (CASE WHEN p_partkey % 2 = 0 THEN 'https://schema.org/Product' END, 'sku', CAST(p_partkey AS VARCHAR), false),
  (CASE WHEN p_partkey % 2 = 0 THEN 'https://schema.org/Product' END, 'mpn', CAST(p_partkey AS VARCHAR), false)
) m(type, prop, value, nested) WHERE m.type IS NOT NULL""")(
    lambda s, d: SD.extract_microdata(parse_pages(S.microdata_pages(s, d))).selectExpr(
        "page_id", "CAST(item AS INT) AS item", "type", "prop", "value", "nested IS NOT NULL AS nested"))


query("nested_items", """SELECT s_suppkey AS page_id, m.item, m.type, m.id, m.prop, m.value, m.depth FROM supplier, LATERAL (
  SELECT 0 AS item, 'https://schema.org/OnlineBusiness' AS type, 'urn:' || s_suppkey AS id, 'name' AS prop, s_name AS value, 0 AS depth
  UNION ALL SELECT 0, 'https://schema.org/OnlineBusiness', 'urn:' || s_suppkey, 'review', 'good', 0
  UNION ALL SELECT 0, 'https://schema.org/OnlineBusiness', 'urn:' || s_suppkey, 'review', CAST(s_suppkey AS VARCHAR), 0
  UNION ALL SELECT 0, 'https://schema.org/OnlineBusiness', 'urn:' || s_suppkey, 'about', NULL, 0
  UNION ALL SELECT 0, 'Thing', '', 'level', CAST(i AS VARCHAR), i FROM (SELECT unnest(range(1, CAST(s_suppkey % 30 + 2 AS BIGINT))) AS i)
  UNION ALL SELECT 0, 'Thing', '', 'about', NULL, i FROM (SELECT unnest(range(1, CAST(s_suppkey % 30 + 1 AS BIGINT))) AS i)
  UNION ALL SELECT 1, 'Empty', '', NULL, NULL, 0) m""")(
    lambda s, d: SD.extract_microdata(parse_pages(S.review_pages(s, d))).selectExpr(
        "page_id", "item", "type", "id", "prop", "value", "CAST(if(type <> 'Thing', 0, (scope - min(if(type = 'Thing', scope, NULL)) OVER (PARTITION BY page_id)) / 4 + 1) AS BIGINT) AS depth"))
query("microdata_findings", """SELECT s_suppkey AS page_id, f.path, f.label, f.status FROM supplier, (VALUES ('item0', 'name', 'ok'), ('item0', 'url', 'warning'),
  ('item0', 'logo', 'warning'), ('item0', 'sameAs', 'warning'), ('item1', 'Empty', 'info')) f(path, label, status)""")(
    lambda s, d: SC.validate_entities(SC.flatten_entities(
        SD.extract_jsonld(parse_pages(S.review_pages(s, d))), SD.extract_microdata(parse_pages(S.review_pages(s, d))))).select("page_id", "path", "label", "status"))
query("schema_reports", """SELECT s_suppkey AS page_id, '# Structured data' || chr(10) || chr(10) || 'URL: https://books.example.com/' || s_suppkey || chr(10) || chr(10) ||
  '## OnlineBusiness (microdata)' || chr(10) || '- [OK] name - Present.' || chr(10) || '- [WARN] url - Recommended for Organization.' || chr(10) ||
  '- [WARN] logo - Recommended for Organization.' || chr(10) || '- [WARN] sameAs - Recommended for Organization.' || chr(10) || chr(10) || '## Empty (microdata)' ||
  chr(10) || '- [INFO] Empty - No rich-result requirements are checked for this type.' AS report FROM supplier""")(
    lambda s, d: schema_report(SC.validate_entities(SC.flatten_entities(
        SD.extract_jsonld(parse_pages(S.review_pages(s, d))), SD.extract_microdata(parse_pages(S.review_pages(s, d))))), S.review_pages(s, d)))
query("deep_entities", f"""SELECT s_suppkey AS page_id, 'block0' || repeat('.part', i) AS path, CASE WHEN i = {S.DEEP - 1} THEN 'Leaf' ELSE 'Part' END AS type,
  CAST(i AS INTEGER) AS level FROM supplier, (SELECT unnest(range(0, {S.DEEP})) AS i)""")(
    lambda s, d: SD.flatten_jsonld(SD.extract_jsonld(parse_pages(S.deep_pages(s, d))), raw=False).select("page_id", "path", "type", "level"))
query("schema_documents", """SELECT p_partkey AS page_id, 'Product' AS type, 'item0' AS path, CAST(0 AS BIGINT) AS failed, p_name AS name,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, 'https://schema.org/Offer' AS inner_type, 'https://shop.example.com/p/' || p_partkey AS url,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS sku, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 4 END AS warnings, 'Present.' AS first_message
FROM part""")(
    lambda s, d: schema_documents(SC.structured_pages(parse_pages(S.microdata_pages(s, d)), raw=True)).selectExpr(
        "page_id", *[f"get_json_object(json, '$.entities[0].{path}') AS {name}" for name, path in {
            "type": "type", "path": "path", "name": "properties.name", "price": "properties.offers.properties.price",
            "inner_type": "properties.offers.type", "url": "properties.url", "sku": "properties.sku", "first_message": "findings[0].message"}.items()],
        "CAST(get_json_object(json, '$.entities[0].warnings') AS INT) AS warnings", "CAST(json_array_length(get_json_object(json, '$.parseErrors')) AS BIGINT) AS failed"))


# --- tables ---------------------------------------------------------------------------------------

_R = "(p_size % 4 + 1)"
_CELLS_SQL = f"""SELECT page_id, "row", "cell", text, colspan, rowspan, header FROM (
  SELECT p_partkey AS page_id, 0 AS "row", 0 AS "cell", p_name AS text, 2 AS colspan, 1 AS rowspan, true AS header FROM part
  UNION ALL SELECT p_partkey, 0, 1, 'n', 1, 1, true FROM part
  UNION ALL SELECT p_partkey, 1, 0, p_type, 1, {_R}, false FROM part
  UNION ALL SELECT p_partkey, i + 1, CASE WHEN i = 0 THEN 1 ELSE 0 END, CAST(i AS VARCHAR), 1, 1, false
    FROM part, LATERAL (SELECT unnest(range(0, {_R})) AS i)
  UNION ALL SELECT p_partkey, i + 1, CASE WHEN i = 0 THEN 2 ELSE 1 END, '=' || (p_partkey + i), 1, 1, false
    FROM part, LATERAL (SELECT unnest(range(0, {_R})) AS i)
  UNION ALL SELECT p_partkey, {_R} + 1, 0, '', 3, 1, false FROM part)"""


def _cells(s, d) -> DataFrame:
    return TB.extract_tables(parse_pages(S.table_pages(s, d)))[1]


def _grid_rows(s, d) -> DataFrame:
    return tables.grid_rows(TB.page_tables(parse_pages(S.table_pages(s, d))))


query("table_cells", _CELLS_SQL.replace('"row", "cell", text, colspan, rowspan, header FROM', 'CAST("row" AS INTEGER) AS "row", '
      'CAST("cell" AS INTEGER) AS "cell", text, CAST(colspan AS INTEGER) AS colspan, CAST(rowspan AS INTEGER) AS rowspan, header FROM', 1))(
    lambda s, d: _cells(s, d).selectExpr("page_id", "CAST(row AS INT) AS row", "CAST(cell AS INT) AS cell", "text",
                                         "CAST(colspan AS INT) AS colspan", "CAST(rowspan AS INT) AS rowspan", "header"))
_GRID_SQL = f"""SELECT page_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, value FROM (
  SELECT p_partkey AS page_id, 0 AS "row", c.col, CASE WHEN c.col < 2 THEN p_name ELSE 'n' END AS value FROM part, (VALUES (0), (1), (2)) c(col)
  UNION ALL SELECT p_partkey, i + 1, c.col, CASE c.col WHEN 0 THEN p_type WHEN 1 THEN CAST(i AS VARCHAR) ELSE '=' || (p_partkey + i) END
    FROM part, LATERAL (SELECT unnest(range(0, {_R})) AS i), (VALUES (0), (1), (2)) c(col)
  UNION ALL SELECT p_partkey, {_R} + 1, c.col, '' FROM part, (VALUES (0), (1), (2)) c(col))"""
query("table_grid", _GRID_SQL)(lambda s, d: tables.grid_cells(_grid_rows(s, d)).select("page_id", "row", "col", "value"))
query("trimmed_grid", f"SELECT * FROM ({_GRID_SQL}) WHERE value <> ''")(
    lambda s, d: tables.grid_cells(tables.trimmed_rows(_grid_rows(s, d))).select("page_id", "row", "col", "value"))
query("grid_measures", f"""SELECT p_partkey AS page_id, {_R} + 2 AS "rows", 3 AS "columns", CAST(3 * ({_R} + 2) AS BIGINT) AS cells,
  CAST(3 AS BIGINT) AS empty FROM part""")(
    lambda s, d: tables.grid_measures(_grid_rows(s, d)).drop("table_index"))
query("table_labels", "SELECT p_partkey AS page_id, 'Table 1 - ' || p_brand AS label FROM part")(
    lambda s, d: tables.describe_table(TB.extract_tables(parse_pages(S.table_pages(s, d)))[0]).select("page_id", "label"))
query("table_csv", f"""SELECT page_id, "row", string_agg(CASE WHEN value LIKE '=%' THEN chr(39) || value ELSE value END, ';' ORDER BY col)
AS line FROM ({_GRID_SQL}) GROUP BY page_id, "row" """)(
    lambda s, d: tables.grid_lines(_grid_rows(s, d), ";").select("page_id", "row", "line"))

query("long_tables", """SELECT l_suppkey AS page_id, CAST(count(*) AS INTEGER) AS "rows", 2 AS "columns", CAST(2 * count(*) AS BIGINT) AS cells,
  CAST(0 AS BIGINT) AS empty FROM lineitem GROUP BY l_suppkey""")(
    lambda s, d: tables.grid_measures(tables.grid_rows(TB.page_tables(parse_pages(S.long_table_pages(s, d))))).drop("table_index"))


# --- Markdown -------------------------------------------------------------------------------------

_MARKDOWN_SQL = """SELECT p_partkey AS page_id, '# ' || p_name || chr(10) || chr(10) || 'It is **' || p_type || '** and *' || p_size ||
  '* big; see [' || p_brand || '](https://shop.example.com/b/' || p_partkey || ').' || chr(10) || chr(10) || '- one' || chr(10) || '- two' ||
  chr(10) || '  ' || p_size || '. ' || p_partkey || chr(10) || '  ' || (p_size + 1) || '. x\\_y' || chr(10) || chr(10) || '> ' ||
  trim(repeat('lorem ipsum ', 20)) || chr(10) || chr(10) || '```sql' || chr(10) || 'select ' || p_partkey || chr(10) || '```' || chr(10) ||
  chr(10) || '---' || chr(10) || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | a\\|b |' ||
  chr(10) AS markdown FROM part"""
query("page_markdown", _MARKDOWN_SQL)(
    lambda s, d: MD.page_markdown(parse_pages(S.article_pages(s, d))).drop("url"))


def _page_documents(s, d) -> DataFrame:
    path = f"{shared_folder(s)}/documents"
    documents.write_documents(documents.document_names(MD.page_markdown(parse_pages(S.article_pages(s, d))), "markdown", "md", "DATE'2024-01-02'"), path, "markdown")
    return documents.read_documents(s, path)


query("page_documents", f"""SELECT 'shop.example.com/markdown-shop-example-com-2024-01-02-' || page_id || '.md' AS name, markdown AS text
FROM ({_MARKDOWN_SQL})""")(_page_documents)


# --- storefronts ----------------------------------------------------------------------------------


def _stores(s, d) -> DataFrame:
    return ST.extract_store(parse_pages(S.store_pages(s, d)))


_CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"
_VARIANTS_SQL = f"""SELECT p_partkey AS page_id, i AS pos, CAST(p_partkey * 10 + i AS VARCHAR) AS id, 'V' || i AS title,
  CASE WHEN i = 1 THEN '' ELSE 'S' || p_partkey || '-' || i END AS sku, {_CENTS} + i * 100 AS price,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey + i) % 4 <> 0 END AS available
FROM part, LATERAL (SELECT unnest(range(0, p_size % 3 + 1)) AS i)"""
query("store_variants", _VARIANTS_SQL.replace("i AS pos", "CAST(i AS INTEGER) AS pos"))(
    lambda s, d: ST.extract_variants(_stores(s, d)).select("page_id", "pos", "id", "title", "sku", "price", "available"))
query("price_ranges", f"SELECT page_id, min(price) AS \"min\", max(price) AS \"max\" FROM ({_VARIANTS_SQL}) GROUP BY page_id")(
    lambda s, d: store.price_range(ST.extract_variants(_stores(s, d))))
query("variant_counts", f"""SELECT page_id, CAST(count(*) AS BIGINT) AS variants, CAST(count(*) FILTER (available) AS BIGINT) AS available,
  CAST(count(*) FILTER (sku = '') AS BIGINT) AS missing_sku FROM ({_VARIANTS_SQL}) GROUP BY page_id""")(
    lambda s, d: store.variant_counts(ST.extract_variants(_stores(s, d))))
query("variant_view", f"""SELECT page_id, title AS variant, CASE WHEN sku = '' THEN '-' ELSE sku END AS sku,
  CAST(CAST(price AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2)) || '' AS price, CASE WHEN available IS NULL THEN '-' WHEN available THEN 'yes'
  ELSE 'out' END AS stock FROM ({_VARIANTS_SQL})""")(
    lambda s, d: store.variant_view(ST.extract_variants(_stores(s, d))).drop("pos"))
query("storefronts", """SELECT p_partkey AS page_id, true AS is_store, 'high' AS confidence,
  'window.Shopify | shop: shop' || (p_partkey % 10) || '.example.com | cdn.shopify.com' AS evidence FROM part""")(
    lambda s, d: store.detect_storefront(_stores(s, d)).withColumn("evidence", F.array_join("evidence", " | ")))
query("platform_features", "SELECT p_partkey AS page_id, 'theme-app-extensions' AS id FROM part")(
    lambda s, d: store.detect_platform_features(_stores(s, d)).select("page_id", "id"))
query("store_apps", "SELECT p_partkey AS page_id, 'klaviyo' AS id, 'Klaviyo' AS name FROM part WHERE p_partkey % 3 = 0")(
    lambda s, d: D.detect_apps(_stores(s, d)).select("page_id", "id", "name"))
query("product_media", """SELECT p_partkey AS page_id, pos, 'https://store.example.com/' || f || '.jpg' AS src FROM part,
  (VALUES (0, 'a'), (1, 'b'), (2, 'c')) v(pos, f) WHERE pos = 0 OR p_partkey % 2 = 0""")(
    lambda s, d: ST.extract_product_media(_stores(s, d)))
_STORE_FINDINGS_SQL = f"""WITH v AS (SELECT page_id, count(*) AS n, count(*) FILTER (available) AS a, bool_or(available IS NOT NULL) AS known,
  count(*) FILTER (sku = '') AS nosku FROM ({_VARIANTS_SQL}) GROUP BY page_id)
SELECT p_partkey AS page_id, f.id, f.status FROM part JOIN v ON v.page_id = p_partkey, LATERAL (VALUES
  ('theme-role', CASE WHEN p_partkey % 6 = 0 THEN 'warning' END), ('meta-description', 'warning'),
  ('few-images', CASE WHEN p_partkey % 2 = 1 THEN 'warning' END),
  ('thin-description', CASE WHEN p_size * 4 < 120 THEN 'warning' END),
  ('out-of-stock', CASE WHEN known AND a = 0 THEN 'error' END), ('partial-stock', CASE WHEN known AND n > 1 AND a > 0 AND a < n THEN 'info' END),
  ('missing-sku', CASE WHEN nosku > 0 THEN 'warning' END), ('on-sale', CASE WHEN p_partkey % 4 = 0 THEN 'info' END),
  ('no-vendor', CASE WHEN p_partkey % 9 = 0 THEN 'info' END)) f(id, status) WHERE f.status IS NOT NULL"""
query("store_findings", _STORE_FINDINGS_SQL)(lambda s, d: store.audit_store(_stores(s, d)).select("page_id", "id", "status"))
query("store_summary", f"""SELECT page_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'error') AS BIGINT) AS errors,
  CAST(count(*) FILTER (status = 'warning') AS BIGINT) AS warnings, CAST(count(*) FILTER (status = 'info') AS BIGINT) AS infos,
  CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'error' WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warning' ELSE 'ok' END
  AS status FROM ({_STORE_FINDINGS_SQL}) GROUP BY page_id""")(
    lambda s, d: store.summarize_store(store.audit_store(_stores(s, d)), S.store_pages(s, d)))
query("store_rows", f"""WITH v AS (SELECT page_id, count(*) AS n, count(*) FILTER (available) AS a, bool_or(available IS NOT NULL) AS known,
  min(price) AS lo, max(price) AS hi FROM ({_VARIANTS_SQL}) GROUP BY page_id)
SELECT p_partkey AS page_id, r.section, r.field, r.value FROM part JOIN v ON v.page_id = p_partkey, LATERAL (VALUES
  ('Store', 'Shop', 'shop' || (p_partkey % 10) || '.example.com'), ('Store', 'Currency', '(unknown)'), ('Store', 'Customer', 'Guest'),
  ('Theme', 'Theme', 'Dawn'), ('Theme', 'Origin', 'Custom theme'), ('Theme', 'Role', CASE WHEN p_partkey % 6 = 0 THEN 'development' ELSE 'main' END),
  ('Page', 'Page type', 'product'), ('Product', 'Title', p_name), ('Product', 'Product ID', CAST(p_partkey + 1 AS VARCHAR)),
  ('Product', 'Vendor', CASE WHEN p_partkey % 9 <> 0 THEN p_brand END), ('Product', 'Variants', CAST(n AS VARCHAR)),
  ('Product', 'In stock', CASE WHEN known THEN a || ' of ' || n END),
  ('Product', 'Images', CASE WHEN p_partkey % 2 = 0 THEN '3' ELSE '1' END),
  ('Product', 'Price', CASE WHEN lo = hi THEN CAST(lo / 100 AS DECIMAL(20,2)) || '' ELSE CAST(lo / 100 AS DECIMAL(20,2)) || ' - ' ||
    CAST(hi / 100 AS DECIMAL(20,2)) END),
  ('Product', 'Compare at', CASE WHEN p_partkey % 4 = 0 THEN CAST({_CENTS} * 2 / 100 AS DECIMAL(20,2)) || '' END),
  ('Apps', CASE WHEN p_partkey % 3 = 0 THEN 'Klaviyo' END, 'detected')) r(section, field, value)
WHERE r.field IS NOT NULL AND r.value IS NOT NULL""")(lambda s, d: store_rows(store.describe_store(_stores(s, d)), D.detect_apps(_stores(s, d))))

query("offer_values", f"""SELECT p_partkey, {_CENTS} AS cents, p_partkey % 3 <> 1 AS available, CASE WHEN p_partkey % 50 > 0 THEN
  CAST(round(CAST(p_partkey % 50 * 10000 AS DOUBLE) / ({_CENTS} + p_partkey % 50 * 100)) AS INTEGER) END AS discount FROM part""")(
    lambda s, d: _read(s, d, "part").selectExpr("p_partkey", """parse_json(concat('{"offers":', if(p_partkey % 2 = 0, '[', ''), '{"', if(p_partkey % 3 = 0,
      'lowPrice', 'price'), '":"', CAST(p_retailprice AS DECIMAL(12, 2)), '","availability":"https://schema.org/', element_at(array('InStock',
      'OutOfStock', 'PreOrder'), CAST(p_partkey % 3 + 1 AS INT)), '"}', if(p_partkey % 2 = 0, ']', ''), '}')) AS node""").selectExpr(
        "p_partkey", f"{offer_price_cents('node')} AS cents", f"{offer_available('node')} AS available").selectExpr(
        "*", f"{discount_percent('cents', '(cents + p_partkey % 50 * 100)')} AS discount"))


# --- trackers and technologies --------------------------------------------------------------------


def _tracking(s, d) -> DataFrame:
    return G.tracking_signals(parse_pages(S.tagged_pages(s, d)))


_TRACKERS_SQL = """SELECT s_suppkey AS page_id, t.id, t.tracker, t.category, t.evidence FROM supplier, LATERAL (VALUES
  ('gtm', CASE WHEN s_suppkey % 2 = 0 THEN 'Google Tag Manager' END, 'tag-manager', 'googletagmanager.com'),
  ('meta', CASE WHEN s_suppkey % 3 = 0 THEN 'Meta Pixel' END, 'advertising', 'window.fbq'),
  ('onetrust', CASE WHEN s_suppkey % 4 = 0 THEN 'OneTrust' END, 'consent', 'cdn.cookielaw.org'),
  ('hotjar', CASE WHEN s_suppkey % 6 = 0 THEN 'Hotjar' END, 'session', 'static.hotjar.com')) t(id, tracker, category, evidence)
WHERE t.tracker IS NOT NULL"""
query("trackers", f"SELECT page_id, tracker, category, evidence FROM ({_TRACKERS_SQL})")(
    lambda s, d: tracker_rows(D.detect_trackers(_tracking(s, d))).drop("ordinal"))
query("tracker_summary", f"""SELECT s_suppkey AS page_id, CAST(coalesce(n, 0) AS BIGINT) AS total, coalesce(c, false) AS has_consent,
  coalesce(a, false) AS needs_consent, CASE WHEN a AND NOT c THEN 'warning' WHEN n > 0 THEN 'info' ELSE 'ok' END AS status
FROM supplier LEFT JOIN (SELECT page_id, count(*) AS n, bool_or(category = 'consent') AS c, bool_or(category IN ('advertising', 'session'))
AS a FROM ({_TRACKERS_SQL}) GROUP BY page_id) ON page_id = s_suppkey""")(
    lambda s, d: D.summarize_trackers(D.detect_trackers(_tracking(s, d)), S.tagged_pages(s, d)).drop("by_category"))
query("tracker_categories", f"""SELECT page_id, category, CAST(count(*) AS BIGINT) AS n FROM ({_TRACKERS_SQL}) GROUP BY ALL""")(
    lambda s, d: D.summarize_trackers(D.detect_trackers(_tracking(s, d))).selectExpr(
        "page_id", "explode(by_category) AS (category, n)"))
query("consent_gaps", """SELECT s_suppkey AS page_id FROM supplier WHERE (s_suppkey % 3 = 0 OR s_suppkey % 6 = 0) AND s_suppkey % 4 <> 0""")(
    lambda s, d: D.consent_gaps(D.detect_trackers(_tracking(s, d))))
_IDS_SQL = """SELECT s_suppkey AS page_id, i.label, i.value FROM supplier, LATERAL (VALUES
  ('GA4 measurement', CASE WHEN s_suppkey % 2 = 0 THEN 'G-ABCDEF' || (s_suppkey % 7) END),
  ('Meta Pixel', CASE WHEN s_suppkey % 3 = 0 THEN '10000' || (s_suppkey % 5) END)) i(label, value) WHERE i.value IS NOT NULL"""
query("tag_ids", _IDS_SQL)(lambda s, d: D.extract_tag_ids(_tracking(s, d)).drop("pos"))
query("tag_id_kinds", """SELECT s_suppkey AS page_id, i.label, i.value FROM supplier, LATERAL (VALUES ('GTM container', 'GTM-AB' || (1000 + s_suppkey)),
  ('GA4 measurement', 'G-ABCD' || (1000 + s_suppkey)), ('Universal Analytics', 'UA-' || (10000 + s_suppkey) || '-1'),
  ('Google Ads', 'AW-' || (1000000 + s_suppkey)), ('Floodlight', 'DC-' || (2000000 + s_suppkey)), ('Meta Pixel', CAST(3000000 + s_suppkey AS VARCHAR)),
  ('Hotjar site', CAST(40000 + s_suppkey AS VARCHAR)), ('Clarity project', 'abc' || (1000 + s_suppkey))) i(label, value)""")(
    lambda s, d: D.extract_tag_ids(G.tracking_signals(parse_pages(S.tag_id_pages(s, d)))).drop("pos"))
query("jsonld_top_types", """SELECT s_suppkey AS page_id, t.pos, t.type FROM supplier, (VALUES (0, 'Product'), (1, 'Article, NewsArticle'), (2, 'Person')) t(pos, type)
  WHERE t.pos < 2 OR s_suppkey % 2 = 0""")(lambda s, d: X.extract_jsonld_types(parse_pages(S.tag_id_pages(s, d))))
query("shared_tag_ids", f"""WITH x AS (SELECT label, value, 'site' || (page_id % 9) || '.example.com' AS host, count(*) AS pages FROM ({_IDS_SQL})
  GROUP BY ALL) SELECT label, value, host, CAST(pages AS BIGINT) AS pages, CAST(count(*) OVER (PARTITION BY label, value) AS BIGINT) AS hosts
FROM x QUALIFY count(*) OVER (PARTITION BY label, value) > 1""")(
    lambda s, d: C.shared_tag_ids(D.extract_tag_ids(C.with_host(_tracking(s, d)), carry=["host"])))
query("tracker_prevalence", f"""SELECT host, id, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) AS DOUBLE) / any_value(total) AS share
FROM (SELECT 'site' || (page_id % 9) || '.example.com' AS host, id FROM ({_TRACKERS_SQL})) JOIN (SELECT 'site' || (s_suppkey % 9) ||
'.example.com' AS host, count(*) AS total FROM supplier GROUP BY 1) USING (host) GROUP BY host, id""")(
    lambda s, d: C.prevalence(D.detect_trackers(C.with_host(_tracking(s, d)), carry=["host"]), S.tagged_pages(s, d), ["host"]))
query("tracker_cube", f"""SELECT category, host, CAST(count(*) AS BIGINT) AS n, CAST(grouping(category, host) AS BIGINT) AS level FROM (
  SELECT category, 'site' || (page_id % 9) || '.example.com' AS host FROM ({_TRACKERS_SQL})) GROUP BY CUBE (category, host)""")(
    lambda s, d: C.category_cube(D.detect_trackers(C.with_host(_tracking(s, d)), carry=["host"])))
query("tracker_reports", f"""SELECT page_id, 'Trackers on https://site' || (page_id % 9) || '.example.com/' || page_id || chr(10) || chr(10) ||
  string_agg('## ' || c.label || chr(10) || '- ' || tracker || ' (' || evidence || ')', chr(10) || chr(10) ORDER BY c.o) AS report FROM ({_TRACKERS_SQL}) JOIN (VALUES
  ('consent', 'Consent management', 0), ('tag-manager', 'Tag managers', 1), ('advertising', 'Advertising', 3), ('session', 'Session replay & heatmaps', 4)
  ) c(category, label, o) USING (category) GROUP BY page_id""")(lambda s, d: tracker_report(
    D.group_by_category(D.detect_trackers(_tracking(s, d)), TRACKER_CATEGORIES), S.tagged_pages(s, d)))

query("cookie_trackers", """SELECT s_suppkey AS page_id, t.id, t.evidence FROM supplier, LATERAL (VALUES
  ('ga4', CASE WHEN s_suppkey % 2 = 0 THEN 'cookie _ga' END), ('hotjar', CASE WHEN s_suppkey % 5 = 0 THEN 'cookie _hjSessionUser' END)) t(id, evidence)
WHERE t.evidence IS NOT NULL""")(
    lambda s, d: D.detect_trackers(G.tracking_signals(parse_pages(S.tagged_pages(s, d)), S.captured_cookies(s, d))).selectExpr(
        "page_id", "id", "explode(filter(evidence, e -> startswith(e, 'cookie'))) AS evidence"))


def _stack(s, d) -> DataFrame:
    return D.detect_stack(G.stack_signals(parse_pages(S.tagged_pages(s, d))))


_STACK_SQL = """SELECT s_suppkey AS page_id, t.id, t.version, t.confidence, t.evidence FROM supplier, LATERAL (VALUES
  ('next', s_suppkey % 5 = 0, '', 'low', '/_next/'),
  ('wordpress', s_suppkey % 7 = 0, '', 'high', '/wp-content/ | generator: WordPress 6.1'),
  ('angular', s_suppkey % 22 = 0, '17.1', 'low', 'DOM: ng-version'),
  ('angularjs', s_suppkey % 11 = 0 AND s_suppkey % 22 <> 0, '', 'low', 'window.angular')) t(id, found, version, confidence, evidence)
WHERE t.found"""
query("technologies", _STACK_SQL)(lambda s, d: _stack(s, d).selectExpr(
    "page_id", "id", "version", "confidence", "array_join(evidence, ' | ') AS evidence"))
query("confident_technologies", f"SELECT page_id, id FROM ({_STACK_SQL}) WHERE confidence = 'high'")(
    lambda s, d: D.confident_only(_stack(s, d)).select("page_id", "id"))
query("stack_summary", f"""SELECT s_suppkey AS page_id, CAST(coalesce(n, 0) AS BIGINT) AS total, CAST(coalesce(c, 0) AS BIGINT) AS confident
FROM supplier LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (confidence = 'high') AS c FROM ({_STACK_SQL}) GROUP BY page_id)
ON page_id = s_suppkey""")(lambda s, d: D.summarize_stack(_stack(s, d), S.tagged_pages(s, d)).drop("by_category"))
query("stack_reports", f"""SELECT page_id, 'Tech stack of https://site' || (page_id % 9) || '.example.com/' || page_id || chr(10) || chr(10) ||
  string_agg('## ' || c.label || chr(10) || '- ' || c.name || CASE WHEN version = '' THEN '' ELSE ' ' || version END, chr(10) || chr(10) ORDER BY c.o) AS report
  FROM ({_STACK_SQL}) JOIN (VALUES ('angular', 'Angular', 'JavaScript frameworks', 0), ('angularjs', 'AngularJS', 'JavaScript frameworks', 0),
  ('next', 'Next.js', 'Meta frameworks', 1), ('wordpress', 'WordPress', 'CMS & site builders', 2)) c(id, name, label, o) USING (id) GROUP BY page_id""")(lambda s, d: stack_report(D.group_by_category(_stack(s, d), STACK_CATEGORIES), S.tagged_pages(s, d)))
query("page_signals", """SELECT s_suppkey AS page_id, x.kind, x.value FROM supplier, LATERAL (VALUES
  ('script', CASE WHEN s_suppkey % 2 = 0 THEN 'https://www.googletagmanager.com/gtag/js?id=G-ABCDEF' || (s_suppkey % 7) END),
  ('script', CASE WHEN s_suppkey % 4 = 0 THEN 'https://cdn.cookielaw.org/x.js' END),
  ('script', CASE WHEN s_suppkey % 5 = 0 THEN 'https://site' || (s_suppkey % 9) || '.example.com/_next/static/a.js' END),
  ('global', CASE WHEN s_suppkey % 3 = 0 THEN 'dataLayer' END), ('global', CASE WHEN s_suppkey % 3 = 0 THEN 'fbq' END),
  ('iframe', CASE WHEN s_suppkey % 6 = 0 THEN 'https://static.hotjar.com/h' ELSE 'https://evilhotjar.com/' END)) x(kind, value)
WHERE x.value IS NOT NULL""")(
    lambda s, d: G.extract_tracking_signals(parse_pages(S.tagged_pages(s, d))).select("page_id", "kind", "value"))


# --- links ----------------------------------------------------------------------------------------


def _links(s, d) -> DataFrame:
    return LK.annotate_links(X.extract_links(parse_pages(S.linked_pages(s, d))))


_LINK_SQL = """SELECT c_custkey AS page_id, l.url, l.text, l.type, l.rel, l.target, l.nofollow FROM customer, LATERAL (VALUES
  ('https://crm.example.com/c/' || (c_custkey + 1), c_name, 'internal', CASE WHEN c_custkey % 5 = 0 THEN 'ugc nofollow' ELSE '' END, '',
    CASE WHEN c_custkey % 5 = 0 THEN 'yes' ELSE 'no' END),
  ('https://partner.example.org/' || c_nationkey, 'Partner', 'external', '', '_blank', 'no'),
  ('https://crm.example.com.evil.test/', 'look', 'external', '', '', 'no'), ('mailto:a@example.com', 'mail', 'mailto', '', '', 'no'),
  ('tel:+1', 'call', 'tel', '', '', 'no'), ('https://crm.example.com/c/' || c_custkey || '#top', 'top', 'anchor', '', '', 'no'),
  ('javascript:void(0)', 'run', 'script', '', '', 'no'),
  ('https://crm.example.com/c/' || (c_custkey + 1), CASE WHEN c_custkey % 3 = 0 THEN 'again' ELSE '' END, 'internal', '', '', 'no'),
  ('ftp://f.example.com/', 'ftp', 'other', '', '', 'no')) l(url, text, type, rel, target, nofollow)"""
query("link_rows", _LINK_SQL)(lambda s, d: LK.link_rows(_links(s, d)).drop("pos"))
query("link_summary", f"""SELECT page_id, CAST(9 AS BIGINT) AS total, CAST(2 AS BIGINT) AS internal, CAST(2 AS BIGINT) AS "external",
  CAST(1 AS BIGINT) AS anchor, CAST(1 AS BIGINT) AS mailto, CAST(1 AS BIGINT) AS tel, CAST(1 AS BIGINT) AS script, CAST(1 AS BIGINT) AS other,
  CAST(count(*) FILTER (nofollow = 'yes') AS BIGINT) AS nofollow, CAST(count(*) FILTER (text = '') AS BIGINT) AS untitled
FROM ({_LINK_SQL}) GROUP BY page_id""")(lambda s, d: LK.summarize_links(_links(s, d), S.linked_pages(s, d)))
query("external_links", f"SELECT * FROM ({_LINK_SQL}) WHERE type = 'external' AND (url ILIKE '%evil%' OR text ILIKE '%evil%')")(
    lambda s, d: LK.link_rows(LK.filter_links(_links(s, d), "external", " EVIL ")).drop("pos"))
query("distinct_links", f"SELECT page_id, url, first(text ORDER BY o) AS text FROM (SELECT *, text = '' OR text = 'again' AS o FROM ({_LINK_SQL})) GROUP BY page_id, url")(
    lambda s, d: LK.link_rows(LK.filter_links(_links(s, d), dedupe=True)).select("page_id", "url", "text"))
query("plain_urls", f"SELECT page_id, url AS value FROM ({_LINK_SQL})")(lambda s, d: LK.plain_urls(_links(s, d)).drop("pos"))
query("link_csv", f"""SELECT page_id, 'url,text,type,rel,target,nofollow' || chr(13) || chr(10) || string_agg(url || ',' || text || ',' || type
  || ',' || rel || ',' || target || ',' || nofollow, chr(13) || chr(10) ORDER BY o) AS document FROM (SELECT *, CASE WHEN text = 'again' OR text = ''
  THEN 8 ELSE list_position(['internal', 'partner', 'look', 'mailto', 'tel', 'anchor', 'script', 'x', 'other'], CASE WHEN text = 'Partner' THEN
  'partner' WHEN text = 'look' THEN 'look' ELSE type END) END AS o FROM ({_LINK_SQL})) GROUP BY page_id""")(
    lambda s, d: csv_documents(LK.link_rows(_links(s, d)), ["url", "text", "type", "rel", "target", "nofollow"], "pos", bom=False))
query("link_graph", """SELECT a.c_custkey AS source_page, 'https://crm.example.com/c/' || (a.c_custkey + 1) AS href, CAST(2 AS BIGINT) AS n,
  b.c_custkey AS target_page FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1
UNION ALL SELECT c_custkey, 'https://crm.example.com/c/' || c_custkey, 1, c_custkey FROM customer""")(
    lambda s, d: C.link_graph(_links(s, d).filter("kind IN ('internal', 'anchor')"), S.linked_pages(s, d)).select(
        "source_page", "href", "n", "target_page"))


# --- events ---------------------------------------------------------------------------------------


def _entries(s, d) -> DataFrame:
    return EV.annotate_entries(S.event_entries(s, d))


_LAYER_SQL = """SELECT event_id AS page_id, l.layer, CAST(l.i AS INTEGER) AS "index", l.event, l.raw FROM events, LATERAL (VALUES
  ('dataLayer', 0, event_type, CASE WHEN event_id % 4 = 0 THEN '{"event":"' || event_type || '","id":' || event_id ||
    ',"a":{"b":{"c":{"d":{"e":{"f":[1,{}]}}}}}}' END),
  ('dataLayer', 0, event_type, CASE WHEN event_id % 4 = 1 THEN '{"event":"' || event_type || '","n":' || event_id || '}' END),
  ('dataLayer', 1, NULL, CASE WHEN event_id % 4 = 1 THEN '"it''s \\"x\\""' END),
  ('dataLayer', 0, event_type, CASE WHEN event_id % 4 = 2 THEN '["event","' || event_type || '",{"value":' || event_id || ',"ok":true}]' END),
  ('_mtm', 0, event_type, CASE WHEN event_id % 4 = 3 THEN '{"event":"' || event_type || '","id":' || event_id || '}' END),
  ('_mtm', 1, NULL, CASE WHEN event_id % 4 = 3 THEN '{"b":null}' END)) l(layer, i, event, raw) WHERE l.raw IS NOT NULL"""
query("layer_entries", _LAYER_SQL)(lambda s, d: EV.annotate_entries(E.extract_layers(parse_pages(S.layer_pages(s, d)))).selectExpr(
    "page_id", "layer", "CAST(index AS INT) AS index", "event", "raw"))


def _layer_documents(s, d) -> DataFrame:
    pages = S.layer_pages(s, d)
    parsed = parse_pages(pages)
    containers = D.extract_tag_ids(G.tracking_signals(parsed)).filter("startswith(value, 'GTM-')").groupBy("page_id").agg(
        F.array_sort(F.collect_set("value")).alias("gtm_containers"))
    return layers_json(E.extract_layers(parsed), pages, "t", containers, "TIMESTAMP'2024-01-02 03:04:05'")


query("layer_documents", f"""SELECT page_id, '{{"tool":"t","version":1,"url":"https://events.example.com/' || page_id ||
  '","capturedAt":"2024-01-02T03:04:05.000Z","containers":[' || CASE WHEN page_id % 3 = 0 THEN '"GTM-ABC' || (page_id % 9) || 'X"' ELSE '' END ||
  '],"layers":[{{"name":"' || layer || '","total":' || count(*) || ',"truncated":false,"entries":[' || string_agg(sorted, ',' ORDER BY "index") || ']}}]}}' AS json
FROM (SELECT *, CASE WHEN page_id % 4 = 0 THEN '{{"a":{{"b":{{"c":{{"d":{{"e":{{"f":[1,{{}}]}}}}}}}}}},' || '"event":"' || event || '","id":' || page_id || '}}'
  WHEN page_id % 4 = 2 THEN replace(raw, '"value":' || page_id || ',"ok":true', '"ok":true,"value":' || page_id) ELSE raw END AS sorted FROM ({_LAYER_SQL}))
GROUP BY page_id, layer""")(_layer_documents)

_ENTRY = "CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END"
query("event_entries", f"""SELECT user_id AS page_id, event_id AS "index", {_ENTRY} AS event, CASE WHEN event_id % 10 = 0 THEN 'value, user'
  ELSE event_type END AS label FROM events""")(lambda s, d: _entries(s, d).select("page_id", "index", "event", "label"))
query("event_counts", "SELECT event_type AS event, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY 1")(
    lambda s, d: EV.rank_events(EV.event_counts(_entries(s, d))))
query("event_summary", """SELECT user_id AS page_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (event_id % 10 <> 0) AS BIGINT) AS events,
  CAST(count(*) FILTER (event_id % 10 = 0) AS BIGINT) AS unnamed FROM events GROUP BY 1""")(
    lambda s, d: EV.summarize_entries(_entries(s, d), ["page_id"]))
_K = "json_extract_string(props, '$.k')"
_LEAVES_SQL = f"""SELECT event_id AS "index", l.path, l.value FROM events, LATERAL (VALUES
  (CASE WHEN event_id % 10 = 0 THEN 'value' END, CAST(event_id AS VARCHAR)), (CASE WHEN event_id % 10 = 0 THEN 'user' END, CAST(user_id AS VARCHAR)),
  (CASE WHEN event_id % 2 = 0 AND event_id % 10 <> 0 THEN 'event' END, event_type), (CASE WHEN event_id % 2 = 0 AND event_id % 10 <> 0 THEN 'props.k' END, {_K}),
  (CASE WHEN event_id % 2 = 0 AND event_id % 10 <> 0 THEN 'tags' END, '[]'), (CASE WHEN event_id % 2 = 1 THEN '0' END, 'event'),
  (CASE WHEN event_id % 2 = 1 THEN '1' END, event_type), (CASE WHEN event_id % 2 = 1 THEN '2.k' END, {_K})) l(path, value) WHERE l.path IS NOT NULL"""
query("event_leaves", _LEAVES_SQL)(lambda s, d: EV.flatten_json(S.event_entries(s, d), "raw", ["index"]).drop("ord"))
query("deep_leaves", f"""SELECT s_suppkey AS page_id, repeat('part.', i) || CASE WHEN i = {S.DEEP} - n THEN 'name' ELSE '@type' END AS path,
  CASE WHEN i < {S.DEEP - 1} THEN 'Part' WHEN n = 0 THEN 'Leaf' ELSE s_name END AS value FROM supplier, (SELECT unnest(range(0, {S.DEEP})) AS i, 0 AS n
  UNION ALL SELECT {S.DEEP - 1}, 1) l""")(
    lambda s, d: EV.flatten_json(S.deep_entries(s, d), "raw", ["page_id"]).drop("ord"))
query("deep_search", "SELECT s_suppkey AS page_id FROM supplier WHERE contains(s_name, '7')")(
    lambda s, d: EV.filter_entries(EV.annotate_entries(S.deep_entries(s, d)), "Part.Name").filter("contains(raw, '7')").select("page_id"))
query("event_search", f"""SELECT user_id AS page_id, event_id AS "index" FROM events WHERE event_id % 10 <> 0 AND event_type = 'click' AND
  event_id IN (SELECT "index" FROM ({_LEAVES_SQL}) WHERE contains(lower(path), '42') OR contains(lower(value), '42'))""")(
    lambda s, d: EV.filter_entries(_entries(s, d), "42", "click").select("page_id", "index"))
query("event_windows", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
  event_type AS event, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")(lambda s, d: EV.event_windows(_read(s, d, "events"), "1 hour"))
query("event_sliding_windows", """SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type AS event, CAST(count(*) AS BIGINT) AS n
FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS w FROM events, (VALUES (0), (1), (2), (3)) v(i)) GROUP BY ALL""")(
    lambda s, d: EV.event_windows(_read(s, d, "events"), "1 hour", "15 minutes"))
query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")(
    lambda s, d: EV.event_sessions(_read(s, d, "events")))
query("first_sightings", """SELECT event_type AS url, min(event_id) AS page_id, props AS html FROM events GROUP BY event_type, props""")(
    lambda s, d: first_sightings(_read(s, d, "events").selectExpr("event_type AS url", "event_id AS page_id", "props AS html", "ts AS captured_at"))
    .select("url", "page_id", "html"))

query("late_events", "SELECT event_id, event_id % 20 > 10 AS late FROM events")(
    lambda s, d: split_late(_read(s, d, "events").withColumn("arrived_at", F.expr("ts + make_dt_interval(0, 0, CAST(event_id % 20 AS INT))"))).select(
        "event_id", "late"))


# --- scalar functions over whole texts ------------------------------------------------------------

query("csv_fields", """SELECT doc_id, CASE WHEN regexp_matches(f, '[,"\\r\\n]') OR f <> trim(f, E' \\t\\n\\r') THEN '"' || replace(f, '"', '""') || '"' ELSE f END AS field
FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+@\\t\\r-]') THEN chr(39) || text ELSE text END AS f FROM documents)""")(
    lambda s, d: _read(s, d, "documents").selectExpr("doc_id", f"{csv_field('text')} AS field"))
query("markdown_escaped", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g'),
  '^(\s*)([-+#])(\s)', '\1\\\2\3'), '^(\s*[0-9]+)([.)])(\s)', '\1\\\2\3') AS escaped FROM documents""")(lambda s, d: _read(s, d, "documents").selectExpr("doc_id", f"{markdown_escape('text')} AS escaped"))
query("document_measures", """SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS words,
  regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS alnum FROM documents""")(
    lambda s, d: _read(s, d, "documents").selectExpr("doc_id", f"{count_words('text')} AS words", f"{normalise_alnum('text')} AS alnum"))
query("clipped_texts", """SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || chr(8230) ELSE t END AS clipped FROM (
  SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")(
    lambda s, d: _read(s, d, "documents").selectExpr("doc_id", f"{clip('text', 80)} AS clipped"))
query("code_spans", """SELECT p_partkey, '``' || p_name || '`' || p_brand || '``' AS code, CAST(length(p_name) AS INTEGER) AS units FROM part""")(
    lambda s, d: _read(s, d, "part").selectExpr("p_partkey", f"{inline_code(chr(99) + 'oncat(p_name, ' + repr('`') + ', p_brand)')} AS code",
                                                f"{js_length('p_name')} AS units"))
query("export_names", f"""SELECT page_id, 'page-audit-' || regexp_replace({_HOST}, '[^a-z0-9]+', '-', 'g') || '-2024-01-02.csv' AS name,
  {_HOST} AS host FROM pages""")(lambda s, d: load_pages(s, d).selectExpr(
    "page_id", f"{export_key(repr('Page audit!'), 'url', repr('.CSV'), 'DATE' + repr('2024-01-02'))} AS name", f"{host_of('url')} AS host"))
query("file_names", """SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''),
  '([^/]+)/*$', 1), '\\.[a-z0-9]{1,5}$', '') AS name FROM pages""")(
    lambda s, d: load_pages(s, d).selectExpr("page_id", f"{file_name_of('url')} AS name"))
query("link_targets", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN u ELSE '<' || u || '>' END AS target FROM (SELECT p_partkey,
  'https://e.example.com/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '/a(b)' WHEN 1 THEN '/a b' ELSE '/ab' END AS u FROM part)""")(
    lambda s, d: _read(s, d, "part").selectExpr("p_partkey", "concat(' https://e.example.com/', p_partkey, element_at(array('/a(b)', '/a b', '/ab'), "
                                                "CAST(p_partkey % 3 + 1 AS INT))) AS u").selectExpr("p_partkey", f"{link_target('u')} AS target"))
