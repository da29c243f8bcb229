"""Scalar expressions: one row per case, one job per table of cases."""

from crawlsift.functions.csv import BOM, csv_field
from crawlsift.functions.json import normalise_type
from crawlsift.functions.markdown import inline_code, link_target, markdown_escape
from crawlsift.functions.money import discount_percent, format_price
from crawlsift.functions.text import clip, decode_entities, js_length, js_trim
from crawlsift.functions.urls import file_name_of, host_of, is_absolute_http_url, normalise_url, parse_base, resolve_url
from crawlsift.operators.tables import resolve_span


def check(spark, cases, expression, schema="x string, want string"):
    rows = spark.createDataFrame(cases, schema).selectExpr("*", f"{expression} AS got").collect()
    assert [(r[:-2], r.got) for r in rows] == [(r[:-2], r.want) for r in rows]


def test_resolve_url(spark):
    cases = [
        ("https://e.com/a/b?q#f", "", "https://e.com/a/b?q"), ("https://e.com/a/b?q", "?z", "https://e.com/a/b?z"),
        ("https://e.com/a/b?q", "#t", "https://e.com/a/b?q#t"), ("https://e.com/a/b", "x/../y é?b c", "https://e.com/a/y%20%C3%A9?b%20c"),
        ("https://e.com/a/", "..", "https://e.com/"), ("https://e.com", "x", "https://e.com/x"),
        ("http://E.com:80/a", "//Foo.COM:443/x", "http://foo.com:443/x"), ("https://e.com", "HTTPS://H:443/../a/./b", "https://h/a/b"),
        ("https://e.com/", "mailto:a@b.c", "mailto:a@b.c"), ("https://e.com/", "https://exa mple.com/", None),
        ("https://e.com/", " \n/tab\tbed ", "https://e.com/tabbed"), ("about:blank", "x", None), ("https://e.com/", "\\\\h.com\\p", "https://h.com/p")]
    check(spark, cases, f"{resolve_url(parse_base(normalise_url('b')), 'h')}", "b string, h string, want string")


def test_hosts_and_absolute_urls(spark):
    check(spark, [("https://U@Example.COM:8080/x", "example.com"), ("mailto:a@b", ""), ("nope", ""), ("https://exa mple.com/", "")], host_of("x"))
    check(spark, [("https://e.com", True), ("HTTP://e.com/x", True), ("ftp://e.com", False), ("//e.com", False), ("https://", False),
                  ("javascript:alert(1)", False), (None, False)], is_absolute_http_url("x"), "x string, want boolean")
    check(spark, [("https://e.com/a/photo-1.png?v=2", "photo-1"), ("data:image/png;base64,xx", ""), ("/x/y/", "y"), (None, "")], file_name_of("x"))


def test_text_lengths_and_trimming(spark):
    check(spark, [("a\U0001f600", 3), ("é", 1), ("", 0)], js_length("x"), "x string, want int")
    check(spark, [("  a \ufeff\n", "a"), (" \t ", ""), ("a b", "a b")], js_trim("x"))
    check(spark, [(" a \n b ", "a b"), ("abcdef", "abcd…"), ("ab\U0001f600\U0001f600", "ab\U0001f600…"), ("abcd", "abcd")], clip("x", 4))
    check(spark, [("   ", None), ("x", "x")], clip("x", 4, "null"))


def test_entities_are_decoded_once(spark):
    check(spark, [("&amp;lt;", "&lt;"), ("&#128512;&#x41;&eacute;", "\U0001f600Aé"), ("a & b &zz; &#0;", "a & b &zz; �"),
                  ("&#146;", "’"), ("?a=1&copy=2", "?a=1&copy=2")], decode_entities("x"))


def test_csv_fields_are_quoted_and_guarded(spark):
    cases = [(None, ""), ("a,b", '"a,b"'), ('say "x"', '"say ""x"""'), ("=1+1", "'=1+1"), ("-5", "'-5"), (" p ", '" p "'), ("a\nb", '"a\nb"'),
             ("@x,y", "\"'@x,y\""), ("plain", "plain"), ("\tx", "'\tx")]
    check(spark, cases, csv_field("x"))
    assert BOM == "\ufeff"


def test_markdown_pieces(spark):
    check(spark, [("a*b_[c]<d>`", "a\\*b\\_\\[c\\]\\<d\\>\\`"), ("- item", "\\- item"), ("1. one", "1\\. one"), ("1) one", "1\\) one"),
                  ("# h", "\\# h"), ("-x", "-x"), ("> q", "\\> q"), ("* s", "\\* s")], markdown_escape("x"))
    check(spark, [("a", "`a`"), ("a`b", "``a`b``"), ("`a", "`` `a ``"), ("  ", "")], inline_code("x"))
    check(spark, [("https://e.com/(a)", "<https://e.com/(a)>"), ("https://e.com", "https://e.com")], link_target("x"))


def test_money_types_and_spans(spark):
    check(spark, [(1234, "12.34 EUR"), (5, "0.05 EUR"), (None, "")], format_price("x", "'EUR'"), "x bigint, want string")
    check(spark, [(75, 100, 25), (100, 100, None), (5, 0, None), (2, 3, 33)], discount_percent("p", "c"), "p bigint, c bigint, want int")
    check(spark, [("https://schema.org/Product", "Product"), ("http://x#Offer", "Offer"), ("Thing", "Thing"), (" ", "")], normalise_type("x"))
    check(spark, [("3", 3), ("0", 1), ("99999", 1000), ("x", 1), ("2.9", 2), (None, 1)], resolve_span("x"), "x string, want int")
