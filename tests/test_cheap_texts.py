"""Cheap ways to trimmed texts, addresses and origins give what the patterns gave."""

import itertools

from crawlsift.functions import urls as U
from crawlsift.functions.sql import substitute
from crawlsift.functions.text import WS, js_trim
from crawlsift.functions.urls import normalise_url, origin_of
from crawlsift.operators import links

ODD = ["", " ", "a", "\t", "\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u1680", "\u200a", "\u200b", "\u2028", "\u3000", "\ufeff", "é", "\U0001f600", "\'"]
ADDRESSES = [
    "https://h.example", "https://h.example/", "https://h.example//a b?x#y", "HTTPS://H.example/a", "https://h.example:443/", "https://h.example:8443/x",
    "https://u:p@h.example/x", "https://h\t.example/x", " https://h.example/x ", "https:///h.example/x", "https:h.example", "http://h.example?q", "http://h.example\\x",
    "https://", "https://[::1]/", "https://bücher.example/", "ftp://f.example/", "mailto:A b@x", "TEL:+1", "javascript:void(é)", "x", "", "wss://h/%2e%2e/a", "//x/y", None]


def differing(spark, values, a, b):
    return spark.createDataFrame([(v,) for v in values], "x string").where(f"NOT (({a}) <=> ({b}))").count()


def test_trimmed_texts_are_what_the_pattern_gives(spark):
    texts = ["".join(t) for t in itertools.product(ODD, repeat=3)] + ["  a  b  ", None]
    assert differing(spark, texts, js_trim("x"), substitute("x", f"^{WS}++|{WS}(?<!{WS}{{2}}){WS}*+\\z")) == 0


def test_origins_of_links_are_those_of_the_normalised_address(spark):
    assert differing(spark, ADDRESSES, U.web_origin("x"), origin_of(normalise_url("x"))) == 0


def test_addresses_are_stripped_and_encoded_as_before(spark):
    texts = ["".join(t) for t in itertools.product(["", "a", " ", "\t", "\n", "\x00", "é", "<"], repeat=4)]
    strip = substitute("x", r"^[\x00-\x20]++|[\t\n\r]++|[\x00-\x20](?<![\x00-\x20]{2})[\x00-\x20]*+\z")
    assert differing(spark, texts, U._strip("x"), strip) == 0
    want = [(u, w) for u, w in [
        ("mailto:A bé", "mailto:A b%C3%A9"), ("TEL:+1", "tel:+1"), ("ftp://F.example", "ftp://f.example/"), ("WSS:h/é <", "wss://h/%C3%A9%20%3C"),
        ("https://h/%2e%2e/a", "https://h/a"), ("https://a b/", None), ("x", None)]]
    rows = spark.createDataFrame(want, "x string, want string")
    assert rows.where(f"NOT ({normalise_url('x')} <=> want)").count() == 0


def test_nofollow_is_a_whole_token(spark):
    rels = [("nofollow", True), ("ugc NOFOLLOW", True), ("nofollows", False), ("no follow", False), ("a\u00a0nofollow", True), ("", False), (None, False)]
    rows = spark.createDataFrame(rels, "x string, want boolean")
    assert rows.where(f"NOT ({links.is_nofollow('x')} <=> want)").count() == 0
