"""Values are computed once, and JSON is parsed and searched once, with the same results."""

from crawlsift.extract.markup import parse_pages
from crawlsift.extract.store import extract_store
from crawlsift.functions.json import whole_json
from crawlsift.functions.sql import let, lit
from crawlsift.functions.text import WHITESPACE, WS, decode_entities


def test_let_binds_only_what_must_be_computed(spark):
    assert let("page.url", lambda x: f"concat({x}, {x})") == "concat(page.url, page.url)"
    assert let("lower(url)", lambda x: f"concat({x}, {x})").count("lower(url)") == 1
    assert let("NULL", lambda x: x) != "NULL"


def test_json_is_parsed_once_and_must_be_whole(spark):
    assert whole_json("s").count("parse_json") == 1
    texts = {"1": "1", "null": "null", ' {"a":1} ': '{"a":1}', "[1,2]": "[1,2]", '"a\\"b"': '"a\\"b"', "1,2": None, "1],[2": None, "1}": None, "1] x": None,
             '1,"w":2': None, '"x': None, "": None, " ": None, '{"a":1}]': None, "[" * 1001 + "]" * 1001: None, "[" * 999 + "]" * 999: "[" * 999 + "]" * 999}
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "s string").selectExpr("s", f"to_json({whole_json('s')}) AS v").collect()
    assert {r.s: r.v for r in rows} == {**texts, None: None}


def test_frequent_references_stand_first(spark):
    assert "'amp\x01&\x02nbsp" in decode_entities("s")
    rows = spark.createDataFrame([("&amp;lt; &nbsp;&alpha;&zwj;&nope;&apos;",)], "s string").selectExpr(f"{decode_entities('s')} AS t").collect()
    assert rows[0].t == "&lt;  α‍&nope;'"


def test_white_space_is_the_same_set(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(65536) if not 0xD800 <= i < 0xE000], "c string")
    assert chars.where(f"rlike(c, {lit(f'^{WS}\\z')})").count() == 25
    assert chars.where(f"rlike(c, {lit(f'^{WS}\\z')}) <> rlike(c, {lit(f'^[{WHITESPACE}]\\z')})").count() == 0


def test_product_fields_are_read_in_one_pass(spark):
    variants = ('[{"id":7,"title":" A ","sku":"","price":5,"available":true,"inventory_quantity":"3","barcode":4},1,null,'
                '{"public_title":"B","price":"6","available":null,"requires_shipping":0}]')
    product = '{"id":1,"title":2,"name":"N","price":9.5,"vendor":" v ","tags":["x",1],"images":null,"variants":%s}' % variants
    meta = '{"product":{"id":0,"handle":"h","type":5},"page":{"pageType":"product","resourceId":12,"customerId":3},"currency":"EUR"}'
    html = f'<script type="application/json" id="ProductJson">{product}</script><script>var meta = {meta};</script>'
    plain = '<script>xShopify.shop = 1; var meta = {"product":[],"page":"p"};</script>'
    pages = spark.createDataFrame([(1, "https://a.example/", html), (2, "https://a.example/", plain)], "page_id long, url string, html string")
    stores = extract_store(parse_pages(pages))
    shop, bare = stores.orderBy("page_id").collect()
    p = shop["product"]
    assert (p.id, p.handle, p.title, p.vendor, p.type, p.tags, p.price_from, p.knows_images, p.knows_description, p.knows_stock) == (
        "0", "h", "N", "v", "5", ["x", "1"], 9, True, False, True)
    assert (p.variant_count, p.available_variant_count, p.missing_sku, p.source, p.available) == (2, 1, 2, "product-json", None)
    assert [(v.id, v.title, v.sku, v.price, v.available, v.inventory_quantity, v.requires_shipping, v.barcode) for v in shop.variants] == [
        ("7", "A", "", 5, True, None, None, ""), ("", "B", "", None, None, None, False, "")]
    assert (shop.page.type, shop.page.resource_id, shop.currency, shop.customer_logged_in) == ("product", "12", "EUR", True)
    assert (bare.shop, bare["product"].source, bare["product"].id, bare.variants, bare.page.type) == ("", "none", "", None, "")
    assert stores._jdf.queryExecution().optimizedPlan().toString().count("variant_get(product") < 12
