"""Storefront facts: shop, theme, product, variants, media."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.extract.facts import is_jsonld, link_tag_array, meta_array, meta_matches
from crawlsift.extract.markup import attr, attr_or, elements, tags
from crawlsift.extract.signals import inline_text
from crawlsift.functions.json import normalise_type
from crawlsift.functions.money import offer_available, offer_price_cents
from crawlsift.functions.sql import any_of, case, each, extract, in_list, keep, let, lit, matches, struct
from crawlsift.functions.text import first_n, js_trim
from crawlsift.functions.urls import absolute_or

# Structured-data types that describe a product, and where shops keep their data.
PRODUCT_TYPES = ["Product", "ProductGroup", "ProductModel", "IndividualProduct"]
_OBJECT = r"(\{(?:[^{}\"']++|\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'|\{(?:[^{}\"']++|\"(?:[^\"\\]++|\\.)*+\"|\{(?:[^{}\"']++|\"(?:[^\"\\]++|\\.)*+\"|\{[^{}]*+\})*+\})*+\})*+\})"


# What is read of a product, a variant and analytics metadata, each in one pass: a value asked for by its path is searched again every time.
_VARIANT = ("array<struct<id variant, title variant, public_title variant, name variant, sku variant, price variant, compare_at_price variant, "
            "available variant, inventory_quantity variant, inventory_policy variant, requires_shipping variant, barcode variant>>")
_PRODUCT = (f"struct<variants {_VARIANT}, hasVariant array<variant>, images variant, image variant, options array<variant>, id variant, handle variant, "
            "title variant, name variant, description variant, body_html variant, vendor variant, type variant, tags array<string>, published_at variant, "
            "price variant, compare_at_price variant, available boolean, offers variant>")
_META = (f"struct<product struct<id variant, handle variant, vendor variant, type variant, variants {_VARIANT}>, page struct<pageType variant, "
         "resourceType variant, resourceId variant, customerId variant>, currency variant>")


def _get(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def text_of(value: str) -> str:
    """Trimmed text of a VARIANT; '' for anything that is not a text."""
    return case((f"schema_of_variant({value}) = 'STRING'", js_trim(f"try_variant_get({value}, '$', 'string')")), otherwise="''")


def cents_of(value: str) -> str:
    """A number as BIGINT; NULL for anything else, texts included."""
    number = rf"schema_of_variant({value}) RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'"
    return case((number, f"CAST(try_variant_get({value}, '$', 'double') AS BIGINT)"))


def id_of(value: str) -> str:
    return f"coalesce(try_variant_get({value}, '$', 'string'), '')"


def truthy(value: str) -> str:
    return f"coalesce(to_json({value}) NOT IN ('null', 'false', '0', '\"\"'), false)"


def v_text(v: str, path: str) -> str:
    return text_of(_get(v, path))


def v_id(v: str, path: str) -> str:
    return id_of(_get(v, path))


def v_truthy(v: str, path: str) -> str:
    return truthy(_get(v, path))


def _product_json() -> str:
    """JSON text of the page's product: the first usable island, else the first product entity in JSON-LD."""
    json_type = lambda s: f"lower({attr(s + '.tag', 'type')}) = 'application/json'"
    has = lambda s, name: f"{attr(s + '.tag', name)} IS NOT NULL"
    id_part = lambda s, part: f"contains({attr(s + '.tag', 'id')}, {lit(part)})"
    regions = elements("markup", "product-info")
    islands = "concat(" + ", ".join([
        keep("scripts", lambda s: f"{json_type(s)} AND {id_part(s, 'ProductJson')}"),
        keep("scripts", lambda s: f"{json_type(s)} AND {has(s, 'data-product-json')}"),
        keep("scripts", lambda s: f"{json_type(s)} AND {id_part(s, 'product-json')}"),
        keep("scripts", lambda s: has(s, "data-product-json")),
        keep("scripts", lambda s: f"{json_type(s)} AND {any_of(regions, lambda r: f'contains({r}, {s}.tag)')}")]) + ")"
    usable = keep(each(islands, lambda s: f"{s}.body"), lambda b: let(f"try_parse_json({b})", lambda v: (
        f"({v_truthy(v, 'id')} OR {v_truthy(v, 'handle')})")))
    entries = (lambda v: f"coalesce(try_variant_get({v}, '$', 'array<variant>'), "
                         f"try_variant_get({v}, {lit(chr(36) + chr(91) + chr(39) + '@graph' + chr(39) + chr(93))}, "
                         f"'array<variant>'), array({v}))")
    types = (lambda e: f"coalesce(try_variant_get({e}, {lit(_AT_TYPE)}, 'array<string>'), "
                       f"array(try_variant_get({e}, {lit(_AT_TYPE)}, 'string')))")
    typed = lambda e: any_of(types(e), lambda t: in_list(normalise_type(t), PRODUCT_TYPES))
    blocks = keep("scripts", is_jsonld)
    entities = f"flatten({each(blocks, lambda s: let(f'try_parse_json({s}.body)', lambda v: f'if({v} IS NULL, CAST(array() AS ARRAY<VARIANT>), {keep(entries(v), typed)})'))})"
    return f"coalesce(get({usable}, 0), to_json(get({entities}, 0)))"


_AT_TYPE = "$['@type']"


def _static(start: str, pattern: str) -> str:
    """What follows a plain text in inline scripts; the text is searched first, as most pages lack most of them."""
    return case((f"contains(inline, {lit(start)})", f"nullif({extract('inline', re.escape(start) + pattern, 1)}, '')"))


def _variants() -> str:
    """Product variants, else the real ones of a product group, else the analytics ones."""
    def theme(v: str) -> str:
        return struct(
            id=id_of(f"{v}.id"), title=f"coalesce(nullif({text_of(f'{v}.title')}, ''), nullif({text_of(f'{v}.public_title')}, ''), "
                                       f"{text_of(f'{v}.name')})",
            sku=text_of(f"{v}.sku"), price=cents_of(f"{v}.price"), compare_at_price=cents_of(f"{v}.compare_at_price"),
            available=case((f"{v}.available IS NOT NULL AND NOT is_variant_null({v}.available)", truthy(f"{v}.available"))),
            inventory_quantity=cents_of(f"{v}.inventory_quantity"), inventory_policy=text_of(f"{v}.inventory_policy"),
            requires_shipping=case((f"{v}.requires_shipping IS NOT NULL", truthy(f"{v}.requires_shipping"))),
            barcode=text_of(f"{v}.barcode"))

    def stub_free(v: str) -> str:
        return f"{v_truthy(v, 'offers')} OR {v_truthy(v, 'sku')} OR {v_truthy(v, 'name')}"

    def offer(v: str) -> str:
        at_id = f"nullif(try_variant_get({v}, {lit(chr(36) + chr(91) + chr(39) + '@id' + chr(39) + chr(93))}, 'string'), '')"
        return struct(
            id=f"coalesce({at_id}, {v_id(v, 'sku')})",
            title=f"coalesce(nullif({v_text(v, 'name')}, ''), {v_text(v, 'title')})", sku=v_text(v, "sku"),
            price=offer_price_cents(v), compare_at_price="CAST(NULL AS BIGINT)", available=offer_available(v),
            inventory_quantity="CAST(NULL AS BIGINT)", inventory_policy="''", requires_shipping="CAST(NULL AS BOOLEAN)",
            barcode="''")

    objects = lambda array: keep(array, lambda v: f"{v} IS NOT NULL")
    return (f"coalesce({each(objects('_p.variants'), theme)}, {each(keep('_p.hasVariant', stub_free), offer)}, "
            f"{each(objects('_m.product.variants'), theme)})")


def extract_store(parsed: DataFrame, runtime: DataFrame | None = None, urls: int | None = None,
                  variants: int | None = None, images: int | None = None, sections: int | None = None) -> DataFrame:
    """stores(page_id, url, has_global, shop, locale, ..., theme, page, product, seo, urls, variants).

    `runtime` may carry `shop STRING`: JSON {"shopify": {...}, "meta": {...}, "customer": id} as captured from the live
    page. Without it the same facts are read from inline scripts. Narrow projections only.
    """
    linked = keep(each(tags("markup", "script|link"), lambda t: absolute_or(
        "base", f"coalesce(nullif({case((matches(t, '(?i)^<script'), attr(t, 'src')))}, ''), {attr_or(t, 'href')})",
        "raw")), lambda u: f"{u} <> ''")
    section_types = case(("NOT contains(markup, 'data-section-type')", "CAST(array() AS ARRAY<STRING>)"), otherwise=keep(each(
        "filter(" + f"{_ALL_TAGS}, t -> contains(t, 'data-section-type'))", lambda t: js_trim(attr_or(t, "data-section-type"))),
        lambda s: f"{s} <> ''"))
    selectors = any_of(_ALL_TAGS, lambda t: (
        f"rlike({t}, '(?i)^<form') AND contains({attr(t, 'action')}, '/localization') OR contains({t}, '_code') AND "
        f"{attr(t, 'name')} IN ('currency_code', 'country_code')"))
    canonical = f"get({keep(link_tag_array('markup'), lambda t: f'{t}.rel = {lit(str('canonical'))}')}, 0)"
    rows = parsed.selectExpr(
        "page_id", "url", "base", f"{inline_text('scripts', None, None)} AS inline", f"{_product_json()} AS product_raw",
        f"{first_n(f'array_distinct({linked})', urls)} AS urls",
        f"{first_n(f'array_distinct({section_types})', sections)} AS sections",
        f"coalesce({case(('contains(markup, ' + lit('_code') + ') OR contains(markup, ' + lit('/localization') + ')', selectors))}, false) AS has_localization_form",
        f"{meta_array('markup')} AS metas", f"{absolute_or('base', f'{canonical}.href', 'raw')} AS canonical")
    if runtime is not None:
        rows = rows.join(runtime.selectExpr("page_id", "try_parse_json(shop) AS shop_json"), "page_id", "left")
    else:
        rows = rows.selectExpr("*", "try_parse_json(NULL) AS shop_json")
    named = lambda key: _static(f"Shopify.{key}", r"\s*=\s*[\"']([^\"']*)[\"']")
    pick = lambda path, key: f"coalesce(nullif({v_text('shop_json', 'shopify.' + path)}, ''), {named(key)}, '')"
    parsed_json = lambda start: f"try_parse_json({_static(start, r'\s*=\s*' + _OBJECT)})"
    known = rows.selectExpr(
        "*", "try_parse_json(product_raw) AS product",
        f"coalesce({_get('shop_json', 'meta')}, {parsed_json('var meta')}, "
        f"{parsed_json('ShopifyAnalytics.meta')}) AS meta",
        f"coalesce({_get('shop_json', 'shopify.theme')}, {parsed_json('Shopify.theme')}) AS theme_json",
        f"coalesce({_get('shop_json', 'shopify.currency')}, {parsed_json('Shopify.currency')}) AS currency_json",
        f"coalesce({_get('shop_json', 'shopify')} IS NOT NULL, false) OR rlike(inline, 'Shopify[.](shop|theme)[ ]*=') AS has_global",
        f"{pick('shop', 'shop')} AS shop", f"{pick('locale', 'locale')} AS locale", f"{pick('country', 'country')} AS country",
        f"coalesce(try_variant_get(shop_json, '$.shopify.designMode', 'boolean'), rlike(inline, 'Shopify[.]designMode[ ]*=[ ]*true')) AS design_mode",
        f"{v_truthy('shop_json', 'customer')} AS logged_in").selectExpr(
        "*", f"try_variant_get(product, '$', '{_PRODUCT}') AS _p", f"try_variant_get(meta, '$', '{_META}') AS _m").selectExpr(
        "*", f"{first_n(_variants(), variants)} AS _v")
    image_source = ("coalesce(try_variant_get(_p.images, '$', 'array<variant>'), try_variant_get(_p.image, '$', 'array<variant>'), "
                    f"if({truthy('_p.image')}, array(_p.image), CAST(array() AS ARRAY<VARIANT>)))")
    image_url = lambda i: (
        f"if(schema_of_variant({i}) = 'STRING', CAST({i} AS STRING), coalesce(nullif(try_variant_get({i}, '$.src', 'string'), ''), "
        f"nullif(try_variant_get({i}, '$.url', 'string'), ''), try_variant_get({i}, '$.contentUrl', 'string')))")
    media = keep(each(first_n(image_source, images), lambda i: absolute_or("base", image_url(i), "raw")), lambda u: f"{u} <> ''")
    option = lambda o: struct(
        name=case((f"schema_of_variant({o}) = 'STRING'", f"CAST({o} AS STRING)"), otherwise=v_text(o, "name")),
        values=f"coalesce(try_variant_get({o}, '$.values', 'array<string>'), CAST(array() AS ARRAY<STRING>))")
    opts = each("_p.options", option)
    first = lambda name: f"coalesce(nullif({id_of(f'_m.product.{name}')}, ''), {id_of(f'_p.{name}')})"
    trimmed = lambda name: js_trim(first(name))
    theme = struct(id=v_id("theme_json", "id"), name=v_text("theme_json", "name"), role=v_text("theme_json", "role"),
                   theme_store_id=v_id("theme_json", "theme_store_id"), schema_name=v_text("theme_json", "schema_name"),
                   schema_version=v_text("theme_json", "schema_version"), sections="sections")
    page = struct(type=text_of("_m.page.pageType"), resource_type=text_of("_m.page.resourceType"), resource_id=id_of("_m.page.resourceId"))
    description = f"coalesce(nullif({text_of('_p.description')}, ''), {text_of('_p.body_html')})"
    # asked of the whole product, and only where it has offers: a path that leads nowhere costs most
    offered = lambda value: case(("_p.offers IS NOT NULL", value("product")))
    product = struct(
        knows_images="(_p.images IS NOT NULL OR _p.image IS NOT NULL)",
        knows_description="(_p.description IS NOT NULL OR _p.body_html IS NOT NULL)",
        knows_stock="exists(_v, v -> v.available IS NOT NULL)",
        id=first("id"), handle=f"coalesce(nullif({text_of('_p.handle')}, ''), {text_of('_m.product.handle')})",
        title=f"coalesce(nullif({text_of('_p.title')}, ''), {text_of('_p.name')})",
        description=description, vendor=trimmed("vendor"), type=trimmed("type"),
        tags="coalesce(_p.tags, CAST(array() AS ARRAY<STRING>))",
        published_at=text_of("_p.published_at"),
        price_from=f"coalesce({cents_of('_p.price')}, {offered(offer_price_cents)})",
        compare_at_price=cents_of("_p.compare_at_price"),
        available=f"coalesce(_p.available, {offered(offer_available)})",
        variant_count="size(_v)", available_variant_count="size(filter(_v, v -> coalesce(v.available, false)))",
        missing_sku="size(filter(_v, v -> v.sku = ''))",
        image_count="size(_images)", images="_images", options=f"coalesce({opts}, array())",
        source=f"CASE WHEN product IS NOT NULL THEN 'product-json' WHEN {truthy('_m.product.id')} "
               "THEN 'analytics-meta' ELSE 'none' END")
    tag = lambda key: js_trim(f"coalesce(get({meta_matches('metas', key)}, 0).content, '')")
    seo = struct(description=tag("description"), canonical="canonical", robots=tag("robots"), og_image=tag("og:image"),
                 og_type=tag("og:type"))
    filled = known.selectExpr("*", f"array_distinct({media}) AS _images").withColumn(
        "_v", F.expr("coalesce(_v, slice(_v, 1, 0))"))
    return filled.selectExpr(
        "page_id", "url", "has_global", "shop", "locale", "country",
        f"coalesce(nullif({v_text('currency_json', 'active')}, ''), {text_of('_m.currency')}) AS currency",
        f"{v_id('currency_json', 'rate')} AS currency_rate", "has_localization_form", "coalesce(design_mode, false) AS design_mode",
        f"(logged_in OR {truthy('_m.page.customerId')}) AS customer_logged_in", f"{theme} AS theme", f"{page} AS page",
        f"{product} AS product", f"{seo} AS seo", f"{tag('generator')} AS generator", "urls", "_v AS variants")


def extract_variants(stores: DataFrame) -> DataFrame:
    """variants(page_id, pos, id, title, sku, price, ...); prices in cents, `available` NULL when not said."""
    rows = stores.select("page_id", "currency", F.posexplode_outer("variants").alias("pos", "v"))
    return rows.filter("pos IS NOT NULL").select("page_id", "currency", "pos", "v.*")


def extract_product_media(stores: DataFrame) -> DataFrame:
    rows = stores.select("page_id", F.posexplode_outer("product.images").alias("pos", "src"))
    return rows.filter("pos IS NOT NULL")


_ALL_TAGS = "regexp_extract_all(markup, '<[A-Za-z][^>]*>', 0)"
