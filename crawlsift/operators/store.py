"""Storefront operators: detection, description, features, audit, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.money import discount_percent, format_price
from crawlsift.functions.sql import any_of, case, lit, struct
from crawlsift.functions.text import js_length
from crawlsift.functions.urls import host_matches, host_of
from crawlsift.operators.findings import RANK, explode_findings, finding, say, summarize_status
from crawlsift.registry.apps import STORE_HOSTS

# Quality thresholds of a product page.
DESCRIPTION_MIN, IMAGES_MIN, SEO_MIN, SEO_MAX = 120, 3, 70, 160
_OFF = discount_percent("product.price_from", "product.compare_at_price")


def detect_storefront(stores: DataFrame) -> DataFrame:
    """(page_id, is_store, confidence, evidence)."""
    cdn = "coalesce(" + ", ".join(
        case((any_of("urls", lambda u, d=d: host_matches(host_of(u), d)), lit(d))) for d in STORE_HOSTS) + ")"
    evidence = f"array_compact(array(if(has_global, 'window.Shopify', NULL), if(shop <> '', concat('shop: ', shop), NULL), {cdn}))"
    return stores.selectExpr("page_id", "has_global", f"{evidence} AS evidence").selectExpr(
        "page_id", "size(evidence) > 0 AS is_store",
        "CASE WHEN size(evidence) = 0 THEN 'none' WHEN has_global THEN 'high' ELSE 'low' END AS confidence", "evidence")


def detect_platform_features(stores: DataFrame) -> DataFrame:
    """(page_id, pos, id, name, note)."""
    feature = lambda i, name, note: struct(id=lit(i), name=lit(name), note=note)
    loads = lambda pattern: f"exists(urls, u -> rlike(u, {lit(pattern)}))"
    found = ", ".join([
        case(("has_localization_form", feature("markets", "Shopify Markets", say(
            "The storefront offers a country or currency selector.")))),
        case((loads(r"(?i)cdn\.shopify\.com/extensions/"), feature("theme-app-extensions", "Theme app extensions", say(
            "At least one app injects blocks through the theme editor rather than by editing code.")))),
        case((loads(r"(?i)shop_pay|shopifycloud/shop_pay"), feature("shop-pay", "Shop Pay", say(
            "Accelerated checkout is enabled.")))),
        case(("size(theme.sections) > 0", feature("os2", "Online Store 2.0 sections", say(
            "=size(theme.sections)", " section types render on this page."))))])
    rows = stores.selectExpr("page_id", f"posexplode_outer(array_compact(array({found}))) AS (pos, f)")
    return rows.filter("pos IS NOT NULL").select("page_id", "pos", "f.*")


def audit_store(stores: DataFrame) -> DataFrame:
    """findings(page_id, audit, id, group, label, status, message, value, seq); `seq` already orders worst first.

    Rules on images, copy and stock fire only where the page publishes that data: unknown is not zero.
    """
    rule = lambda i, status, label, message: finding("store", i, label, status, message)
    when = lambda test, *r: case((test, rule(*r)))
    product_page = "(page.type = 'product' OR product.id <> '')"
    on_product = lambda test, *r: when(f"{product_page} AND {test}", *r)
    stock = "product.knows_stock AND product.variant_count"
    rules = [
        when("design_mode", "design-mode", "warning", "Theme editor preview",
             "You are viewing this page inside the theme editor, so what you see may not be live."),
        when("theme.role NOT IN ('', 'main')", "theme-role", "warning", "Not the live theme",
             say('This page renders the "', "=theme.role", '" theme, not the published one.')),
        when("contains(lower(seo.robots), 'noindex')", "noindex", "error", "Page is set to noindex",
             "Search engines are told not to index this page."),
        when("coalesce(seo.canonical, '') = ''", "canonical", "warning", "No canonical URL",
             "Shopify generates duplicate URLs for products in collections; a canonical prevents them competing."),
        case(("seo.description = ''", rule("meta-description", "warning", "No meta description",
              "Shopify falls back to the first words of the product description, which rarely reads well.")),
             (f"{js_length('seo.description')} < {SEO_MIN}", rule(
                 "meta-description-short", "warning", "Meta description is short",
                 say(f"={js_length('seo.description')}", f" characters. Aim for {SEO_MIN}-{SEO_MAX}.")))),
        case((f"{product_page} AND product.source = 'none'", rule(
                 "no-product-data", "warning", "Product data not published",
                 "Neither a product JSON island nor analytics metadata was found, so this theme hides its product data.")),
             (f"{product_page} AND NOT product.knows_images AND NOT product.knows_description", rule(
                 "partial-product-data", "info", "Only partial product data published",
                 "This theme exposes variants but not images or copy, so those cannot be checked from the page."))),
        on_product("product.knows_images AND product.image_count = 0", "no-images", "error", "No product images",
                   "A product page with no images will not convert and cannot appear in Google Shopping."),
        on_product(f"product.knows_images AND product.image_count BETWEEN 1 AND {IMAGES_MIN - 1}", "few-images", "warning",
                   say("Only ", "=product.image_count", " product image(s)"),
                   f"Aim for at least {IMAGES_MIN} so buyers can see the product properly."),
        on_product("product.knows_description AND product.description = ''", "no-description", "warning",
                   "No product description", "Nothing for search engines to index and nothing to answer buyer questions."),
        on_product(f"product.knows_description AND {js_length('product.description')} BETWEEN 1 AND {DESCRIPTION_MIN - 1}",
                   "thin-description", "warning", "Thin product description", say(
                       f"={js_length('product.description')}",
                       " characters. Thin copy ranks poorly and leaves questions unanswered.")),
        on_product(f"{stock} > 0 AND product.available_variant_count = 0", "out-of-stock", "error",
                   "Every variant is out of stock", say("All ", "=product.variant_count", " variants are unavailable.")),
        on_product(f"{stock} > 1 AND product.available_variant_count BETWEEN 1 AND product.variant_count - 1",
                   "partial-stock", "info", "Partially out of stock", say(
                       "=product.available_variant_count", " of ", "=product.variant_count", " variants are available.")),
        on_product("product.missing_sku > 0", "missing-sku", "warning", say("=product.missing_sku", " variant(s) without a SKU"),
                   "SKUs are required by most feeds, fulfilment apps and marketplaces."),
        on_product(f"{_OFF} IS NOT NULL", "on-sale", "info", "On sale", say(f"={_OFF}", "% off the compare-at price.")),
        on_product("product.vendor = ''", "no-vendor", "info", "No vendor set",
                   "Vendor drives brand filtering and several product feeds."),
    ]
    found = explode_findings(stores, rules, "store")
    return found.selectExpr("*", f"{RANK} * 1000 + seq AS _order").drop("seq").withColumnRenamed("_order", "seq")


def describe_store(stores: DataFrame) -> DataFrame:
    """(page_id, group, label, value, status, note, seq): what the storefront says about itself."""
    def row(group: str, label: str, value: str, status: str = "'info'", note: str = "''") -> str:
        return struct(group=lit(group), label=lit(label), value=f"coalesce(CAST({value} AS STRING), '')", status=status,
                      note=note)

    ok = lambda test: f"if({test}, 'ok', 'warning')"
    when = lambda test, *r: case((test, row(*r)))
    has = lambda c: f"{c} <> ''"
    or_unknown = lambda *c: f"coalesce({', '.join(f'nullif({x}, {lit(str())})' for x in c)}, '(unknown)')"
    product = lambda test, *r: when(f"product.id <> '' AND {test}", "Product", *r)
    prices = "filter(variants.price, p -> p IS NOT NULL)"
    low, high = f"array_min({prices})", f"array_max({prices})"
    span = (f"if({low} = {high}, {format_price(low, 'currency')}, concat({format_price(low, 'currency')}, ' - ', "
            f"{format_price(high, 'currency')}))")
    rows = [
        row("Store", "Shop", or_unknown("shop"), ok(has("shop"))),
        row("Store", "Currency", or_unknown("currency"), ok(has("currency"))),
        when(has("locale"), "Store", "Locale", "locale"), when(has("country"), "Store", "Country", "country"),
        row("Store", "Customer", "if(customer_logged_in, 'Logged in', 'Guest')", "if(customer_logged_in, 'info', 'ok')"),
        row("Theme", "Theme", or_unknown("theme.name", "theme.schema_name"), ok(has("theme.name"))),
        when(has("theme.schema_version"), "Theme", "Version", "theme.schema_version"),
        when(has("theme.id"), "Theme", "Theme ID", "theme.id"),
        case((has("theme.theme_store_id"), row("Theme", "Theme Store ID", "theme.theme_store_id", "'info'",
                                               "'Paid or free theme from the Shopify Theme Store.'")),
             (has("theme.name"), row("Theme", "Origin", "'Custom theme'", "'info'",
                                     "'No Theme Store ID, so this theme is bespoke.'"))),
        when(has("theme.role"), "Theme", "Role", "theme.role", ok("theme.role = 'main'"),
             "if(theme.role = 'main', '', 'This is not the live theme.')"),
        when("design_mode", "Theme", "Design mode", "'On'", "'warning'",
             "'The page is being viewed inside the theme editor.'"),
        when(has("page.type"), "Page", "Page type", "page.type"),
        when(has("page.resource_type"), "Page", "Resource", "page.resource_type"),
        when(has("page.resource_id"), "Page", "Resource ID", "page.resource_id"),
        product(has("product.title"), "Title", "product.title"), product("true", "Product ID", "product.id"),
        product(has("product.handle"), "Handle", "product.handle"), product(has("product.vendor"), "Vendor", "product.vendor"),
        product(has("product.type"), "Type", "product.type"),
        product("true", "Variants", "product.variant_count", ok("product.variant_count > 0")),
        product("product.knows_stock AND product.variant_count > 0", "In stock",
                "concat(product.available_variant_count, ' of ', product.variant_count)",
                ok("product.available_variant_count > 0")),
        product("product.knows_images", "Images", "product.image_count", ok("product.image_count > 0")),
        product(f"{low} IS NOT NULL", "Price", span),
        product(f"{_OFF} IS NOT NULL", "Compare at", format_price("product.compare_at_price", "currency"), "'info'",
                f"concat({_OFF}, '% off.')"),
        product("size(product.options) > 0", "Options", "array_join(filter(product.options.name, n -> n <> ''), ', ')"),
        product("size(product.tags) > 0", "Tags", "array_join(slice(product.tags, 1, 8), ', ')"),
        when("product.id = '' AND page.type = 'product'", "Product", "Product", "'Not exposed'", "'warning'",
             "'This is a product page but no product metadata was published.'"),
    ]
    shown = stores.selectExpr("page_id", f"posexplode(array_compact(array({', '.join(rows)}))) AS (seq, r)")
    return shown.select("page_id", "r.*", "seq")


def summarize_store(findings: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, total, errors, warnings, infos, status)."""
    return summarize_status(findings, pages).selectExpr(
        "page_id", "total", "error AS errors", "warning AS warnings", "info AS infos", "status")


def price_range(variants: DataFrame) -> DataFrame:
    """Lowest and highest price per product page, NULL when no variant has one."""
    return variants.groupBy("page_id").agg(F.min("price").alias("min"), F.max("price").alias("max"))


def variant_counts(variants: DataFrame) -> DataFrame:
    return variants.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("variants"), F.expr("count_if(available)").alias("available"),
        F.expr("count_if(sku = '')").alias("missing_sku"))


def variant_view(variants: DataFrame) -> DataFrame:
    """(page_id, pos, variant, sku, price, stock) as shown to a reader."""
    stock = ("CASE WHEN available IS NULL THEN '-' WHEN NOT available THEN 'out' WHEN inventory_quantity IS NULL THEN 'yes' "
             "ELSE CAST(inventory_quantity AS STRING) END")
    return variants.selectExpr(
        "page_id", "pos", "coalesce(nullif(title, ''), id) AS variant", "coalesce(nullif(sku, ''), '-') AS sku",
        f"coalesce(nullif({format_price('price', 'currency')}, ''), '-') AS price", f"{stock} AS stock")
