"""Prices (whole cents) and discounts."""

from __future__ import annotations

from crawlsift.functions.sql import case


def format_price(cents: str, currency: str = "''") -> str:
    """`1234` -> `12.34 EUR`; '' when there is no price."""
    amount = f"CAST(CAST({cents} AS DECIMAL(20, 0)) / 100 AS DECIMAL(20, 2))"
    return case((f"{cents} IS NULL", "''"), otherwise=f"concat_ws(' ', {amount}, nullif({currency}, ''))")


def discount_percent(price: str, compare_at: str) -> str:
    """Whole percentage off the compare-at price; NULL when there is no genuine discount."""
    return case((f"{compare_at} > 0 AND {compare_at} > {price}",
                 f"CAST(round(({compare_at} - {price}) * 100 / {compare_at}) AS INT)"))


def _offer(node: str) -> str:
    return f"coalesce(try_variant_get({node}, '$.offers[0]', 'variant'), try_variant_get({node}, '$.offers', 'variant'))"


def offer_price_cents(node: str) -> str:
    """Cents of the first offer's price, else its low price; NULL when that is no number."""
    price = (f"coalesce(try_variant_get({_offer(node)}, '$.price', 'string'), "
             f"try_variant_get({_offer(node)}, '$.lowPrice', 'string'))")
    return f"CAST(round(try_cast({price} AS DECIMAL(20, 6)) * 100) AS BIGINT)"


def offer_available(node: str) -> str:
    """Whether the first offer can be bought; NULL when it does not say."""
    return f"rlike(try_variant_get({_offer(node)}, '$.availability', 'string'), '(?i)InStock|LimitedAvailability|PreOrder|BackOrder')"
