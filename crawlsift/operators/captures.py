"""What changed between two captures of a page, told by a tree of hashes.

A page's parts (title, metadata, headings, links, images, text, structured data) are lists of leaves; a leaf is the hash of one heading,
link or run of text, a part the hash of its leaves, the root the hash of the parts. Captures are compared by their roots, then by their
parts; leaves are fetched for changed pages only, and html is read once, where the tree is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.extract.facts import heading_array, image_array, is_jsonld, link_array, meta_array, text_runs, title_array
from crawlsift.functions.sql import each, keep
from crawlsift.functions.text import squish
from crawlsift.operators.corpus import latest_capture
from crawlsift.shared import written

PARTS = ["title", "meta", "headings", "links", "images", "text", "structured"]


def _leaves() -> dict[str, str]:
    """ARRAY<BIGINT> of each part, in the order of the page."""
    return {
        "title": each(title_array("markup"), lambda t: f"xxhash64({squish(t)})"),
        "meta": each(meta_array("markup"), lambda m: f"xxhash64({m}.name, {m}.property, {m}.content)"),
        "headings": each(heading_array("markup"), lambda h: f"xxhash64({h}.level, {h}.text)"),
        "links": each(link_array("markup", "base"), lambda a: f"xxhash64({a}.href, {a}.raw, {a}.text, {a}.rel)"),
        "images": each(image_array("markup", "base"), lambda i: f"xxhash64({i}.kind, {i}.src, {i}.alt)"),
        "text": each(text_runs("markup"), lambda t: f"xxhash64({t})"),
        "structured": each(keep("scripts", is_jsonld), lambda s: f"xxhash64(trim({s}.body))"),
    }


def page_digests(parsed: DataFrame, carry: list[str]) -> DataFrame:
    """(carry..., root, parts, leaves): the hash tree of each page, in its row. parts and leaves are structs with a field per part."""
    rows = parsed.selectExpr(*carry, *[f"{e} AS `{name}`" for name, e in _leaves().items()])
    parts = ", ".join(f"'{name}', xxhash64(size(`{name}`), `{name}`)" for name in PARTS)
    leaves = ", ".join(f"'{name}', `{name}`" for name in PARTS)
    rows = rows.selectExpr(*carry, f"named_struct({parts}) AS parts", f"named_struct({leaves}) AS leaves")
    return rows.selectExpr(*carry, f"xxhash64({', '.join(f'parts.{name}' for name in PARTS)}) AS root", "parts", "leaves")


def diff_digests(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """(key, change, changed, added, removed): pages added, removed or changed, the parts that differ, and for each of these how many leaves
    are new or gone (a part whose leaves only moved has none of either). Both sides hold one row per key.

    Only roots and part hashes are shuffled for all pages.
    """
    a = old.select(F.col(key), F.col("root").alias("a_root"), F.col("parts").alias("a"))
    b = new.select(F.col(key), F.col("root").alias("b_root"), F.col("parts").alias("b"))
    names = ", ".join(f"if(a.{c} = b.{c}, NULL, '{c}')" for c in PARTS)
    kind = "CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END"
    found = written(a.join(b, key, "full").filter("NOT (a_root <=> b_root)").selectExpr(
        key, f"{kind} AS change", f"if(a IS NULL OR b IS NULL, CAST(array() AS ARRAY<STRING>), array_compact(array({names}))) AS changed"))
    both = found.filter("change = 'changed'").select(key, "changed")
    pairs = both.join(old.select(F.col(key), F.col("leaves").alias("x")), key).join(new.select(F.col(key), F.col("leaves").alias("y")), key)
    fresh = lambda one, other: "map_from_entries(filter(array(" + ", ".join(
        f"struct('{c}' AS k, CAST(size(filter({one}.{c}, h -> NOT array_contains({other}.{c}, h))) AS INT) AS n)" for c in PARTS) + "), e -> array_contains(changed, e.k)))"
    counted = pairs.selectExpr(key, f"{fresh('y', 'x')} AS added", f"{fresh('x', 'y')} AS removed")
    return found.join(counted, key, "left")


def capture_diff(captures: DataFrame, before: str, after: str, parse) -> DataFrame:
    """`diff_digests` of the newest captures of each url up to two points in time (SQL literals); `parse` turns captures into parsed pages.

    Each url's newest captures are chosen without their html, which is read for these alone.
    """
    def digests(at: str) -> DataFrame:
        newest = latest_capture(captures.filter(f"captured_at <= {at}"))
        return written(page_digests(parse(newest), ["url"]))

    return diff_digests(digests(before), digests(after))
