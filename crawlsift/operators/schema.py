"""Structured-data audit: entities against the requirements of their type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.extract.facts import is_jsonld
from crawlsift.extract.folds import folded
from crawlsift.extract.json_folds import entities_of
from crawlsift.extract.structured import ITEMS, MICRODATA, flatten_jsonld, items_of, microdata_array, microdata_entities, microdata_of, type_name
from crawlsift.functions.json import normalise_type, whole_json
from crawlsift.functions.sql import case, constant_map, each, keep, let, lit, struct
from crawlsift.functions.text import clip
from crawlsift.registry.rows import sized_broadcast
from crawlsift.registry.schema_types import REQUIREMENTS


def flatten_entities(blocks: DataFrame, microdata: DataFrame | None = None, max_depth: int | None = None, raw: bool = True) -> DataFrame:
    """entities(page_id, source, path, ord, type, raw, filled): JSON-LD first, then Microdata; `raw` is the entity's JSON text."""
    json = flatten_jsonld(blocks, max_depth, raw).selectExpr(
        "page_id", "'json-ld' AS source", "path", "struct(0 AS s, block AS b, ord AS o) AS ord", "type",
        "raw", "filled")
    if microdata is None:
        return json
    items = microdata_entities(microdata).selectExpr(
        "page_id", "'microdata' AS source", "concat('item', item) AS path",
        "struct(1 AS s, CAST(item AS INT) AS b, '' AS o) AS ord", "type", "raw" if raw else "CAST(NULL AS STRING) AS raw", "filled")
    return json.unionByName(items)


def governing_type(type_: str, requirements: list[dict]) -> str:
    """First recognised name of a comma-joined type, case-insensitively; NULL when none is."""
    index = {n.lower(): r["type"] for r in requirements for n in [r["type"], *r["aliases"]]}
    known = keep(each(f"split({type_}, ',')", lambda n: f"try_element_at({constant_map(index)}, lower(trim({n})))"),
                 lambda t: f"{t} IS NOT NULL")
    return f"get({known}, 0)"


def validate_entities(entities: DataFrame, requirements: list[dict] = REQUIREMENTS) -> DataFrame:
    """findings(page_id, source, path, ord, type, status, label, message, seq), one row per checked property."""
    spec = [(r["type"], prop, level, i) for r in requirements
            for i, (level, prop) in enumerate([("error", p) for p in r["required"]]
                                              + [("warning", p) for p in r["recommended"]])]
    table = sized_broadcast(entities.sparkSession.createDataFrame(
        spec, "rule string, label string, lacking string, seq int"), len(spec))
    named = entities.selectExpr("page_id", "source", "path", "ord", "type", "filled",
                                f"{governing_type('type', requirements)} AS rule")
    checked = named.join(table, "rule", "left")
    # a known type without listed properties has nothing to report; an unknown one says so
    return checked.filter("rule IS NULL OR label IS NOT NULL").selectExpr(
        "page_id", "source", "path", "ord", "type",
        "CASE WHEN rule IS NULL THEN 'info' WHEN array_contains(filled, label) THEN 'ok' ELSE lacking END AS status",
        "coalesce(label, type) AS label",
        "CASE WHEN rule IS NULL THEN 'No rich-result requirements are checked for this type.' "
        "WHEN array_contains(filled, label) THEN 'Present.' WHEN lacking = 'error' THEN concat('Required by ', rule, '.') "
        "ELSE concat('Recommended for ', rule, '.') END AS message", "coalesce(seq, 0) AS seq")


def parse_errors(blocks: DataFrame) -> DataFrame:
    """Blocks that did not parse, under their own block number."""
    return blocks.filter("NOT ok").select("page_id", "block", "error", "excerpt")


def summarize_schema(entities: DataFrame, findings: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, entities, types, errors, warnings, parse_errors, status); types in first-seen order."""
    first_seen = entities.groupBy("page_id", "type").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    types = first_seen.groupBy("page_id").agg(
        F.sum("n").alias("entities"),
        F.expr("transform(array_sort(collect_list(struct(ord, type))), x -> x.type)").alias("types"))
    issues = findings.groupBy("page_id").agg(
        F.expr("count_if(status = 'error')").alias("e"), F.expr("count_if(status = 'warning')").alias("w"))
    failed = blocks.groupBy("page_id").agg(F.expr("count_if(NOT ok)").alias("p"))
    joined = pages.select("page_id").join(types, "page_id", "left").join(issues, "page_id", "left").join(
        failed, "page_id", "left")
    counted = joined.selectExpr(
        "page_id", "coalesce(entities, 0) AS entities", "coalesce(types, CAST(array() AS ARRAY<STRING>)) AS types",
        "coalesce(e, 0) + coalesce(p, 0) AS errors", "coalesce(w, 0) AS warnings", "coalesce(p, 0) AS parse_errors")
    return counted.selectExpr(
        "*", "CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'ok' END AS status")


def audit_schema(blocks: DataFrame, microdata: DataFrame, pages: DataFrame,
                 requirements: list[dict] = REQUIREMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    entities = flatten_entities(blocks, microdata)
    findings = validate_entities(entities, requirements)
    return entities, findings, summarize_schema(entities, findings, blocks, pages)


# --- whole pages in one row -----------------------------------------------------------------------

_BLOCK_ENTITIES = "array<struct<block: int, path: string, types: array<string>, filled: array<string>, raw: string>>"


def _of_blocks(raw: bool):
    def entities(blocks: list[dict]) -> list[tuple]:
        return [(i, f"block{i}{path}", types, filled, text) for i, b in enumerate(blocks) if b["ok"]
                for _, path, _, types, filled, text in entities_of(b["raw"], raw=raw)]

    return entities


def _findings_of(entity: str, requirements: list[dict]) -> str:
    """ARRAY<STRUCT<status, label, message>> of an entity: one for each property that its type asks for."""
    listed = lambda level: "map(" + ", ".join(
        f"{lit(r['type'])}, CAST(array({', '.join(map(lit, r[level]))}) AS ARRAY<STRING>)" for r in requirements) + ")"
    unknown = struct(status="'info'", label=f"{entity}.type", message="'No rich-result requirements are checked for this type.'")

    def checked(rule: str, level: str, status: str, text: str) -> str:
        return each(f"try_element_at({listed(level)}, {rule})", lambda name: case(
            (f"array_contains({entity}.filled, {name})", struct(status="'ok'", label=name, message="'Present.'")),
            otherwise=struct(status=lit(status), label=name, message=f"concat({lit(text)}, {rule}, '.')")))

    return let(governing_type(f"{entity}.type", requirements), lambda rule: case(
        (f"{rule} IS NULL", f"array({unknown})"),
        otherwise=f"concat({checked(rule, 'required', 'error', 'Required by ')}, {checked(rule, 'recommended', 'warning', 'Recommended for ')})"))


def structured_pages(parsed: DataFrame, requirements: list[dict] = REQUIREMENTS, microdata: bool = True, raw: bool = False) -> DataFrame:
    """(page_id, url, entities, failed, summary), a row per page and nothing shuffled.

    entities: ARRAY<STRUCT<type, source, path, errors, warnings, findings, properties>> in the order of the page, JSON-LD first;
    failed: ARRAY<STRUCT<index, error, excerpt>>; summary: STRUCT<entities, types, errors, warnings, parse_errors, status>. The
    entities' properties, as JSON texts, only with `raw`.
    """
    blocks = each(keep("scripts", is_jsonld), lambda s: let(f"trim({s}.body)", lambda t: struct(raw=t, ok=f"{whole_json(t)} IS NOT NULL")))
    rows = parsed.selectExpr("page_id", "url", "base", "markup", f"{blocks} AS _blocks")
    failed = each(keep("transform(_blocks, (b, i) -> named_struct('index', i, 'b', b))", lambda x: f"NOT {x}.b.ok"), lambda x: struct(
        index=f"{x}.index", error="'Invalid JSON'", excerpt=f"substr({clip(f'{x}.b.raw', 500)}, 1, 200)"))
    rows = folded(rows.selectExpr("*", f"{failed} AS failed"), "_blocks", _found=(_of_blocks(raw), _BLOCK_ENTITIES))
    kept = lambda array, source, type_, path: each(array, lambda e: struct(
        type=type_(e), source=lit(source), path=path(e), filled=f"{e}.filled", raw=f"{e}.raw" if raw else "CAST(NULL AS STRING)"))
    found = kept("_found", "json-ld", lambda e: type_name(f"{e}.types"), lambda e: f"{e}.path")
    if microdata:
        rows = folded(rows, "markup", _props=(microdata_of, MICRODATA))
        rows = folded(rows.selectExpr("page_id", "url", "failed", "_found", f"{microdata_array('_props')} AS _props"), "_props", _items=(items_of, ITEMS))
        found = f"concat({found}, {kept('_items', 'microdata', lambda e: normalise_type(f'{e}.type'), lambda e: f"concat('item', {e}.item)")})"
    rows = rows.selectExpr("page_id", "url", "failed", f"{keep(found, lambda e: f"{e}.type <> ''")} AS _entities")
    judged = each("_entities", lambda e: let(_findings_of(e, requirements), lambda f: struct(
        type=f"{e}.type", source=f"{e}.source", path=f"{e}.path", errors=f"size({keep(f, lambda x: f"{x}.status = 'error'")})",
        warnings=f"size({keep(f, lambda x: f"{x}.status = 'warning'")})", findings=f, properties=f"{e}.raw")))
    total = lambda name: f"CAST(aggregate(entities, 0L, (n, e) -> n + e.{name}) AS BIGINT)"
    rows = rows.selectExpr("page_id", "url", "failed", f"{judged} AS entities").selectExpr(
        "*", f"{total('errors')} + size(failed) AS _errors", f"{total('warnings')} AS _warnings")
    return rows.selectExpr("page_id", "url", "entities", "failed", (
        "named_struct('entities', CAST(size(entities) AS BIGINT), 'types', array_distinct(entities.type), 'errors', _errors, 'warnings', _warnings, "
        "'parse_errors', CAST(size(failed) AS BIGINT), 'status', CASE WHEN _errors > 0 THEN 'error' WHEN _warnings > 0 THEN 'warning' ELSE 'ok' END) AS summary"))


def summarize_pages(parsed: DataFrame, requirements: list[dict] = REQUIREMENTS, microdata: bool = True) -> DataFrame:
    """(page_id, entities, types, errors, warnings, parse_errors, status), as `summarize_schema` gives it, in the page's row."""
    return structured_pages(parsed, requirements, microdata).select("page_id", "summary.*")
