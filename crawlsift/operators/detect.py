"""Tracker, technology and app detection: page signals joined to registries.

Theta conditions are made equi-joins first: a host is exploded into its domain suffixes, a cookie name into its
prefixes. What is shuffled afterwards is hits, not signals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.sql import any_of, each, extract_all, keep, lit, matches, struct
from crawlsift.functions.text import map_get
from crawlsift.functions.urls import host_of, host_suffixes, name_prefixes
from crawlsift.registry.apps import APPS
from crawlsift.registry.rows import category_table, signal_table
from crawlsift.registry.technologies import TECHNOLOGIES
from crawlsift.registry.trackers import ID_PATTERNS, TRACKERS

_TRACKER_KINDS = {"globals": ("global", "window.{}"), "hosts": ("host", "{}"), "cookies": ("cookie", "cookie {}")}
_STACK_KINDS = {"globals": ("global", "window.{}"), "markers": ("marker", "DOM: {}"), "paths": ("path", "{}"),
                "classes": ("class", "class {}"), "generators": ("generator", "generator: {}")}


def _keys(kind: str, array: str, expand=None) -> str:
    values = array if expand is None else f"flatten({each(array, expand)})"
    return each(values, lambda v: struct(kind=lit(kind), key=v))


def _hits(rows: DataFrame, keys: list[str], registry: DataFrame, carry: list[str]) -> DataFrame:
    array = f"array_distinct(concat({', '.join(keys)}))"
    exploded = rows.selectExpr(*carry, f"explode_outer({array}) AS _k").filter("_k IS NOT NULL")
    return exploded.select(*carry, "_k.*").join(registry, ["kind", "key"])


_EVIDENCE = "transform(array_sort(collect_set(named_struct('r', kind_rank, 'i', item, 'e', evidence))), x -> x.e)"


def detect_trackers(signals: DataFrame, registry: list[dict] = TRACKERS, carry: list[str] | None = None) -> DataFrame:
    """(page_id, carry..., id, name, category, ordinal, evidence): output of `tracking_signals` against the registry.

    `carry` names page columns, such as the host, that roll-ups need: they travel with the hits and no join fetches them.
    """
    kept = ["page_id", *(carry or [])]
    table = signal_table(signals.sparkSession, registry, _TRACKER_KINDS)
    hits = _hits(signals, [
        _keys("global", "globals"),
        _keys("host", "concat(scripts, iframes)", lambda u: host_suffixes(host_of(u))),
        _keys("cookie", "cookie_names", name_prefixes),
    ], table, kept)
    return hits.groupBy(*kept, "id", "name", "category", "ordinal").agg(F.expr(_EVIDENCE).alias("evidence"))


def detect_stack(signals: DataFrame, registry: list[dict] = TECHNOLOGIES, carry: list[str] | None = None) -> DataFrame:
    """(page_id, carry..., id, name, category, ordinal, version, evidence, confidence), conflicts resolved."""
    kept = ["page_id", *(carry or [])]
    spark = signals.sparkSession
    entries = [{**e, "generators": [e["generator"]] if e.get("generator") else []} for e in registry]
    table = signal_table(spark, entries, _STACK_KINDS)
    keys_of = lambda field: sorted({v for e in entries for v in e.get(field) or []})
    literals = lambda values: f"CAST(array({', '.join(lit(v) for v in values)}) AS ARRAY<STRING>)"
    paths = keep(literals(keys_of("paths")), lambda p: any_of("_urls", lambda u: f"contains({u}, lower({p}))"))
    classes = keep(literals(keys_of("classes")), lambda c: f"contains(_class, lower({c}))")
    generators = "array_compact(CAST(array(" + ", ".join(
        f"if({matches('generator', '(?i)' + g)}, {lit(g)}, NULL)" for g in keys_of("generators")) + ") AS ARRAY<STRING>))"
    # one decisive sign of modern Angular rules AngularJS out; decided in the page's row, before any shuffle
    modern = "array_contains(markers, 'ng-version') OR array_contains(globals, 'getAllAngularRootElements')"
    rows = signals.selectExpr(
        *kept, "globals", "markers", "generator", "versions", f"({modern}) AS modern",
        f"{each('urls', lambda u: f'lower({u})')} AS _urls",
        "lower(concat(html_class, ' ', body_class)) AS _class")
    hits = _hits(rows, [
        _keys("global", "globals"), _keys("marker", "markers"), _keys("path", paths), _keys("class", classes),
        _keys("generator", generators),
    ], table, [*kept, "generator", "versions", "modern"]).filter("NOT (modern AND id = 'angularjs')")
    version_keys = {e["id"]: e["version"] for e in registry if e.get("version")}
    named = "CASE id " + " ".join(f"WHEN {lit(i)} THEN {lit(v)}" for i, v in version_keys.items()) + " ELSE '' END"
    shown = hits.selectExpr(
        *kept, "id", "name", "category", "ordinal", "kind_rank", "item",
        "if(kind = 'generator', concat('generator: ', generator), evidence) AS evidence",
        f"{map_get('versions', named)} AS version")
    found = shown.groupBy(*kept, "id", "name", "category", "ordinal").agg(
        F.max("version").alias("version"), F.expr(_EVIDENCE).alias("evidence"))
    return found.selectExpr("*", "if(size(evidence) > 1, 'high', 'low') AS confidence")


def resolve_conflicts(detected: DataFrame) -> DataFrame:
    """AngularJS out where modern Angular is certain. `detect_stack` already did; for detections made elsewhere."""
    certain = detected.filter(
        "id = 'angular' AND arrays_overlap(evidence, array('DOM: ng-version', 'window.getAllAngularRootElements'))"
    ).selectExpr("page_id", "'angularjs' AS id")
    return detected.join(certain, ["page_id", "id"], "left_anti")


def detect_apps(urls: DataFrame, registry: list[dict] = APPS) -> DataFrame:
    """(page_id, id, name, ordinal) from rows with a `urls` array."""
    table = signal_table(urls.sparkSession, registry, {"hosts": ("host", "{}")})
    hits = _hits(urls, [_keys("host", "urls", lambda u: host_suffixes(host_of(u)))], table, ["page_id"])
    return hits.select("page_id", "id", "name", "ordinal").distinct()


def extract_tag_ids(signals: DataFrame, patterns: list[tuple[str, str, int]] = ID_PATTERNS,
                    cap: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """(page_id, carry..., pos, label, value): tag identifiers in script addresses, containers and inline code."""
    found = "array_distinct(concat(" + ", ".join(
        each(extract_all("_text", p, g), lambda v, label=label: struct(label=lit(label), value=v))
        for label, p, g in patterns) + "))"
    text = "array_join(concat(scripts, gtm_containers, array(inline)), '\\n')"
    page = ["page_id", *(carry or [])]
    rows = signals.selectExpr(*page, f"{text} AS _text").selectExpr(*page, f"{found} AS _ids")
    kept = "_ids" if cap is None else f"slice(_ids, 1, {cap})"
    out = rows.selectExpr(*page, f"posexplode_outer({kept}) AS (pos, _i)").filter("pos IS NOT NULL")
    return out.select(*page, "pos", "_i.*")


def _category_maps(detected: DataFrame, *extra) -> DataFrame:
    per_category = detected.groupBy("page_id", "category").agg(F.count(F.lit(1)).alias("n"), *extra)
    return per_category


def summarize_trackers(detected: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, total, by_category, has_consent, needs_consent, status)."""
    counts = _category_maps(detected).groupBy("page_id").agg(
        F.sum("n").alias("total"),
        F.expr("map_from_entries(array_sort(collect_list(struct(category, n))))").alias("by_category"),
        F.expr("bool_or(category = 'consent')").alias("has_consent"),
        F.expr("bool_or(category IN ('advertising', 'session'))").alias("needs_consent"))
    if pages is not None:
        counts = pages.select("page_id").join(counts, "page_id", "left")
    filled = counts.selectExpr(
        "page_id", "coalesce(total, 0) AS total",
        "coalesce(by_category, CAST(map() AS MAP<STRING, BIGINT>)) AS by_category",
        "coalesce(has_consent, false) AS has_consent", "coalesce(needs_consent, false) AS needs_consent")
    return filled.selectExpr("*", "CASE WHEN needs_consent AND NOT has_consent THEN 'warning' WHEN total > 0 "
                                  "THEN 'info' ELSE 'ok' END AS status")


def summarize_stack(detected: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, total, by_category, confident)."""
    counts = _category_maps(detected, F.expr("count_if(confidence = 'high')").alias("c")).groupBy("page_id").agg(
        F.sum("n").alias("total"),
        F.expr("map_from_entries(array_sort(collect_list(struct(category, n))))").alias("by_category"),
        F.sum("c").alias("confident"))
    if pages is not None:
        counts = pages.select("page_id").join(counts, "page_id", "left")
    return counts.selectExpr("page_id", "coalesce(total, 0) AS total",
                             "coalesce(by_category, CAST(map() AS MAP<STRING, BIGINT>)) AS by_category",
                             "coalesce(confident, 0) AS confident")


def group_by_category(detected: DataFrame, categories: list[tuple[str, str]]) -> DataFrame:
    """Detections with their category's label and display position; order by them to list groups."""
    return detected.join(category_table(detected.sparkSession, categories), "category")


def confident_only(detected: DataFrame) -> DataFrame:
    return detected.filter("confidence = 'high'")


def consent_gaps(detected: DataFrame) -> DataFrame:
    """Pages with advertising or session replay and no consent tool."""
    wanting = detected.filter("category IN ('advertising', 'session')").select("page_id").distinct()
    return wanting.join(detected.filter("category = 'consent'").select("page_id"), "page_id", "left_anti")
