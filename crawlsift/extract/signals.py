"""Signals that give trackers and technologies away, one row per page.

Live facts (globals, cookies, versions) come from an optional captured-crawl table `runtime`; without it, globals
are inferred from inline scripts. `evidence_kind` keeps the two apart. Cookie names only, never values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlsift.extract.markup import attr, attr_or, tags
from crawlsift.functions.sql import any_of, case, each, extract_all, keep, let, lit, matches
from crawlsift.functions.text import clip, first_n, js_length, js_trim
from crawlsift.functions.urls import absolute_or
from crawlsift.registry import technologies, trackers

_NO_TEXTS = "CAST(array() AS ARRAY<STRING>)"


def _with_runtime(rows: DataFrame, runtime: DataFrame | None, fields: dict[str, str]) -> DataFrame:
    """Left-join the captured fields (one row per page) as `rt_*`; NULLs where nothing was captured."""
    if runtime is None:
        return rows.selectExpr("*", *[f"CAST(NULL AS {t}) AS rt_{f}" for f, t in fields.items()])
    present = [f if f in runtime.columns else f"CAST(NULL AS {t})" for f, t in fields.items()]
    captured = runtime.selectExpr("page_id", *[f"{e} AS rt_{f}" for e, f in zip(present, fields, strict=True)])
    return rows.join(captured, "page_id", "left")


def inline_text(scripts: str, each_max: int | None = None, total_max: int | None = None) -> str:
    """Scripts without src, joined."""
    bodies = keep(scripts, lambda s: f"coalesce({attr(s + '.tag', 'src')}, '') = '' AND {s}.body <> ''")
    texts = each(bodies, lambda s: f"{s}.body")
    if each_max is not None:
        texts = keep(texts, lambda t: f"octet_length({t}) <= {each_max} OR {js_length(t)} <= {each_max}")
    if total_max is None:
        return f"coalesce(concat('\\n', array_join({texts}, '\\n')), '')"
    joined = (f"aggregate({texts}, '', (acc, t) -> CASE WHEN length(acc) >= {total_max} THEN acc "
              "ELSE concat(acc, '\\n', t) END)")
    return f"substr({joined}, 1, {total_max})"


def _globals_in(inline: str, watched: list[str]) -> str:
    """Watched names that inline code assigns or calls."""
    found = extract_all(inline, r"(?<![\w$.])(?:window\.|self\.)?([A-Za-z_$][\w$]*)\s*(?:=(?!=)|\(|\.push)", 1)
    return let(found, lambda f: keep(f"array({', '.join(lit(w) for w in watched)})",
                                     lambda w: f"array_contains({f}, {w})"))


def tracking_signals(parsed: DataFrame, runtime: DataFrame | None = None, scripts: int | None = None,
                     iframes: int | None = None, cookies: int | None = None) -> DataFrame:
    """(page_id, url, globals, scripts, iframes, cookie_names, gtm_containers, inline, evidence_kind)."""
    sources = each(keep("scripts", lambda s: f"{attr_or(s + '.tag', 'src')} <> ''"),
                   lambda s: absolute_or("base", attr(s + ".tag", "src"), "raw"))
    frames = each(tags("markup", "iframe"), lambda t: absolute_or("base", attr_or(t, "src"), "raw"))
    rows = parsed.selectExpr(
        "page_id", "url", f"{first_n(sources, scripts)} AS scripts",
        f"{first_n('array_distinct(' + keep(frames, lambda f: f + chr(60) + chr(62) + repr('')) + ')', iframes)} AS iframes",
        f"{inline_text('scripts')} AS inline")
    rows = _with_runtime(rows, runtime, {"globals": "ARRAY<STRING>", "cookie_names": "ARRAY<STRING>",
                                         "gtm_containers": "ARRAY<STRING>"})
    names = keep("array_distinct(rt_cookie_names)", lambda c: f"{c} <> ''")
    return rows.selectExpr(
        "page_id", "url", f"coalesce(rt_globals, {_globals_in('inline', trackers.WATCHED_GLOBALS)}) AS globals",
        "scripts", "iframes", f"coalesce({first_n(names, cookies)}, {_NO_TEXTS}) AS cookie_names",
        f"coalesce({keep('rt_gtm_containers', lambda k: f'startswith({k}, {lit('GTM-')})')}, {_NO_TEXTS}) "
        "AS gtm_containers", "inline", "if(coalesce(rt_globals, rt_cookie_names, rt_gtm_containers) IS NULL, 'static', 'runtime') AS evidence_kind")


def _marker_test(rule: dict, tag: str) -> str:
    tests = [f"{attr(tag, a)} IS NOT NULL" for a in rule.get("attr", [])]
    tests += [f"{attr(tag, 'id')} = {lit(i)}" for i in rule.get("id", [])]
    tests += [matches(tag, rf"(?i)^<{t}[\s/>]") for t in rule.get("tag", [])]
    words = f"concat(' ', {clip(attr_or(tag, 'class'), None)}, ' ')"
    tests += ["(" + " AND ".join(f"contains({words}, {lit(f' {c} ')})" for c in names) + ")"
              for names in rule.get("class", [])]
    tests += [f"contains({attr_or(tag, 'class')}, {lit(p)})" for p in rule.get("class_part", [])]
    return " OR ".join(f"coalesce({t}, false)" for t in tests)


def _marker_hint(rule: dict) -> str:
    words = rule.get("attr", []) + rule.get("id", []) + rule.get("tag", []) + rule.get("class_part", []) + [
        names[0] for names in rule.get("class", [])]
    return "(" + " OR ".join(f"contains(lower(markup), {lit(w.lower())})" for w in words) + ")"


def stack_signals(parsed: DataFrame, runtime: DataFrame | None = None, urls: int | None = None,
                  markers: dict[str, dict] | None = None) -> DataFrame:
    """(page_id, url, globals, versions, markers, urls, generator, html_class, body_class, evidence_kind)."""
    markers = technologies.MARKERS if markers is None else markers
    found = "array(" + ", ".join(
        case((f"{_marker_hint(r)} AND {any_of('_tags', lambda t, r=r: _marker_test(r, t))}", lit(m)))
        for m, r in markers.items()) + ")"
    linked = keep(each(tags("markup", "script|link"), lambda t: absolute_or(
        "base", f"coalesce(nullif({case((matches(t, '(?i)^<script'), attr(t, 'src')))}, ''), {attr_or(t, 'href')})",
        "raw")), lambda u: f"{u} <> ''")
    generator = keep(tags("markup", "meta"), lambda t: f"{attr(t, 'name')} = 'generator'")
    klass = lambda tag: attr_or(f"get({tags('markup', tag)}, 0)", 'class')
    ng = f"get({keep('_tags', lambda t: attr(t, 'ng-version') + ' IS NOT NULL')}, 0)"
    rows = parsed.selectExpr("*", f"{extract_all('markup', '<[A-Za-z][^>]*>')} AS _tags").selectExpr(
        "page_id", "url", f"array_compact({found}) AS markers",
        f"{first_n(f'array_distinct({linked})', urls)} AS urls",
        f"{js_trim(attr_or(f'get({generator}, 0)', 'content'))} AS generator",
        f"{klass('html')} AS html_class", f"{klass('body')} AS body_class",
        f"{inline_text('scripts')} AS inline",
        f"{case(('contains(lower(markup), ' + lit('ng-version') + ')', attr(ng, 'ng-version')))} AS ng_version")
    rows = _with_runtime(rows, runtime, {"globals": "ARRAY<STRING>", "versions": "MAP<STRING,STRING>"})
    # bundlers number their chunk registries; both families are folded into one name
    folded = ("array_distinct(concat(filter(rt_globals, g -> NOT rlike(g, '^(webpackChunk|__NUXT)')), "
              "if(exists(rt_globals, g -> startswith(g, 'webpackChunk')), array('webpackChunk'), array()), "
              "if(exists(rt_globals, g -> startswith(g, '__NUXT')), array('__NUXT__'), array())))")
    return rows.selectExpr(
        "page_id", "url", f"coalesce({folded}, {_globals_in('inline', technologies.WATCHED_GLOBALS)}) AS globals",
        "map_concat(coalesce(map_filter(rt_versions, (k, v) -> k <> 'angular'), map()), "
        "if(ng_version IS NULL, map(), map('angular', ng_version))) AS versions",
        "markers", "urls", "generator", "html_class", "body_class",
        "if(rt_globals IS NULL AND rt_versions IS NULL, 'static', 'runtime') AS evidence_kind")


def long_signals(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """signals(page_id, kind, pos, value, evidence_kind) from array columns; `kinds` maps column to kind."""
    items = "concat(" + ", ".join(
        f"transform({c}, (v, i) -> named_struct('kind', {lit(k)}, 'pos', i, 'value', v))" for c, k in kinds.items()) + ")"
    out = rows.selectExpr("page_id", "evidence_kind", f"explode_outer({items}) AS s")
    return out.filter("s IS NOT NULL").select("page_id", "s.*", "evidence_kind")


def extract_tracking_signals(parsed: DataFrame, runtime: DataFrame | None = None) -> DataFrame:
    return long_signals(tracking_signals(parsed, runtime), {
        "globals": "global", "scripts": "script", "iframes": "iframe", "cookie_names": "cookie",
        "gtm_containers": "container"})


def extract_stack_signals(parsed: DataFrame, runtime: DataFrame | None = None) -> DataFrame:
    return long_signals(stack_signals(parsed, runtime), {"globals": "global", "markers": "marker", "urls": "url"})


