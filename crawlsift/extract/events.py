"""Event queues of a page: layers and their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlsift.functions.sql import case, each, extract, extract_all, keep, let, lit, matches, struct, substitute

# Conventional queue names, in reporting order.
LAYER_NAMES = ["dataLayer", "digitalData", "utag_data", "dataLayerGA4", "_mtm"]
_QUEUE = r"(?:(?i:[\w$]*datalayer[\w$]*)|digitalData|utag_data|_mtm)"
_OWNER = r"(?<![\w$.])(?:(?:window|self)\s*\.\s*)?"
# strings and comments whole, so nothing inside them counts | the three ways to fill a queue | keys and trailing commas with what follows
_LITERAL_TOKENS = (
    r"""(?s)"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|`[^`]*+`|//[^\n]*+|/\*.*?\*/"""
    rf"|{_OWNER}{_QUEUE}\s*\.\s*push\s*\(|(?<![\w$.])(?<!function\s)gtag\s*\("
    rf"|{_OWNER}{_QUEUE}\s*=\s*(?:(?:(?:window|self)\s*\.\s*)?{_QUEUE}\s*\|\|\s*)?(?=\[)"
    r"|[\w$]++\s*+:|[\w$][\w$.]*+|,\s*+[}\])]|![01](?![\w$.])|\)|[^\"'`/\w$,!)]++|."
)
_MARK, _FROM = "\x01", "\x02"
LAYER_RANK = "coalesce(nullif(array_position(array(" + ", ".join(f"'{n}'" for n in LAYER_NAMES) + "), {}), 0), 99)"


def _as_json(token: str) -> str:
    """One token of a script as JSON writes it; a place where a queue is filled becomes mark, queue, kind and the list of its items."""
    quoted = substitute(f"substr({token}, 2, length({token}) - 2)", r"""(?s)(\\[^"'])|\\(["'])""", "$1$2")
    site = lambda name, kind: f"concat({lit(_MARK)}, {name}, {lit(_FROM + kind)})"
    return case(
        (f"startswith({token}, '\"')", substitute(token, r"(?s)(\\[^'])|\\(')", "$1$2")),
        (f"startswith({token}, {lit(chr(39))})", f"concat('\"', replace({quoted}, '\"', {lit(chr(92) + chr(34))}), '\"')"),
        (matches(token, r"^/[/*]"), "' '"),
        (matches(token, r"(?s)^gtag\s*\(\z"), site("'dataLayer'", "command[")),
        (matches(token, r"(?s)push\s*\(\z"), site(extract(token, r"(?s)([\w$]+)\s*\.\s*push\s*\(\z", 1), "items[")),
        (matches(token, r"(?s)^[\w$][\w$.\s]*="), site(extract(token, r"(?s)([\w$]+)\s*=", 1), "items")),
        (matches(token, r"(?s)^[\w$]+\s*:\z"), f"concat('\"', {extract(token, r'^[\w$]+')}, '\":')"),
        (matches(token, r"(?s)^,\s*[}\])]\z"), f"replace(right({token}, 1), ')', ']')"),
        (f"{token} = ')'", "']'"), (f"{token} = 'undefined'", "'null'"), (f"{token} = '!0'", "'true'"), (f"{token} = '!1'", "'false'"),
        otherwise=token)


def _pushed(scripts: str) -> str:
    """ARRAY<STRUCT<name, raw>>: the items that inline scripts put into queues, in document order.

    Array initialisers, `push` with any number of arguments and `gtag` commands; keys without quotes, single quotes, comments, trailing
    commas, `undefined`, `!0` and `!1` are read as JavaScript does, at any depth. What is no literal (a call, a variable) is not kept, nor
    what stands beside it in the same call or list. A script is cut into tokens once, and its text is parsed once per place.
    """
    named = keep(scripts, lambda s: matches(f"{s}.body", rf"{_QUEUE}|gtag\s*\("))
    text = lambda s: f"array_join({each(extract_all(f'translate({s}.body, {lit(_MARK + _FROM)}, {lit(str())})', _LITERAL_TOKENS), _as_json)}, '')"
    places = f"flatten({each(named, lambda s: keep(f'split({text(s)}, {lit(_MARK)})', lambda p: f'contains({p}, {lit(_FROM)})'))})"

    def items(place: str) -> str:
        kind = f"substring_index({place}, {lit(_FROM)}, -1)"
        found = lambda t: case(
            (f"try_parse_json({t}.list) IS NULL", "CAST(array() AS ARRAY<STRING>)"),
            (f"{t}.kind = 'command'", f"array(get_json_object({t}.list, '$'))"),
            otherwise=f"transform(arrays_zip(from_json({t}.list, 'ARRAY<STRING>'), from_json({t}.list, 'ARRAY<VARIANT>')), i -> CASE WHEN "
                      "i['0'] IS NULL THEN 'null' WHEN schema_of_variant(i['1']) = 'STRING' THEN to_json(i['1']) ELSE i['0'] END)")
        parts = struct(name=f"substring_index({place}, {lit(_FROM)}, 1)", kind=extract(kind, "^[a-z]+"), list=substitute(kind, "^[a-z]+"))
        return let(parts, lambda t: each(found(t), lambda raw: struct(name=f"{t}.name", raw=raw)))

    return f"flatten({each(places, items)})"


def extract_layers(parsed: DataFrame, runtime: DataFrame | None = None, layers: int | None = None,
                   entries: int | None = None) -> DataFrame:
    """layer_entries(page_id, layer, index, raw, value VARIANT, total, truncated, evidence_kind).

    With a captured-crawl table, its `layers ARRAY<STRUCT<name, total, entries ARRAY<STRING>>>` (JSON texts);
    otherwise the literals that inline scripts put into queues (see `_pushed`).
    """
    if runtime is not None:
        queues = runtime.selectExpr(
            "page_id", "filter(layers, l -> l.name IN (" + ", ".join(lit(n) for n in LAYER_NAMES)
            + ") OR rlike(l.name, '(?i)datalayer')) AS found", "'runtime' AS evidence_kind")
        queues = queues.selectExpr("page_id", "transform(found, (l, i) -> named_struct('name', l.name, 'total', l.total, "
                                              "'entries', l.entries, 'i', i)) AS found", "evidence_kind")
    else:
        queues = parsed.selectExpr("page_id", "'static' AS evidence_kind", let(_pushed("scripts"), lambda p: (
            f"transform(array_distinct(transform({p}, x -> x.name)), (n, i) -> named_struct('name', n, 'total', "
            f"size(filter({p}, x -> x.name = n)), 'entries', transform(filter({p}, x -> x.name = n), x -> x.raw), 'i', i))")) + " AS found")
    ranked = f"array_sort(transform(found, l -> named_struct('rank', {LAYER_RANK.format('l.name')}, 'i', l.i, 'l', l)))"
    some = ranked if layers is None else f"slice({ranked}, 1, {layers})"
    rows = queues.selectExpr("page_id", "evidence_kind", f"explode_outer({some}) AS q").filter("q IS NOT NULL")
    kept_entries = "q.l.entries" if entries is None else f"slice(q.l.entries, 1, {entries})"
    out = rows.selectExpr("page_id", "q.l.name AS layer", "q.l.total AS total", "evidence_kind",
                          f"posexplode_outer({kept_entries}) AS (index, raw)").filter("index IS NOT NULL")
    truncated = "false" if entries is None else f"total > {entries}"
    return out.selectExpr("page_id", "layer", "index", "raw", "try_parse_json(raw) AS value", "total",
                          f"{truncated} AS truncated", "evidence_kind")
