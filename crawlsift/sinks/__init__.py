"""Sinks: CSV, JSON, Markdown and text reports, written in parallel by page or by site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.extract.events import LAYER_RANK
from crawlsift.functions.csv import BOM, csv_line
from crawlsift.functions.sql import lit, substitute
from crawlsift.functions.urls import host_of
from crawlsift.operators.findings import OVERALL, status_counts
from crawlsift.operators.seo import GROUPS
from crawlsift.registry.rows import category_table

TOOL = "crawlsift"

# How a status reads in a report.
MARKER = {"ok": "OK", "warning": "WARN", "error": "FAIL", "info": "INFO"}
_MARK = "CASE status " + " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in MARKER.items()) + " ELSE '-' END"
_JOIN = "array_join(transform(array_sort(collect_list(struct({order}, line))), x -> x.line), {sep})"


def export_key(prefix: str, url: str, extension: str, date: str) -> str:
    """`slug-host-YYYY-MM-DD.ext`, every part reduced to safe characters."""
    def clean(text: str, fallback: str) -> str:
        safe = substitute(f"lower({substitute(text, '(?i)[^a-z0-9]+', '-')})", "^-+|-+$")
        return f"coalesce(nullif({safe}, ''), {lit(fallback)})"

    ext = f"coalesce(nullif(lower({substitute(extension, '(?i)[^a-z0-9]')}), ''), 'txt')"
    return (f"concat({clean(prefix, 'export')}, '-', {clean(host_of(url), 'page')}, '-', "
            f"date_format({date}, 'yyyy-MM-dd'), '.', {ext})")


def csv_lines(rows: DataFrame, columns: list[str], delimiter: str = ",", order: list[str] | None = None) -> DataFrame:
    """(carried..., line): one guarded CSV line per row; the header is `csv_header`."""
    carry = [c for c in rows.columns if c not in columns] if order is None else order
    return rows.selectExpr(*carry, f"{csv_line(columns, delimiter)} AS line")


def csv_documents(rows: DataFrame, columns: list[str], order: str, delimiter: str = ",", bom: bool = True,
                  key: str = "page_id") -> DataFrame:
    """(key, document): one CSV file's text per page, header first, lines ended as RFC 4180 wants between them."""
    lines = rows.selectExpr(key, order, f"{csv_line(columns, delimiter)} AS line")
    body = lines.groupBy(key).agg(F.expr(_JOIN.format(order=order, sep="'\\r\\n'")).alias("body"))
    return body.selectExpr(key, f"concat({lit(BOM if bom else '')}, {lit(delimiter.join(columns))}, '\\r\\n', body) AS document")


def write_csv(rows: DataFrame, path: str, columns: list[str], delimiter: str = ",", bom: bool = True, order: list[str] | None = None) -> None:
    """Every row as a line of part files under `path`/rows, in the order of their names; the header is a file of its own, `path`/header.

    Rows are ranged and sorted by `order` (page and position where the rows have them). Read as a whole, header first, the files are one
    CSV document; so no part repeats the header, and a part that is written again after a lost executor is the same.
    """
    keys = order or [c for c in ("page_id", "table_index", "row", "pos", "index") if c in rows.columns] or columns
    lines = rows.selectExpr(*[f"`{k}` AS _o{i}" for i, k in enumerate(keys)], f"{csv_line(columns, delimiter)} AS value")
    names = [f"_o{i}" for i in range(len(keys))]
    lines.repartitionByRange(*names).sortWithinPartitions(*names).select("value").write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/rows")
    header = rows.sparkSession.createDataFrame([((BOM if bom else "") + delimiter.join(columns),)], "value string")
    header.coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")


def write_plain_urls(urls: DataFrame, path: str) -> None:
    """One address a line, ordered by page and position over the part files."""
    urls.repartitionByRange("page_id", "pos").sortWithinPartitions("page_id", "pos").select("value").write.mode("overwrite").text(path)


def write_markdown(documents: DataFrame, path: str, buckets: int = 64) -> None:
    """Documents with their host, in `buckets` directories by a hash of the host: a site's pages lie together, and sites need no file each."""
    named = documents.selectExpr("*", f"{host_of('url')} AS host")
    named.selectExpr("*", f"pmod(xxhash64(host), {buckets}) AS bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _one_line(value: str) -> str:
    return f"trim({substitute(f'coalesce({value}, {lit(str())})', r'\s*\n\s*', ' / ')})"


def audit_markdown(facts: DataFrame, findings: DataFrame, audited_at: str = "current_timestamp()",
                   tool: str = TOOL) -> DataFrame:
    """(page_id, report): the page audit as Markdown, one section per group that has findings."""
    groups = category_table(findings.sparkSession, GROUPS)
    rows = findings.join(groups, findings["group"] == groups["category"]).selectExpr(
        "page_id", "category_ordinal", "category_label", "seq", "status",
        f"concat('- **[', {_MARK}, '] ', label, '** - ', message, if({_one_line('value')} = '', '', "
        f"concat('\\n  - `', {_one_line('value')}, '`'))) AS line")
    sections = rows.groupBy("page_id", "category_ordinal", "category_label").agg(
        F.expr(_JOIN.format(order="seq", sep="'\\n'")).alias("body"), *status_counts())
    joined = sections.selectExpr("*", "concat('## ', category_label, '\\n\\n', body, '\\n') AS line").groupBy("page_id").agg(
        F.expr(_JOIN.format(order="category_ordinal", sep="'\\n'")).alias("body"), F.sum("error").alias("error"),
        F.sum("warning").alias("warning"), F.sum("ok").alias("ok"))
    when = "captured_at" if "captured_at" in facts.columns else audited_at
    return facts.selectExpr("page_id", "url", "title", f"{when} AS at").join(joined, "page_id").selectExpr(
        "page_id", f"concat_ws('\\n', {lit(f'# {tool} report')}, '', concat('- **URL:** ', coalesce(url, 'unknown')), "
        "concat('- **Title:** ', coalesce(title, '(none)')), concat('- **Audited:** ', CAST(at AS STRING)), "
        "concat('- **Result:** ', error, ' error(s), ', warning, ' warning(s), ', ok, ' passing'), '', body, '---', "
        "" + lit(f"Generated by {tool}.") + ") AS report")


def audit_json(facts: DataFrame, findings: DataFrame, audited_at: str = "current_timestamp()",
               tool: str = TOOL) -> DataFrame:
    """(page_id, json): summary, findings and page facts of each page."""
    per_page = findings.groupBy("page_id").agg(
        F.expr("transform(array_sort(collect_list(struct(seq, id, `group`, label, status, message, value))), x -> "
               "struct(x.id, x.`group`, x.label, x.status, x.message, x.value))").alias("findings"), *status_counts())
    when = "captured_at" if "captured_at" in facts.columns else audited_at
    page = facts.select("page_id", F.struct(*[c for c in facts.columns if c != "page_id"]).alias("page"),
                        F.expr(f"{when} AS at"), "url")
    counted = per_page.selectExpr("page_id", "findings", "struct(ok, warning, error, info, total, "
                                  + OVERALL.replace(" AS status", "") + " AS status) AS summary")
    # both sides hold a row per page, however small the files that the pages came from
    return page.join(counted.hint("merge"), "page_id").selectExpr(
        "page_id", f"to_json(struct({lit(tool)} AS tool, 1 AS version, url, at AS auditedAt, summary, findings, page), "
                   "map('ignoreNullFields', 'false')) AS json")


def schema_json(entities: DataFrame, findings: DataFrame, blocks: DataFrame, summary: DataFrame, pages: DataFrame,
                tool: str = TOOL) -> DataFrame:
    """(page_id, json): entities with their findings, failed blocks and the summary of each page."""
    keys = ["page_id", "path"]
    judged = findings.groupBy(*keys).agg(
        F.expr("count_if(status = 'error')").alias("errors"), F.expr("count_if(status = 'warning')").alias("warnings"),
        F.expr("transform(array_sort(collect_list(struct(seq, status, label, message))), x -> struct(x.status, x.label, "
               "x.message))").alias("findings"))
    items = entities.join(judged, keys, "left").groupBy("page_id").agg(F.expr(
        "transform(array_sort(collect_list(struct(ord, type, source, path, errors, warnings, findings, raw))), x -> struct("
        "x.type, x.source, x.path, x.errors, x.warnings, x.findings, try_parse_json(x.raw) AS properties))").alias("entities"))
    failed = blocks.filter("NOT ok").groupBy("page_id").agg(F.expr(
        "array_sort(collect_list(struct(block AS index, error, excerpt)))").alias("parseErrors"))
    totals = summary.select("page_id", F.struct(*[c for c in summary.columns if c != "page_id"]).alias("summary"))
    rows = pages.select("page_id", "url").join(totals, "page_id").join(items, "page_id", "left").join(failed, "page_id", "left")
    return rows.selectExpr(
        "page_id", f"to_json(struct({lit(tool)} AS tool, 1 AS version, url, current_timestamp() AS inspectedAt, summary, "
                   "coalesce(parseErrors, array()) AS parseErrors, coalesce(entities, array()) AS entities)) AS json")


def schema_documents(structured: DataFrame, tool: str = TOOL, inspected_at: str = "current_timestamp()") -> DataFrame:
    """(page_id, json): the same document from `structured_pages(..., raw=True)`, in the page's row. A Microdata item's properties are an
    object: repeated names are arrays, nested items objects of type, id and properties."""
    entities = ("transform(entities, e -> named_struct('type', e.type, 'source', e.source, 'path', e.path, 'errors', e.errors, 'warnings', e.warnings, "
                "'findings', e.findings, 'properties', try_parse_json(e.properties)))")
    return structured.selectExpr(
        "page_id", f"to_json(struct({lit(tool)} AS tool, 1 AS version, url, {inspected_at} AS inspectedAt, summary, failed AS parseErrors, "
                   f"{entities} AS entities)) AS json")


def layers_json(entries: DataFrame, pages: DataFrame, tool: str = TOOL, containers: DataFrame | None = None,
                captured_at: str = "current_timestamp()") -> DataFrame:
    """(page_id, json): every layer with its entries, in queue order.

    `containers` has a page's tag-manager containers in `gtm_containers`, as `tracking_signals` gives them. Pass the result of
    `filter_entries` to export what a search left.
    """
    layers = entries.groupBy("page_id", "layer", "total", "truncated").agg(F.expr(
        "transform(array_sort(collect_list(struct(index, raw))), x -> x.raw)").alias("raws"))
    ranked = f"struct({LAYER_RANK.format('layer')} AS rank, layer, total, truncated, raws)"
    per_page = layers.groupBy("page_id").agg(F.expr(
        f"transform(array_sort(collect_list({ranked})), x -> struct(x.layer AS name, x.total, x.truncated, "
        "transform(x.raws, r -> try_parse_json(r)) AS entries))").alias("layers"))
    rows = pages.select("page_id", "url", F.expr(captured_at).cast("timestamp").alias("at")).join(per_page, "page_id")
    if containers is not None:
        rows = rows.join(containers.select("page_id", "gtm_containers"), "page_id", "left")
    known = "CAST(array() AS ARRAY<STRING>)" if containers is None else "coalesce(gtm_containers, CAST(array() AS ARRAY<STRING>))"
    when = "date_format(at, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    return rows.selectExpr(
        "page_id", f"to_json(struct({lit(tool)} AS tool, 1 AS version, url, {when} AS capturedAt, {known} AS containers, layers)) AS json")


def report_markdown(rows: DataFrame, title: str, section: str, line: str, order: list[str], section_order: str = "section") -> DataFrame:
    """(page_id, report): a grouped bullet list. `section`, `line` and `title` are expressions over the rows."""
    lines = rows.selectExpr("page_id", f"{title} AS title", f"{section} AS section", f"{section_order} AS section_order",
                            f"struct({', '.join(order)}) AS line_order", f"{line} AS line")
    sections = lines.groupBy("page_id", "title", "section", "section_order").agg(
        F.expr(_JOIN.format(order="line_order", sep="'\\n'")).alias("body"))
    blocks = sections.selectExpr("page_id", "title", "section_order", "concat('## ', section, '\\n', body) AS line")
    return blocks.groupBy("page_id", "title").agg(
        F.expr(_JOIN.format(order="section_order", sep="'\\n\\n'")).alias("body")).selectExpr(
        "page_id", "concat(title, '\\n\\n', body) AS report")


def tracker_report(grouped: DataFrame, pages: DataFrame) -> DataFrame:
    return report_markdown(
        grouped.join(pages.select("page_id", "url"), "page_id"), "concat('Trackers on ', url)", "category_label",
        "concat('- ', name, ' (', array_join(evidence, ', '), ')')", ["ordinal"], "category_ordinal")


def stack_report(grouped: DataFrame, pages: DataFrame) -> DataFrame:
    return report_markdown(
        grouped.join(pages.select("page_id", "url"), "page_id"), "concat('Tech stack of ', url)", "category_label",
        "concat('- ', name, if(version = '', '', concat(' ', version)))", ["ordinal"], "category_ordinal")


def schema_report(findings: DataFrame, pages: DataFrame) -> DataFrame:
    return report_markdown(
        findings.join(pages.select("page_id", "url"), "page_id"), "concat('# Structured data\\n\\nURL: ', url)",
        "concat(type, ' (', source, ')')", f"concat('- [', {_MARK}, '] ', label, ' - ', message)", ["seq"], "ord")


def store_report(described: DataFrame, findings: DataFrame, apps: DataFrame, pages: DataFrame) -> DataFrame:
    rows = findings.selectExpr("page_id", "'Findings' AS section", "0 AS s", "seq",
                               f"concat('- [', {_MARK}, '] ', label, ' - ', message) AS line").unionByName(
        described.selectExpr("page_id", "`group` AS section", "CASE `group` WHEN 'Store' THEN 1 WHEN 'Theme' THEN 2 WHEN 'Page' "
                             "THEN 3 ELSE 4 END AS s", "seq",
                             "concat('- ', label, ': ', coalesce(nullif(value, ''), '(none)')) AS line")).unionByName(
        apps.selectExpr("page_id", "'Apps' AS section", "5 AS s", "ordinal AS seq", "concat('- ', name) AS line"))
    return report_markdown(rows.join(pages.select("page_id", "url"), "page_id"), "concat('# Shopify store\\n\\nURL: ', url)",
                           "section", "line", ["seq"], "s")


def tracker_rows(detected: DataFrame) -> DataFrame:
    return detected.selectExpr("page_id", "ordinal", "name AS tracker", "category", "array_join(evidence, ' | ') AS evidence")


def stack_rows(detected: DataFrame) -> DataFrame:
    return detected.selectExpr("page_id", "ordinal", "name AS technology", "category", "version", "confidence",
                               "array_join(evidence, ' | ') AS evidence")


def store_rows(described: DataFrame, apps: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Export columns: section, field, value."""
    rows = described.selectExpr("page_id", "`group` AS section", "label AS field", "value").unionByName(
        apps.selectExpr("page_id", "'Apps' AS section", "name AS field", "'detected' AS value"))
    if findings is None:
        return rows
    return rows.unionByName(findings.selectExpr("page_id", "'Findings' AS section", "label AS field",
                                                "concat(status, ': ', message) AS value"))
