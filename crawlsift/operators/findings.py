"""Shared by every audit: the findings table, its summary, its severity order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.sql import lit, struct

STATUSES = ["ok", "warning", "error", "info"]
RANK = "CASE status WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 WHEN 'ok' THEN 3 ELSE 9 END"


def say(*parts: str) -> str:
    """Message expression: texts starting with '=' are SQL expressions, the rest is literal."""
    pieces = [f"CAST({p[1:]} AS STRING)" if p.startswith("=") else lit(p) for p in parts]
    return pieces[0] if len(pieces) == 1 else f"concat({', '.join(pieces)})"


def finding(group: str, id_: str, label: str, status: str, message: str, value: str | None = None) -> str:
    """One finding as a struct expression; `label` and `message` as in `say`, `value` an expression."""
    message = message if message.startswith("concat(") else say(message)
    return struct(id=lit(id_), group=lit(group), label=label if label.startswith("concat(") else say(label),
                  status=lit(status), message=message, value=f"CAST({value or 'NULL'} AS STRING)")


def explode_findings(df: DataFrame, rules: list[str], audit: str, carry: list[str] | None = None) -> DataFrame:
    """The rules that fired, one row each, `seq` giving rule order."""
    carry = carry or ["page_id"]
    fired = f"filter(array({', '.join(rules)}), r -> r IS NOT NULL)"
    rows = df.selectExpr(*carry, f"{fired} AS _f").select(*carry, F.posexplode_outer("_f").alias("seq", "_r"))
    return rows.filter("seq IS NOT NULL").selectExpr(*carry, f"{lit(audit)} AS audit", "_r.*", "seq")


def by_severity(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Worst first inside each page; ties keep rule order."""
    return findings.orderBy(*(keys or ["page_id"]), F.expr(RANK), "seq")


def issues_only(findings: DataFrame) -> DataFrame:
    return findings.filter("status IN ('warning', 'error')")


def status_counts() -> list:
    return [F.expr(f"count_if(status = '{s}')").alias(s) for s in STATUSES] + [
        F.expr("count_if(status IN ('ok', 'warning', 'error', 'info'))").alias("total")]


OVERALL = "CASE WHEN error > 0 THEN 'error' WHEN warning > 0 THEN 'warning' ELSE 'ok' END AS status"


def summarize_status(rows: DataFrame, pages: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts per status and one overall status per key. With `pages`, pages without rows count as ok.

    There is a row of counts per page, so they are merged: sizes of files say little of what pages hold, and would have them broadcast.
    """
    keys = keys or ["page_id"]
    counts = rows.groupBy(*keys).agg(*status_counts())
    if pages is not None:
        counts = pages.select(*keys).join(counts.hint("merge"), keys, "left").na.fill(0)
    return counts.selectExpr("*", OVERALL)


summarize_findings = summarize_status


def rollup_findings(findings: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Findings per site section, audit rule and status, with every subtotal (`rollup`)."""
    extra = [c for c in by if c not in findings.columns]
    rows = findings.join(pages.select("page_id", *extra), "page_id") if extra else findings
    return rows.rollup(*by, "id", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
