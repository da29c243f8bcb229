"""Whole jobs put together from extraction, operators and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.extract.facts import extract_page_facts
from crawlsift.extract.markup import parse_pages
from crawlsift.operators.corpus import with_host
from crawlsift.operators.seo import audit_pages
from crawlsift.sources import inspectable


def site_audit(pages: DataFrame) -> DataFrame:
    """(host, id, status, pages): which rule causes how many verdicts on each site.

    Scan, projections, one partial aggregate, one exchange of (host, rule, status) counts.
    """
    facts = extract_page_facts(parse_pages(inspectable(pages)))
    findings = audit_pages(with_host(facts), ["page_id", "host"])
    return findings.groupBy("host", "id", "status").agg(F.count(F.lit(1)).alias("pages"))
