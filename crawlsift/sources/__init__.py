"""Sources: captured pages as a table or a stream, and the guard in front of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlsift.functions.sql import case, in_list, lit, matches, struct
from crawlsift.functions.urls import host_of, normalise_url, protocol_of

PAGES = "page_id BIGINT, url STRING, html STRING"

# Addresses that cannot be inspected, with the message and hint shown for each.
BLOCKED_SCHEMES = ["chrome:", "chrome-extension:", "devtools:", "edge:", "about:", "view-source:", "data:"]
BLOCKED_HOSTS = ["chrome.google.com", "chromewebstore.google.com"]
_NO_PAGE = ("No page to inspect.", "Open a website in this tab, then reopen the extension.")
_NO_ADDRESS = ("This tab has no readable address.", "Try a normal web page.")
_FILE = ("Local files are blocked by default.",
         'Enable "Allow access to file URLs" for this extension on chrome://extensions.')
_SCHEME = "Chrome does not allow extensions on this page."
_HOST = ("Chrome does not allow extensions on the Web Store.", "Open any other website and try again.")


#: Session setting: how many partitions pages are dealt to before they are parsed. Unset, they stay as the files are split, without a
#: shuffle. It is for few files of one row group each, which Spark cannot split (as in bench.py).
INPUT_PARTITIONS = "spark.crawlsift.inputPartitions"
#: Rows that become pages only behind the scan: how many a task gets, and how many tasks they are dealt to at most (then each gets more).
TASK_ROWS, MAX_TASKS = 2000, 4096


def spread(df: DataFrame) -> DataFrame:
    parts = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def spread_rows(df: DataFrame) -> DataFrame:
    """For rows of a few bytes that a page is made of: a row group of them is a page table of gigabytes, so files are split far too coarsely.
    Unless the session says how many, as many partitions as the rows need; all rows are dealt out, one by one, whatever their keys."""
    if df.sparkSession.conf.get(INPUT_PARTITIONS, None):
        return spread(df)
    parts = min(MAX_TASKS, -(-df.count() // TASK_ROWS))
    return df.repartition(parts) if parts > 1 else df


def load_pages(spark: SparkSession, directory: str, table: str = "pages") -> DataFrame:
    return spread(spark.read.schema(PAGES).parquet(f"{directory}/{table}.parquet"))


def stream_pages(spark: SparkSession, directory: str, files_per_trigger: int = 64) -> DataFrame:
    """Arriving captures: pages plus the time they were captured."""
    return spark.readStream.schema(PAGES + ", captured_at TIMESTAMP").option(
        "maxFilesPerTrigger", files_per_trigger).parquet(directory)


def blocked(url: str) -> str:
    """struct<message, hint> saying why an address cannot be inspected; NULL when it can. Hosts match exactly."""
    why = lambda pair: struct(message=lit(pair[0]), hint=lit(pair[1]))
    scheme = protocol_of(url)
    return case(
        (f"coalesce({url}, '') = ''", why(_NO_PAGE)),
        (f"{scheme} IS NULL OR ({matches(url, '(?i)^[^:]*(?:https?|ftp|wss?):')} AND {normalise_url(url)} IS NULL)",
         why(_NO_ADDRESS)),
        (f"{scheme} = 'file:'", why(_FILE)),
        (in_list(scheme, BLOCKED_SCHEMES), struct(
            message=lit(_SCHEME), hint=f"concat('Browser pages such as ', {scheme}, '// are off-limits.')")),
        (in_list(host_of(url), BLOCKED_HOSTS), why(_HOST)))


def describe_blocked(pages: DataFrame) -> DataFrame:
    """Pages with `blocked_reason` and `blocked_hint` (NULL for pages that can be inspected)."""
    return pages.selectExpr("*", f"{blocked('url')} AS _b").selectExpr(
        *pages.columns, "_b.message AS blocked_reason", "_b.hint AS blocked_hint")


def inspectable(pages: DataFrame) -> DataFrame:
    """Only pages that can be inspected. A predicate on `url`, so it runs before any html is parsed."""
    return pages.filter(f"{blocked('url')} IS NULL")
