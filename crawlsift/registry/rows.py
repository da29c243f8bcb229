"""Registry rows as text lines, and the DataFrames the joins use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A registry is configuration. Beyond this many rows it is joined without a broadcast hint.
BROADCAST_ROWS = 10_000


def parse_rows(text: str, fields: list[str], lists: list[str]) -> list[dict]:
    """`a | b | c,d` lines to dicts; fields named in `lists` are split at commas."""
    rows = []
    for line in text.strip().splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        values = [v.strip() for v in line.split("|")]
        row = dict(zip(fields, values + [""] * (len(fields) - len(values)), strict=True))
        rows.append({k: ([x.strip() for x in v.split(",") if x.strip()] if k in lists else v) for k, v in row.items()})
    return rows


def signal_table(spark: SparkSession, registry: list[dict], kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """(kind, key, id, name, category, ordinal, kind_rank, item, evidence): one row per thing that gives an entry away.

    `kinds` maps a list field to (signal kind, evidence template with {}).
    """
    rows = [
        (kind, value, e["id"], e["name"], e.get("category", ""), ordinal, rank, item, template.format(value))
        for ordinal, e in enumerate(registry)
        for rank, (field, (kind, template)) in enumerate(kinds.items())
        for item, value in enumerate(e.get(field) or [])
    ]
    schema = ("kind string, key string, id string, name string, category string, ordinal int, kind_rank int, "
              "item int, evidence string")
    return sized_broadcast(spark.createDataFrame(rows, schema), len(rows))


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def category_table(spark: SparkSession, categories: list[tuple[str, str]]) -> DataFrame:
    return sized_broadcast(spark.createDataFrame(
        [(c, label, i) for i, (c, label) in enumerate(categories)],
        "category string, category_label string, category_ordinal int"), len(categories))
