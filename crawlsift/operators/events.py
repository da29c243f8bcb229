"""Event-queue operators: names, labels, flattening, search, frequencies, windows and sessions.

Entries are rows with the JSON text in `raw` and the parsed VARIANT in `value`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.extract.facts import explode_items
from crawlsift.extract.folds import folded
from crawlsift.extract.json_folds import LEAVES, leaves_of
from crawlsift.functions.json import number_text
from crawlsift.functions.sql import any_of, case, let, lit
from crawlsift.functions.text import contains_ci

#: Fixed value: how deep one entry may go where payloads are capped.
CLEAN_DEPTH = 12


def event_name_of(value: str) -> str:
    """Name of one entry: `event` of an object, the command of an array (or what an 'event' command names)."""
    kind = f"schema_of_variant({value})"
    text = lambda path: case(
        (f"schema_of_variant(try_variant_get({value}, '{path}')) = 'STRING'", f"try_variant_get({value}, '{path}', 'string')"))
    command, named = text("$[0]"), text("$[1]")
    return case(
        (f"startswith({kind}, 'ARRAY')", f"CASE WHEN {command} = '' THEN NULL WHEN {command} = 'event' THEN "
                                         f"coalesce({named}, {command}) ELSE {command} END"),
        (f"startswith({kind}, 'OBJECT')", f"nullif({text('$.event')}, '')"))


def describe_entry(raw: str, value: str, event: str = "event") -> str:
    """Event name; else array(n), the first three keys, or the value itself."""
    keys = lambda k: case(
        (f"size({k}) = 0", "'empty object'"),
        otherwise=f"concat(array_join(slice({k}, 1, 3), ', '), if(size({k}) > 3, {lit(', ' + chr(0x2026))}, ''))")
    return case(
        (f"coalesce({event}, '') <> ''", event),
        (f"startswith(schema_of_variant({value}), 'ARRAY')", f"concat('array(', json_array_length({raw}), ')')"),
        (f"startswith(schema_of_variant({value}), 'OBJECT')", let(f"json_object_keys({raw})", keys)),
        (f"schema_of_variant({value}) = 'STRING'", f"CAST({value} AS STRING)"),
        otherwise=number_text(f"trim({raw})"))


def annotate_entries(entries: DataFrame) -> DataFrame:
    named = entries.selectExpr("*", f"{event_name_of('value')} AS event")
    return named.selectExpr("*", f"{describe_entry('raw', 'value')} AS label")


def flatten_json(df: DataFrame, raw: str = "raw", carry: list[str] | None = None, max_depth: int | None = None,
                 clean: bool = False) -> DataFrame:
    """(carry..., ord, path, value): every leaf of a JSON text, at any depth, as `a.b[0].c` and its text.

    One scan inside the row: works on streams, shuffles nothing. Empty containers are leaves ([] and {}). With `max_depth`,
    [Depth limit] stands for what is deeper. `clean` caps what one entry may hold: depth 12, 2000 characters per text, 500 items per
    array (then `[n more]`), 200 keys per object.
    """
    carry = carry or [c for c in df.columns if c not in (raw, "value")]
    limit = (max_depth or CLEAN_DEPTH) if clean else None if max_depth is None else max_depth + 1
    return explode_items(_with_leaves(df.selectExpr(*carry, f"{raw} AS _raw"), limit, clean), "_leaves", carry, index="_at").drop("_at")


def _with_leaves(df: DataFrame, limit: int | None = None, clean: bool = False) -> DataFrame:
    """df with `_leaves` of the JSON text in `_raw`, in place of it."""
    return folded(df, "_raw", _leaves=(lambda text: list(leaves_of(text, limit, clean)), LEAVES))


def clean_json_payload(df: DataFrame, raw: str = "raw", carry: list[str] | None = None) -> DataFrame:
    """Leaves of each payload within the size caps of one entry."""
    return flatten_json(df, raw, carry, clean=True)


def filter_entries(entries: DataFrame, query: str = "", event: str = "") -> DataFrame:
    """Annotated entries with that exact event whose name, any path or any value, at any depth, contains the text.

    An entry's own leaves are searched in its row: no join, and entries of repeated captures stay apart.
    """
    out = entries.filter(f"event = {lit(event)}") if event else entries
    needle = query.strip()
    if not needle:
        return out
    plain = [c for c in out.columns if out.schema[c].dataType.typeName() != "variant"]
    leaves = _with_leaves(out.selectExpr(*plain, "raw AS _raw"))
    found = f"{contains_ci('coalesce(event, ' + repr('') + ')', needle)} OR " + any_of(
        "_leaves", lambda x: f"{contains_ci(f'{x}.path', needle)} OR {contains_ci(f'{x}.value', needle)}")
    # parsed values do not travel through the search: they are parsed again for what it left
    return leaves.filter(found).selectExpr(*[c if c in plain else f"try_parse_json(raw) AS `{c}`" for c in out.columns])


def event_counts(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., event, n) for named entries."""
    return entries.filter("event IS NOT NULL").groupBy(*(by or []), "event").agg(F.count(F.lit(1)).alias("n"))


def rank_events(counts: DataFrame, k: int | None = None) -> DataFrame:
    """Most frequent first, ties in alphabetical order as a reader expects it; with k a top-k."""
    ordered = counts.orderBy(F.desc("n"), F.expr("event COLLATE UNICODE"))
    return ordered if k is None else ordered.limit(k)


def summarize_entries(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., total, events, unnamed)."""
    counts = [F.count(F.lit(1)).alias("total"), F.count("event").alias("events"),
              F.expr("count_if(event IS NULL)").alias("unnamed")]
    return entries.groupBy(*by).agg(*counts) if by else entries.agg(*counts)


def event_windows(events: DataFrame, width: str, slide: str | None = None, ts: str = "ts", event: str = "event_type",
                  late: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, event, n); tumbling, or sliding with `slide`. Batch or stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    counts = rows.groupBy(span, F.col(event).alias("event")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event", "n")


def event_sessions(events: DataFrame, gap_minutes: int = 30, ts: str = "ts", user: str = "user_id",
                   late: str = "10 minutes") -> DataFrame:
    """(user, session_start, session_end, n): pushes of one user with no pause of `gap_minutes` or more.

    On a stream this is `session_window`. In batch, events are first counted per user and minute - one minute never
    holds a session break - so a user with a third of all events is reduced by the partial aggregate, and the window
    sorts minutes, not events. `session_end` is the last event.
    """
    if events.isStreaming:
        session = F.session_window(ts, f"{gap_minutes} minutes")
        counts = events.withWatermark(ts, late).groupBy(user, session).agg(
            F.count(F.lit(1)).alias("n"), F.max(ts).alias("session_end"))
        return counts.select(user, F.col("session_window.start").alias("session_start"), "session_end", "n")
    minutes = events.groupBy(user, F.date_trunc("minute", ts).alias("_minute")).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
    order = f"OVER (PARTITION BY {user} ORDER BY _minute)"
    breaks = minutes.selectExpr("*", f"lag(last) {order} AS before").selectExpr(
        "*", f"if(before IS NULL OR first >= before + INTERVAL {gap_minutes} MINUTES, 1, 0) AS begins").selectExpr(
        "*", f"sum(begins) {order} AS session")
    return breaks.groupBy(user, "session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("session_end"), F.sum("n").alias("n")).drop("session")


