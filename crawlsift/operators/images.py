"""Alternative-text verdicts per image, filters, counts, export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlsift.functions.sql import case, in_list, let, lit, matches, struct
from crawlsift.functions.text import js_length, js_trim, normalise_alnum
from crawlsift.functions.urls import file_name_of
from crawlsift.operators.findings import say, summarize_status

# Longest useful alternative text, words that only name the medium, prefixes that add nothing.
ALT_MAX = 125
PLACEHOLDERS = (
    "image images img photo photos picture pictures graphic graphics icon banner thumbnail spacer untitled"
).split()
REDUNDANT_PREFIX = r"(?i)^(?:an?\s+)?(?:image|picture|photo|graphic|screenshot)\s+(?:of|showing)\b"
FILTERS = ["all", "issues", "error", "warning", "ok", "info"]


def classify_image(alt="alt", src="src", role="role", aria_hidden="aria_hidden", aria_label="aria_label",
                   in_link="in_link", natural_width="natural_width", natural_height="natural_height") -> str:
    """struct<status, reason>. A missing alt fails; an empty one is deliberate and marks decoration."""
    verdict = lambda status, reason: struct(status=lit(status), reason=reason)

    def judge(t: str) -> str:
        size, name = js_length(t), file_name_of(src)
        tiny = f"{natural_width} > 0 AND {natural_width} <= 2 AND {natural_height} <= 2"
        return case(
            (f"{aria_hidden} OR {role} IN ('presentation', 'none')",
             verdict("info", say("Hidden from assistive technology on purpose."))),
            (f"{alt} IS NULL AND {aria_label} <> ''",
             verdict("warning", say("No alt attribute, but aria-label is present."))),
            (f"{alt} IS NULL", verdict("error", say("No alt attribute. Screen readers will read the file name instead."))),
            (f"{t} = '' AND {in_link}",
             verdict("error", say("Empty alt inside a link, which leaves the link with no name."))),
            (f"{t} = '' AND {tiny}", verdict("info", say("Tracking pixel, correctly marked decorative."))),
            (f"{t} = ''", verdict("info", say('Decorative (alt="").'))),
            (f"{size} > {ALT_MAX}", verdict("warning", say(
                f"={size}", f" characters. Over {ALT_MAX} usually belongs in a caption."))),
            (in_list(f"lower({t})", PLACEHOLDERS), verdict("warning", say(
                '"', f"={t}", '" describes the medium, not the content.'))),
            (matches(t, REDUNDANT_PREFIX), verdict("warning", say(
                'Starts with a redundant prefix; screen readers already say "image".'))),
            (f"{name} <> '' AND {normalise_alnum(t)} = {normalise_alnum(name)}",
             verdict("warning", say("Alt text is just the file name."))),
            otherwise=verdict("ok", say(f"={size}", " characters.")))

    return let(js_trim(alt), judge)


def annotate_images(images: DataFrame) -> DataFrame:
    return images.selectExpr("*", f"{classify_image()} AS _v").select(*images.columns, "_v.*")


def filter_images(images: DataFrame, which: str = "all") -> DataFrame:
    if which == "issues":
        return images.filter("status IN ('error', 'warning')")
    return images if which in ("", "all") else images.filter(f"status = {lit(which)}")


def default_filter(images: DataFrame) -> DataFrame:
    """Per page: its problems when it has any, otherwise everything."""
    troubled = images.filter("status IN ('error', 'warning')").select("page_id").distinct()
    quiet = images.join(troubled, "page_id", "left_anti")
    return filter_images(images, "issues").unionByName(quiet)


def summarize_images(images: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    return summarize_status(images, pages)


def image_rows(images: DataFrame) -> DataFrame:
    """Export columns: src, alt, status, reason, type, in_link."""
    return images.selectExpr(
        "page_id", "index", "coalesce(nullif(src, ''), raw_src, '') AS src", "coalesce(alt, '(missing)') AS alt",
        "status", "reason", "kind AS type", "if(in_link, 'yes', 'no') AS in_link")
