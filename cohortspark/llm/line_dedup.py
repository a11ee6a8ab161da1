"""Boilerplate lines by their frequency within a site.

The lines of a page are its visible text, broken where a block element begins or ends or at a line feed. Pages are
grouped by host; a line is boilerplate on a host when it stands on more than ``ratio`` of the host's pages
(and the host has at least ``min_pages`` pages). Such lines are dropped from the pages of that host.

White space inside a line is collapsed and blank lines are left out. On each page a line counts once. The boilerplate
lines of a host fit in one row: each stands on more than ``ratio`` of the host's pages, so there are fewer than (mean
distinct lines a page) / ``ratio`` of them.

Defined cases: NULL html is a page without lines, and it counts for its host; a url without a host (or NULL) belongs to no site,
and its page is kept whole; repeated rows are pages of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.session import materialize

RATIO = 0.3
MIN_PAGES = 5


HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or a leading ``www.``; NULL where there is none."""
    host = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(F.length(host) > 0, host)


#: What is not visible text, then what ends a line, then every other tag, as patterns that Java and RE2 read alike.
HIDDEN = tuple(rf"(?is)<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("head", "script", "style", "noscript", "template")) + (
    r"(?is)<!--.*?(?:-->|\z)",
)
BREAKS = (
    r"(?is)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p"
    r"|pre|section|table|tbody|td|th|tr|ul)(?:[\s/][^>]*)?>|[\r\n]+"
)
TAG = r"(?is)<[!/a-z][^>]*>"
BLANKS = r"[ \t\x0B\f\x{A0}]+"


def lines_of(html: Column) -> Column:
    """Visible, trimmed, non-empty lines in order."""
    text = F.coalesce(html, F.lit(""))
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, ""), BLANKS, " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def lines_sql(html: str) -> str:
    """The same lines in DuckDB."""
    text = f"coalesce({html}, '')"
    for pattern in HIDDEN:
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    for pattern, by in ((BREAKS, "chr(10)"), (TAG, "''"), (BLANKS, "' '")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line, n_pages, host_pages of every boilerplate line; ``pages`` has host and lines."""
    sited = pages.filter(F.col("host").isNotNull())
    totals = sited.groupBy("host").agg(F.count("*").alias("host_pages")).filter(F.col("host_pages") >= min_pages)
    seen = (
        sited.select("host", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_pages"))
        .filter("n_pages > 1")
    )
    return seen.join(totals, "host").filter(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))


def drop_site_lines(
    pages: DataFrame,
    url_column: str = "url",
    html_column: str = "html",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all), then host, n_lines, n_dropped and kept_text, which replace columns of those names."""
    added = ("host", "n_lines", "n_dropped", "kept_text")
    own = [c for c in (pages.columns if keep is None else keep) if c not in added]
    sited = pages.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("all"), host_of(pages[url_column]).alias("host"), pages[html_column].alias("html")
    )
    # The patterns are the work: lines are taken once and written next to their pages.
    sited = materialize(sited.select("all", "host", F.col("html").isNotNull().alias("given"), lines_of(F.col("html")).alias("lines")), "lines")
    bad = boilerplate(sited, ratio, min_pages).groupBy("host").agg(F.collect_set("line").alias("bad"))
    # Written first: the pages of a hot host then meet a small table where they are, or a join that AQE can split.
    bad = materialize(bad, "boilerplate")
    joined = sited.join(bad.withColumnRenamed("host", "site"), F.col("host") == F.col("site"), "left")
    joined = joined.withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))
    joined = joined.withColumn("kept", F.filter("lines", lambda x: ~F.array_contains(F.col("bad"), x)))
    return joined.select(
        *[F.col("all").getField(f"c{i}").alias(c) for i, c in enumerate(own)],
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("given"), F.array_join("kept", "\n")).alias("kept_text"),
    )
