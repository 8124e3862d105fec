"""Line dedup by site-relative frequency.

Pages are grouped by host.  A line that more than `ratio` of the host's pages
carry is boilerplate there and dropped from all of them; other hosts keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import missing_columns


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user and port; '' for NULL or anything else."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit(""))


def html_lines(html: Column) -> Column:
    """Visible text between tags, one line each, trimmed of blanks and without empty lines; NULL gives none.

    Comments, scripts and styles go with their content.
    """
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", "\n")
    return text_lines(bare)


def text_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\x20\t\r]+|[\x20\t\r]+$", ""))
    return F.filter(lines, lambda x: x != "")


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, boilerplate): digests of the lines to drop.

    A line counts once a page.  Its digest, not the line, is shuffled, after
    partial counts in each task, so a host with a third of all pages sends no
    more rows than there are tasks and distinct lines.  The array of a host is
    short whatever the number of pages: lines on more than `ratio` of N pages
    with L lines on average cannot be more than L / ratio.
    """
    seen = (pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(F.col(lines), digest))).alias("line"))
            .groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    total = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    return (seen.join(total, "host").where(F.col("n") > F.col("pages") * F.lit(ratio))
            .groupBy("host").agg(F.collect_list("line").alias("boilerplate")))


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def dedup_lines(pages: DataFrame, host: Column, lines: Column, ratio: float = 0.5, min_pages: int = 1) -> DataFrame:
    """Adds host, n_lines, n_dropped, kept_lines (in order, repeats kept) to `pages`; columns of these names are replaced.

    A line is boilerplate if it stands on more than `ratio` of the host's pages, and on at least `min_pages` of them.
    By default the ratio alone decides, so the only page of a host loses all its lines; a larger `min_pages` spares
    hosts with fewer pages.  Rows are pages: repeated rows count as often as they occur.
    Pages without a host form one group, ''.  A line split from NULL does not exist.
    """
    own = {"host": _free("__tw_host", pages.columns), "lines": _free("__tw_lines", pages.columns)}
    drop_host, drop_lines = _free("__tw_drop_host", pages.columns), _free("__tw_drop", pages.columns)
    parsed = pages.drop("host", "n_lines", "n_dropped", "kept_lines").withColumns({own["host"]: host, own["lines"]: lines})
    drop = boilerplate(parsed, own["host"], own["lines"], ratio, min_pages).withColumnsRenamed(
        {"host": drop_host, "boilerplate": drop_lines})
    kept = F.when(F.col(drop_lines).isNull(), F.col(own["lines"])).otherwise(
        F.filter(own["lines"], lambda x: ~F.array_contains(F.col(drop_lines), digest(x))))
    return (parsed.join(drop, F.col(own["host"]) == F.col(drop_host), "left")
            .withColumn("kept_lines", kept)
            .withColumns({"host": F.col(own["host"]), "n_lines": F.size(own["lines"]).cast("long"),
                          "n_dropped": (F.size(own["lines"]) - F.size("kept_lines")).cast("long")})
            .drop(*own.values(), drop_lines, drop_host))


def _free(wanted: str, taken: list[str]) -> str:
    while wanted.lower() in map(str.lower, taken):
        wanted += "_"
    return wanted


#: the registered query in DuckDB's words
PAGES_SQL = r"""
WITH parsed AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''),
      '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>', chr(10), 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[\x20\t\r]+|[\x20\t\r]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
seen AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM parsed) GROUP BY ALL),
drops AS (
  SELECT host, list(line) AS boilerplate
  FROM seen JOIN (SELECT host, count(*) AS pages FROM parsed GROUP BY host) USING (host)
  WHERE n > pages * 0.5::double GROUP BY host),
cleaned AS (
  SELECT page_id, host, lines, CASE WHEN boilerplate IS NULL THEN lines
    ELSE list_filter(lines, lambda x: NOT list_contains(boilerplate, x)) END AS kept
  FROM parsed LEFT JOIN drops USING (host))
SELECT page_id, host, len(lines)::bigint AS n_lines, (len(lines) - len(kept))::bigint AS n_dropped,
  array_to_string(kept, chr(10)) AS text
FROM cleaned
"""
