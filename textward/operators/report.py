"""Analytics over reports: detections table, score card, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.reports import severity_rank, threats_found


def detections_table(df: DataFrame, *keys: str, report: str = "report") -> DataFrame:
    """One row per detection with its position, next to the given key columns."""
    return (df.select(*keys, F.posexplode(F.col(f"{report}.detections")).alias("pos", "det"))
            .select(*keys, "pos", "det.*"))


def scorecard(df: DataFrame, report: str = "report") -> DataFrame:
    """How many rows were blocked and how many passed unnoticed."""
    hit = threats_found(report)
    return df.agg(F.count_if(hit).alias("blocked"), F.count_if(~hit).alias("missed"), F.count("*").alias("total"))


def case_results(df: DataFrame, *keys: str, report: str = "report") -> DataFrame:
    return df.select(*keys, F.when(threats_found(report), "BLOCKED").otherwise("MISSED").alias("result"),
                     F.size(F.col(f"{report}.detections")).alias("n_detections"))


def count_detections(table: DataFrame, *by: str) -> DataFrame:
    """Detections per group; counts are combined before the shuffle."""
    return table.groupBy(*by).agg(F.count("*").alias("n"))


def count_by_row(df: DataFrame, detections: str, *by: str, rows: str = "n_rows") -> DataFrame:
    """Detections and rows with any, per group of the detection's fields.

    Equal detections of a row are counted in the row, so only sums are shuffled.
    """
    short = F.transform(detections, lambda d: F.struct(*[d[f].alias(f) for f in by]))
    kinds = F.transform(F.array_distinct("__all"), lambda k: F.struct(k.alias("k"), F.size(F.filter("__all", lambda d: d == k)).alias("n")))
    each = df.select(short.alias("__all")).select(F.explode(kinds).alias("x"))
    return each.groupBy(*[F.col(f"x.k.{f}").alias(f) for f in by]).agg(F.sum("x.n").alias("n"), F.count("*").alias(rows))


def rollup_detections(table: DataFrame) -> DataFrame:
    """Counts per vector, per category and in total."""
    return (table.rollup("category", "vector")
            .agg(F.count("*").alias("n"), F.min(severity_rank(F.col("severity"))).alias("worst")))


def top_detections(table: DataFrame, k: int, *by: str) -> DataFrame:
    """The k most frequent groups (a report with a limit by definition)."""
    return count_detections(table, *by).orderBy(F.desc("n"), *by).limit(k)


def combined_report(df: DataFrame, *keys: str, report: str = "report") -> DataFrame:
    """Lengths and threat counts per group; nothing but numbers is shuffled."""
    r = F.col(report)
    return df.groupBy(*keys).agg(
        F.sum(r["original_length"]).alias("original_length"), F.sum(r["cleaned_length"]).alias("cleaned_length"),
        F.sum(F.size(r["detections"])).alias("threat_count"),
        F.max(threats_found(report)).alias("threats_found"))
