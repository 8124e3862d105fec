"""Lists of texts: clean each item, join or collect them per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import DETECTIONS
from .numbering import number_rows
from .sanitize import sanitize


def _groups(df, keys, order, col, context, items_per_part, **kw):
    clean = sanitize(df, col, context, cleaned="__text", report="__report", **kw)
    by = list(keys)
    if items_per_part is not None:
        clean = number_rows(clean, keys, [order], "__pos").withColumn("part", F.floor((F.col("__pos") - 1) / items_per_part))
        by.append("part")
    item = F.struct(F.col(order).alias("o"), F.col("__text").alias("t"), F.col("__report.detections").alias("d"))
    return by, clean.groupBy(*by).agg(
        F.array_sort(F.collect_list(item)).alias("__items"),
        F.sum("__report.original_length").alias("original_length"))


def _report(original, cleaned, items):
    found = F.flatten(F.transform(items, lambda i: i["d"])).cast(DETECTIONS)
    return F.struct(original.cast("long").alias("original_length"), cleaned.cast("long").alias("cleaned_length"),
                    found.alias("detections"))


def sanitize_lines(df: DataFrame, keys: list[str], order: str, col: str, *, separator: str = "\n\n",
                   context: str = "general", items_per_part: int | None = None, **kw) -> DataFrame:
    """Clean the items of each group and join them in order: one text per group, NULL keys included.

    A group whose joined text is too long for one row can be had in parts: with
    ``items_per_part``, so many items by position make a row, and the texts put
    one after the other in the order of ``part`` are the joined text.  The
    cleaned length counts the separators.
    """
    by, groups = _groups(df, keys, order, col, context, items_per_part, **kw)
    items = F.col("__items")
    text = F.array_join(F.transform(items, lambda i: i["t"]), separator)
    if items_per_part is not None:
        text = F.when(F.col("part") == 0, text).otherwise(F.concat(F.lit(separator), text))
    groups = groups.withColumn("cleaned", text)
    return groups.select(*by, "cleaned", _report(F.col("original_length"), F.length("cleaned"), items).alias("report"))


def sanitize_items(df: DataFrame, keys: list[str], order: str, col: str, *, context: str = "general",
                   items_per_part: int | None = None, **kw) -> DataFrame:
    """Clean the items of each group and return them as arrays (see ``sanitize_lines``).

    Here the cleaned length does not count separators.
    """
    by, groups = _groups(df, keys, order, col, context, items_per_part, **kw)
    items = F.col("__items")
    length = F.aggregate(items, F.lit(0), lambda acc, i: acc + F.coalesce(F.length(i["t"]), F.lit(0)))
    return groups.select(*by, F.transform(items, lambda i: i["t"]).alias("cleaned"),
                         _report(F.col("original_length"), length, items).alias("report"))


def sanitize_array(df: DataFrame, col: str, context: str = "general", **kw) -> DataFrame:
    """Clean a column that already is an array of texts; no shuffle."""
    return sanitize(df, col, context, **kw)
