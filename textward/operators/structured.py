"""Nested records: typed columns, JSON text, and dotted field access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.expr import name, q
from ..functions.jsontext import json_rebuilt, with_json_parts
from ..limits import DEFAULT_LIMITS, Limits
from .sanitize import sanitize


def sanitize_record(df: DataFrame, col: str, context: str = "general", **kw) -> DataFrame:
    """Clean every text value of a struct or map column; keys and numbers stay."""
    if not isinstance(df.schema[col].dataType, (T.StructType, T.MapType)):
        raise TypeError(f"sanitize_record expects a struct or map column, got {df.schema[col].dataType.simpleString()}")
    return sanitize(df, col, context, **kw)


def sanitize_text(df: DataFrame, col: str, context: str = "general", **kw) -> DataFrame:
    """Clean a text column; anything but text is refused before the job starts."""
    if not isinstance(df.schema[col].dataType, T.StringType):
        raise TypeError(f"sanitize_text expects a string column, got {df.schema[col].dataType.simpleString()}")
    return sanitize(df, col, context, **kw)


def sanitize_json(df: DataFrame, col: str, context: str = "general", *, cleaned: str = "cleaned",
                  limits: Limits = DEFAULT_LIMITS, bad_rows: str | None = None, **kw) -> DataFrame:
    """Clean every string value of JSON documents held as text, of any shape.

    No schema is asked for, so no field is lost and no string passes unseen:
    fields of mixed type, NULL, unknown and oddly named ones stay.  A value
    nested deeper than the limit becomes a fixed text; a list at the root counts
    as one level, as if it were a field.  Anything but JSON fails the job, unless
    ``bad_rows`` names a column that is to tell which rows hold none: their cleaned document is NULL.
    """
    prefix = "__json_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    parsed = with_json_parts(df, col, prefix, limits.max_depth, bad_rows)
    out = sanitize(parsed, prefix + "strings", context, cleaned=prefix + "clean", limits=limits, **kw)
    out = out.withColumn(cleaned, F.expr(json_rebuilt(prefix, prefix + "clean")))
    return out.drop(*[c for c in out.columns if c.startswith(prefix)])


def extract_field(json: str, path: str) -> Column:
    """The text at a dotted path of a JSON column, or '' for anything else.

    Missing fields, other types and broken JSON give the empty string; a key
    that contains a dot cannot be reached.
    """
    steps = "$" + "".join(f"['{p}']" for p in path.split("."))
    value = f"try_variant_get(try_parse_json({name(json)}), {q(steps)}, 'variant')"
    return F.expr(f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN cast({value} as string) ELSE '' END")
