"""The path guard as a table operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import name, q
from ..functions.paths import normalise_path, path_verdict


def check_paths(df: DataFrame, col: str, root: str) -> DataFrame:
    """Add ``resolved``, ``reason`` (NULL if allowed) and ``allowed`` to a table of destinations."""
    home = root.rstrip("/") or "/"
    out = df.withColumn("resolved", F.expr(normalise_path(name(col), q(home))))
    return (out.withColumn("reason", F.expr(path_verdict("resolved", q(home))))
            .withColumn("allowed", F.col("reason").isNull()))
