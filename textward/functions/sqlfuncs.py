"""SQL functions, for callers who only speak SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as X
from .paths import normalise_path, path_verdict
from .unicode import homoglyph_ratio
from ..rules import RULES
from .expr import let, q
from .gates import Gates
from .text import rule_matches


def sql_functions() -> dict[str, str]:
    """Name to definition: ``(parameters) RETURNS type RETURN expression``."""
    one = "(t STRING) RETURNS {} RETURN {}"
    gates = Gates(RULES)

    def vectors(found):
        cases = ", ".join(f"CASE WHEN {gates.open(found, r)} AND {rule_matches('t', r)} THEN {q(r.vector)} END" for r in RULES)
        return f"array_compact(array({cases}))"

    return {
        "strip_html_comments": one.format("STRING", X.strip_comments("t")),
        "strip_html_tags": one.format("STRING", X.strip_tags("t")),
        "escape_html": one.format("STRING", X.escape_html("t")),
        "nesting_depth": one.format("INT", X.nesting_depth("t")),
        "homoglyph_ratio": one.format("DOUBLE", homoglyph_ratio("t")),
        "threat_vectors": one.format("ARRAY<STRING>", f"CASE WHEN t IS NULL THEN array() ELSE {let(gates.found_in('t'), vectors)} END"),
        "entry_hash": one.format("STRING", "substring(sha2(trim(t), 256), 1, 16)"),
        "normalise_path": one.format("STRING", normalise_path("t")),
        "path_verdict": f"(p STRING, root STRING) RETURNS STRING RETURN {path_verdict('p', 'root')}",
    }


def register(spark: SparkSession, prefix: str = "tw_") -> list[str]:
    """Create the functions in the session, as ``tw_strip_html_tags`` and so on."""
    for short, definition in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{short}{definition}")
    return [prefix + s for s in sql_functions()]
