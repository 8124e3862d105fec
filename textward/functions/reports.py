"""Column functions over the report struct."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def threats_found(report: str = "report") -> Column:
    return F.size(F.col(f"{report}.detections")) > 0


def threat_count(report: str = "report") -> Column:
    return F.size(F.col(f"{report}.detections"))


def summary(report: str = "report") -> Column:
    """One line per detection below a head line, or a fixed sentence."""
    found = F.col(f"{report}.detections")
    lines = F.transform(found, lambda d: F.concat(
        F.lit("  ["), F.upper(d["severity"]), F.lit("] "), d["category"], F.lit("/"), d["vector"],
        F.lit(" → "), d["action"]))
    head = F.concat(F.lit("⚠ "), F.size(found).cast("string"), F.lit(" threat(s) detected:"))
    return F.when(F.size(found) == 0, F.lit("No threats detected.")).otherwise(
        F.concat_ws("\n", head, F.array_join(lines, "\n")))


def without_evidence(report: str = "report") -> Column:
    """The detections in audit form: no matched text."""
    return F.transform(F.col(f"{report}.detections"), lambda d: F.struct(
        d["category"].alias("category"), d["vector"].alias("vector"),
        d["severity"].alias("severity"), d["action"].alias("action")))


def flat_report(report: str = "report") -> Column:
    """The report as handed to callers in other languages."""
    return F.struct(
        threats_found(report).alias("threats_found"), threat_count(report).alias("threat_count"),
        F.col(f"{report}.original_length").alias("original_length"),
        F.col(f"{report}.cleaned_length").alias("cleaned_length"),
        without_evidence(report).alias("detections"))


def severity_rank(severity: Column) -> Column:
    return (F.when(severity == "critical", 0).when(severity == "high", 1)
            .when(severity == "medium", 2).otherwise(3))
