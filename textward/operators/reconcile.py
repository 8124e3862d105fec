"""Reconciliation checks over tables of session records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..limits import DEFAULT_LIMITS


def date_agreement(a: DataFrame, b: DataFrame, c: DataFrame, key: str, *, names=("changelog", "handoff", "sprint")) -> DataFrame:
    """Join three tables (key, date); a session passes if all three dates are there and equal."""
    first, second, third = (t.select(key, F.col("date").alias(f"{n}_date")) for t, n in zip((a, b, c), names))
    x, y, z = (F.col(f"{n}_date") for n in names)
    return (first.join(second, key, "full").join(third, key, "full")
            .withColumn("passed", F.coalesce((x == y) & (y == z), F.lit(False))))


def list_budget(df: DataFrame, col: str, budget: int = DEFAULT_LIMITS.summary_items, preview: int = 80) -> DataFrame:
    """Count the items of a list against a budget; previews only where it is exceeded."""
    items = F.col(col)
    count = F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(0))
    short = F.transform(items, lambda i: F.when(F.length(i) > preview, F.concat(F.left(i, F.lit(preview)), F.lit("..."))).otherwise(i))
    return (df.withColumn("item_count", count).withColumn("passed", count <= budget)
            .withColumn("previews", F.when(count > budget, short)))


def missing_claims(claims: DataFrame, key: str, files: str, observed: DataFrame, path: str = "path") -> DataFrame:
    """Files a session claims to have made that were not observed."""
    return (claims.select(key, F.explode(files).alias(path)).dropDuplicates([key, path])
            .join(observed.select(path).dropDuplicates([path]), path, "left_anti").select(key, path))


def paired_coverage(changes: DataFrame, key: str, path: str, *, prefix: str = "Projects/", paired: str = "tasks/lessons/") -> DataFrame:
    """Sessions that changed project files must have changed lesson files too."""
    counts = changes.groupBy(key).agg(
        F.count_if(F.startswith(F.col(path), F.lit(prefix))).alias("project_files"),
        F.count_if(F.startswith(F.col(path), F.lit(paired))).alias("lesson_files"))
    return counts.withColumn("status", F.when(F.col("project_files") == 0, "not applicable")
                             .when(F.col("lesson_files") == 0, "failed").otherwise("passed"))


def line_budget(df: DataFrame, col: str, budget: int = DEFAULT_LIMITS.sprint_lines) -> DataFrame:
    """A text must have fewer lines than the budget."""
    lines = F.size(F.split(F.col(col), "\n", -1))
    return df.withColumn("line_count", lines).withColumn("passed", lines < budget)


def check_totals(checks: DataFrame, *by: str) -> DataFrame:
    """Passed, failed and total checks."""
    return checks.groupBy(*by).agg(F.count_if("passed").alias("n_passed"),
                                   F.count_if(~F.col("passed")).alias("n_failed"), F.count("*").alias("n_checks"))


def untracked_pipelines(pipelines: DataFrame, tracker: DataFrame, key: str = "pipeline") -> DataFrame:
    """Pipelines without a row in the compliance tracker."""
    return pipelines.join(tracker.select(key).dropDuplicates([key]), key, "left_anti")
