"""Clean a column of a table: text, or any nesting of structs, arrays and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .. import rules as R
from ..functions import text as X
from ..functions.expr import DETECTIONS, NO_DETECTIONS, each, let, name, q, struct
from ..functions.trees import cap_depth, flat_texts, has_leaf, is_text, rebuilt
from ..functions.unicode import needs_normalising, normalise_states
from ..limits import DEFAULT_LIMITS, Limits

def sanitize(df: DataFrame, col: str, context: str = "general", *, context_col: str | None = None,
             cleaned: str = "cleaned", report: str = "report", limits: Limits = DEFAULT_LIMITS,
             rules=R.RULES, root_depth: int = 0) -> DataFrame:
    """Add a cleaned copy of ``col`` and a report to every row.

    ``report`` is ``struct<original_length, cleaned_length, detections>``; for a
    nested column the lengths are sums over its texts and the detections stand
    in visiting order.  NULL stays NULL with an empty report.

    The texts of a nested column are gathered in one array, cleaned by one
    ``transform`` over it and put back by their place, so the plan holds the
    pipeline once however many fields there are.

    Rows never move between tasks.  The plan is the scan, projections around an
    Arrow step for text that needs normalising, and one generate that yields the
    result: a filter on other columns is pushed below all of them, while a
    filter on the result is not, so the pipeline is never evaluated twice.

    ``context`` (or, per row, ``context_col``) decides on HTML escaping only:
    "diary", "html" and "rendering" are escaped.
    """
    source, dtype = name(col), df.schema[col].dataType
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        source, dtype = cap_depth(source, dtype, limits.max_depth, root_depth)
    else:
        source, dtype = f"cast({source} as string)", T.StringType()
    if not has_leaf(dtype):
        empty = struct(original_length="0", cleaned_length="0", detections=NO_DETECTIONS)
        return df.withColumn(cleaned, F.expr(source)).withColumn(report, F.expr(empty))

    nested = not is_text(dtype)
    state = _free("__state", df.columns)
    norm = _free("__norm", df.columns)
    texts = flat_texts(source, dtype) if nested else source
    apply = (lambda x, stage: each(x, stage)) if nested else (lambda x, stage: stage(x))
    staged = df
    for stage in X.early_stages(limits):
        staged = staged.withColumn(state, F.expr(apply(texts, stage)))
    staged = _normalise(staged, state, norm, limits)

    shown = q(context) if context_col is None else name(context_col)
    for stage in X.late_stages(shown, limits, rules):
        staged = staged.withColumn(state, F.expr(apply(name(state), stage)))

    result = _nested_result(source, dtype, name(state), cleaned, report) if nested else _result(name(state), cleaned, report)
    keep = [F.col(name(c)) for c in df.columns if c not in (cleaned, report)]
    return staged.select(*keep, F.expr(f"inline(array({result}))"))


def limit_text(df: DataFrame, col: str, out: str = "limited", found: str = "found",
               limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Only the resource limits: size, length, repeated characters, nesting."""
    state = _free("__state", df.columns)
    for stage in X.early_stages(limits):
        df = df.withColumn(state, F.expr(stage(f"cast({name(col)} as string)")))
    return df.withColumn(out, F.col(f"{state}.t")).withColumn(found, F.col(f"{state}.d")).drop(state)


def _normalise(df: DataFrame, state: str, norm: str, limits: Limits) -> DataFrame:
    """Send the rows through Arrow in which some text needs normalising."""
    kind, s = df.schema[state].dataType, name(state)
    needed = needs_normalising(f"{s}.t", limits.homoglyph_ratio)
    if isinstance(kind, T.ArrayType):
        needed = f"exists({s}, s -> coalesce({needs_normalising('s.t', limits.homoglyph_ratio)}, false))"
    df = df.withColumn(norm, F.expr(f"CASE WHEN {needed} THEN {s} END"))
    # norm is used twice, which keeps its expression out of the Arrow call
    return (df.withColumn(norm, F.when(F.col(norm).isNotNull(), normalise_states(kind)(F.col(norm))))
            .withColumn(state, F.coalesce(F.col(norm), F.col(state))))


def _result(state: str, cleaned: str, report: str) -> str:
    return let(state, lambda s: _pair(f"{s}.t", f"{s}.n", f"{s}.c", f"{s}.d", cleaned, report))


def _nested_result(source: str, dtype: T.DataType, states: str, cleaned: str, report: str) -> str:
    def combine(x):
        def summed(field):
            return f"aggregate({x}, 0, (acc, s) -> acc + coalesce(s.{field}, 0))"

        found = f"flatten(filter({each(x, lambda s: f'{s}.d')}, d -> d IS NOT NULL))"
        return _pair(rebuilt(source, dtype, lambda place: f"get({x}, {place}).t"), summed("n"), summed("c"), found, cleaned, report)

    return let(states, combine)


def _pair(text, original, final, found, cleaned, report) -> str:
    rep = struct(original_length=original, cleaned_length=final, detections=f"coalesce({found}, {NO_DETECTIONS})")
    return f"named_struct({q(cleaned)}, {text}, {q(report)}, {rep})"


def _free(wanted: str, taken) -> str:
    while wanted in taken:
        wanted += "_"
    return wanted


def sanitize_for_diary(df: DataFrame, col: str, **kw) -> DataFrame:
    return sanitize(df, col, "diary", **kw)


def sanitize_for_markdown(df: DataFrame, col: str, **kw) -> DataFrame:
    return sanitize(df, col, "markdown", **kw)
