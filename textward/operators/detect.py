"""Find without changing: every rule looks at the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import rules as R
from ..functions.expr import NO_DETECTIONS, detection, let, name, q
from ..functions.gates import Gates
from ..functions.text import first_match, hits_to_detections, rule_hits, rule_matches
from ..functions.unicode import nfc_column


def detect(df: DataFrame, col: str, out: str = "detections", *, rules=R.RULES, hidden=tuple(R.HIDDEN)) -> DataFrame:
    """Add the detections of all rules on the NFC form of a text column.

    Unlike ``sanitize`` no rule hides text from a later one, and the rules for
    zero-width and bidi characters see them.  Rules with hidden-content vectors
    report their first match, the others every match.
    """
    text, found = "__nfc", "__found"
    gates = Gates([*rules, *hidden])
    columns = df.columns
    df = nfc_column(df, col, text).withColumn(found, F.expr(gates.found_in(text)))

    def of_rule(rule, t):
        if rule in hidden:
            hit = let(first_match(t, rule), lambda m: (
                f"CASE WHEN {m} != '' THEN array("
                f"{detection(rule.category, rule.vector, rule.severity, f'left({m}, 100)', 'found')}) END"))
            cond = gates.open(found, rule)
        else:
            hit = hits_to_detections(rule_hits(t, rule), rule, "found")
            cond = f"{gates.open(found, rule)} AND {rule_matches(t, rule)}"
        return f"coalesce(CASE WHEN {cond} THEN {hit} END, {NO_DETECTIONS})"

    # one column per group of rules: binding the text keeps each of them a plain
    # interpreted expression instead of one huge generated method
    groups = [tuple(rules[i:i + 8]) for i in range(0, len(rules), 8)] + ([tuple(hidden)] if hidden else [])
    parts = [f"__part{i}" for i in range(len(groups))]
    for part, group in zip(parts, groups):
        hits = let(text, lambda t: f"concat({', '.join(of_rule(r, t) for r in group)})")
        df = df.withColumn(part, F.expr(
            f"CASE WHEN {text} IS NOT NULL AND {gates.any_open(found, group)} THEN {hits} ELSE {NO_DETECTIONS} END"))
    # a generate keeps filters on the result from being evaluated a second time below
    keep = [F.col(name(c)) for c in columns if c != out]
    return df.select(*keep, F.expr(f"inline(array(named_struct({q(out)}, concat({', '.join(parts)}))))"))
