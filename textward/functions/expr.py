"""Building blocks for the SQL expressions of this package.

The cleaning pipeline is a few hundred operators long.  Written as SQL text it
reaches the JVM in one call per stage; the same tree built operator by operator
from Python takes several seconds before the query even starts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

DETECTION = "struct<category:string,vector:string,severity:string,matched:string,action:string>"
DETECTIONS = f"array<{DETECTION}>"
NO_DETECTIONS = f"cast(array() as {DETECTIONS})"

_names = itertools.count()
_NOTHING = "cast(array() as array<int>)"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def name(*parts: str) -> str:
    """A quoted column name or path."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def fresh() -> str:
    return f"v{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body(value)`` with ``value`` computed once, however often it is used.

    An ``aggregate`` over no elements binds the value, its start, to the lambda
    variable of its last step.  A chain of dependent steps stays one expression that
    also works inside arrays and maps, and hands a large text on by reference
    (``transform`` would copy every result, and with it the text, once per step).
    """
    a, x, v = fresh(), fresh(), fresh()
    return f"aggregate({_NOTHING}, {value}, ({a}, {x}) -> {a}, {v} -> {body(v)})"


def each(array: str, body: Callable[[str], str]) -> str:
    v = fresh()
    return f"transform({array}, {v} -> {body(v)})"


def when(cond: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN {cond} THEN {then} ELSE {otherwise} END"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def detection(category: str, vector: str, severity: str, matched: str, action: str) -> str:
    """All arguments but ``matched`` are plain texts; ``matched`` is an expression."""
    return struct(category=q(category), vector=q(vector), severity=q(severity),
                  matched=f"left({matched}, 200)", action=q(action))


def contains_all(text: str, *words: str) -> str:
    return "(" + " AND ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def is_ascii(text: str) -> str:
    return f"(octet_length({text}) = length({text}))"


def replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(by)})"


def fold_case(text: str) -> str:
    """Lower case in which every letter that case-insensitively equals an ASCII
    letter has become that letter (dotted and dotless i, long s, Kelvin sign)."""
    mapped = text
    for odd, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        mapped = f"replace({mapped}, '{odd}', '{letter}')"
    return when(is_ascii(text), f"lower({text})", f"lower({mapped})")


def split_at_last(text: str, closer: str, body: Callable[[str, str], str]) -> str:
    """``body(head, tail)``, the head ending with the last ``closer``.

    A pattern that ends in ``closer`` cannot match in the tail; without it every
    opener has its closer and the search is linear.
    """
    return let(f"substring_index({text}, {q(closer)}, -1)",
               lambda tail: body(f"left({text}, length({text}) - length({tail}))", tail))


def remove_spans(text: str, pattern: str, closer: str) -> str:
    return split_at_last(text, closer, lambda head, tail: f"concat({replace(head, pattern, '')}, {tail})")
