"""Walk a nested column type and apply an expression to every text leaf."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import types as T

from ..limits import NESTING_TEXT
from .expr import each, fresh, let, name, q


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def has_leaf(t: T.DataType, is_leaf=is_text) -> bool:
    if is_leaf(t):
        return True
    if isinstance(t, T.StructType):
        return any(has_leaf(f.dataType, is_leaf) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return has_leaf(t.elementType, is_leaf)
    return isinstance(t, T.MapType) and has_leaf(t.valueType, is_leaf)


def _struct(col: str, fields) -> str:
    inner = ", ".join(f"{q(f)}, {e}" for f, e in fields)
    return f"CASE WHEN {col} IS NOT NULL THEN named_struct({inner}) END"


def width(t: T.DataType) -> int | None:
    """Texts in a value of this type; None if that depends on the value."""
    if is_text(t):
        return 1
    if not has_leaf(t):
        return 0
    if isinstance(t, T.StructType):
        inner = [width(f.dataType) for f in t.fields]
        return None if None in inner else sum(inner)
    return None


def _items(c: str, t: T.DataType) -> tuple[str, T.DataType]:
    """The elements of an array or the values of a map, and their type."""
    return (f"map_values({c})", t.valueType) if isinstance(t, T.MapType) else (c, t.elementType)


def flat_texts(col: str, dtype: T.DataType) -> str:
    """All texts of a value as one array, in visiting order.

    A struct has a place for each of its texts even if it is NULL itself; an
    array or map has as many places as it has elements.
    """
    def walk(c, t) -> list[str]:
        """Arrays to be put together."""
        if is_text(t):
            return [f"array({c})"]
        if isinstance(t, T.StructType):
            parts = [p for f in t.fields if has_leaf(f.dataType) for p in walk(f"{c}.{name(f.name)}", f.dataType)]
            joined: list[str] = []
            for p in parts:  # neighbouring single texts become one array
                if joined and p.startswith("array(") and joined[-1].startswith("array("):
                    joined[-1] = f"{joined[-1][:-1]}, {p[6:]}"
                else:
                    joined.append(p)
            return joined
        items, inner = _items(c, t)
        if not is_text(inner):
            items = f"flatten({each(items, lambda e: concat(walk(e, inner)))})"
        return [f"coalesce({items}, {_NONE})"]

    def concat(parts):
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"

    return concat(walk(col, dtype)) if has_leaf(dtype) else _NONE


_NONE = "cast(array() as array<string>)"


def _count(c: str, t: T.DataType) -> str:
    """Places that a value takes in `flat_texts`."""
    known = width(t)
    if known is not None:
        return str(known)
    if isinstance(t, T.StructType):
        return "(" + " + ".join(_count(f"{c}.{name(f.name)}", f.dataType) for f in t.fields if has_leaf(f.dataType)) + ")"
    items, inner = _items(c, t)
    each_one = width(inner)
    if each_one is not None:
        return f"(CASE WHEN {c} IS NULL THEN 0 ELSE size({items}) * {each_one} END)"
    return f"(CASE WHEN {c} IS NULL THEN 0 ELSE aggregate({each(items, lambda e: _count(e, inner))}, 0, (acc, k) -> acc + k) END)"


def rebuilt(col: str, dtype: T.DataType, text_at: Callable[[str], str]) -> str:
    """The same nesting with ``text_at(place)`` for each text; keys and everything else stay as they are."""
    def walk(c, t, base):
        if is_text(t):
            return text_at(base)
        if not has_leaf(t):
            return c
        if isinstance(t, T.StructType):
            fields, steps, known = [], [base] if base != "0" else [], 0
            for f in t.fields:
                at = " + ".join([*steps, str(known)]) if known or not steps else " + ".join(steps)
                inner = f"{c}.{name(f.name)}"
                fields.append((f.name, walk(inner, f.dataType, at)))
                if width(f.dataType) is None:
                    steps.append(_count(inner, f.dataType))
                else:
                    known += width(f.dataType)
            return _struct(c, fields)
        items, inner = _items(c, t)
        e, i = fresh(), fresh()
        wide = width(inner)
        if wide is not None:
            out = f"transform({items}, ({e}, {i}) -> {walk(e, inner, f'{base} + {i} * {wide}')})"
        else:
            acc = fresh()
            starts = f"aggregate({items}, array({base}), ({acc}, {e}) -> array_append({acc}, element_at({acc}, -1) + {_count(e, inner)}))"
            out = let(starts, lambda at: f"transform({items}, ({e}, {i}) -> {walk(e, inner, f'get({at}, {i})')})")
        if isinstance(t, T.MapType):
            out = f"map_from_arrays(map_keys({c}), {out})"
        return f"CASE WHEN {c} IS NOT NULL THEN {out} END"

    return walk(col, dtype, "0")


def cap_depth(col: str, dtype: T.DataType, max_depth: int, depth: int = 0) -> tuple[str, T.DataType]:
    """Replace everything nested deeper than ``max_depth`` by a fixed text.

    The type decides at planning time where the cut is, so such a field becomes
    a text field.  NULL stays NULL.
    """
    def cut(t, d):
        if d > max_depth:
            return T.StringType()
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, cut(f.dataType, d + 1)) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(cut(t.elementType, d + 1))
        if isinstance(t, T.MapType):
            return T.MapType(t.keyType, cut(t.valueType, d + 1))
        return t

    def deep(t, d):
        if d > max_depth:
            return True
        inner = ([f.dataType for f in t.fields] if isinstance(t, T.StructType) else
                 [t.elementType] if isinstance(t, T.ArrayType) else [t.valueType] if isinstance(t, T.MapType) else [])
        return any(deep(x, d + 1) for x in inner)

    def walk(c, t, d):
        if d > max_depth:
            return f"CASE WHEN {c} IS NOT NULL THEN {q(NESTING_TEXT)} END"
        if not deep(t, d):
            return c
        if isinstance(t, T.StructType):
            return _struct(c, [(f.name, walk(f"{c}.{name(f.name)}", f.dataType, d + 1)) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return each(c, lambda e: walk(e, t.elementType, d + 1))
        k, v = fresh(), fresh()
        return f"transform_values({c}, ({k}, {v}) -> {walk(v, t.valueType, d + 1)})"

    return walk(col, dtype, depth), cut(dtype, depth)
