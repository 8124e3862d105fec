"""JSON documents as text: take the string values out, put cleaned ones back.

Documents keep everything else as it is written: keys, numbers, NULL, the order
and repetition of fields.  Only blanks between tokens go.  No schema is needed,
and no parser's nesting limit applies.

A document is cut at its string literals, keys with their colon.  What lies
between is checked by Spark's parser with placeholders for the literals; the values are decoded
by ``from_json`` and encoded by ``to_json``, one call per document.  Only documents that
nest deeper than the limit, or may, go through Python, which cuts the deep values out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..limits import NESTING_TEXT
from .expr import each, let, name, q
from .text import nesting_depth

_BLANKS = r"[\x20\t\r\n]"
# possessive loops: the JVM runs them without recursion
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf"(?s){STRING}(?:{_BLANKS}*+:)?"
#: stands for a value that was cut out; no document has it outside strings
_CUT = "!"
_DECODE = "map('allowUnquotedControlChars', 'true', 'maxStringLen', '2000000000')"


def _cutter(max_depth: int):
    """A function from a document to one without the values nested too deep; shipped by value, so executors do not need this package."""
    import re

    token = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s"{}\[\],:]+)', re.S)

    def cut(text: str) -> str:
        """What is no JSON becomes a text that is none either; what stays is checked by the caller."""
        out, opened, skip, at, offset = [], [], None, 0, None
        end = len(text.rstrip())
        value = True
        while at < end:
            m = token.match(text, at, end)
            if not m:
                return '"'
            t, at = m.group(1), m.end()
            if offset is None:
                offset = 1 if t == "[" else 0  # a list at the root counts as if it were a field
            if t in "}]":
                if not opened or opened.pop() + t not in ("{}", "[]"):
                    return '"'
                if skip is None:
                    out.append(t)
                elif len(opened) == skip:
                    skip = None
                value = False
                continue
            starts = value and t not in ",:"  # for keys `value` is False
            if skip is None:
                deep = starts and len(opened) + offset > max_depth
                out.append("!" if deep else t)
                if deep and t in "{[":
                    skip = len(opened)
            if t in "{[":
                opened.append(t)
                value = t == "["
            else:
                value = t == ":" or t == "," and bool(opened) and opened[-1] == "["
        return '"' if opened else "".join(out)

    return cut


def with_json_parts(df: DataFrame, document: str, prefix: str, max_depth: int, flag: str | None = None) -> DataFrame:
    """Add `<prefix>tokens`, `pieces`, `cut` and `strings`: the string literals, what lies between, whether values were cut out,
    and the text of each literal that is a value (NULL for a key).

    A NULL document has NULL parts.  A document that is not JSON fails the job; with `flag`, it has NULL parts, and a
    column of this name tells.
    """
    cut = _cutter(max_depth)

    @F.arrow_udf("string")
    def cut_deep(documents: pa.Array) -> pa.Array:
        return pa.array([None if d is None else cut(d) for d in documents.to_pylist()], pa.string())

    column = lambda part: name(prefix + part)
    doc = name(document)
    # the first test counts openers, also in strings; the second leaves the strings out
    openers = rf"\A(?>[^{{\[]*+[{{\[]){{{max_depth}}}"
    bare = f"regexp_replace({doc}, {q('(?s)' + STRING)}, '')"
    deep = f"CASE WHEN {doc} rlike {q(openers)} THEN CASE WHEN {nesting_depth(bare)} >= {max_depth} THEN {doc} END END"
    df = df.withColumn(prefix + "deep", F.expr(deep))
    # used twice, which keeps the expression out of the Arrow call
    df = df.withColumn(prefix + "shallow", F.when(F.col(prefix + "deep").isNotNull(), cut_deep(F.col(prefix + "deep"))))
    df = _step(df, **{prefix + "cut": f"{column('shallow')} IS NOT NULL", prefix + "doc": f"coalesce({column('shallow')}, {doc})"})
    df = _step(df, **{prefix + "tokens": f"regexp_extract_all({column('doc')}, {q(_TOKEN)}, 0)", prefix + "pieces": f"split({column('doc')}, {q(_TOKEN)}, -1)"})
    tokens, pieces = column("tokens"), column("pieces")
    values = each(tokens, lambda t: f"CASE WHEN endswith({t}, ':') THEN 'null' ELSE {t} END")
    skeleton = (f"concat(array_join(transform({tokens}, (t, i) -> concat(get({pieces}, i), CASE WHEN endswith(t, ':') "
                f"THEN concat('\"', i, '\":') ELSE '\"\"' END)), ''), element_at({pieces}, -1))")
    skeleton = let(skeleton, lambda x: f"CASE WHEN {column('cut')} THEN replace({x}, {q(_CUT)}, 'null') ELSE {x} END")
    df = _step(df, **{prefix + "skeleton": skeleton, prefix + "decoded": f"from_json(concat('[', array_join({values}, ','), ']'), 'array<string>', {_DECODE})"})
    decoded = (f"(size({column('decoded')}) = size({tokens}) AND forall(zip_with({tokens}, {column('decoded')}, "
               f"(t, s) -> endswith(t, ':') OR s IS NOT NULL), ok -> ok))")
    # the parser does not look beyond the first value: one that must follow it shows that nothing else does
    parsed = f"try_parse_json(concat('[', {column('skeleton')}, ',\"end\"]'))"
    ok = f"({doc} IS NULL OR coalesce(try_variant_get({parsed}, '$[1]', 'string') = 'end' AND {decoded}, false))"
    otherwise = "NULL" if flag is not None else f"raise_error(concat('not a JSON document: ', left({doc}, 40)))"
    strings = let(ok, lambda fine: f"named_struct('strings', CASE WHEN {fine} THEN {column('decoded')} ELSE {otherwise} END, 'bad', NOT {fine})")
    df = _step(df, **{prefix + "found": strings})
    df = df.withColumn(prefix + "strings", F.col(f"{column('found')}.strings"))
    if flag is not None:
        df = df.withColumn(flag, F.col(f"{column('found')}.bad"))
    return df.drop(*[prefix + c for c in ("deep", "shallow", "doc", "skeleton", "decoded", "found")])


def _step(df: DataFrame, **exprs: str) -> DataFrame:
    """Add columns by a generate of one row: what follows reads them, instead of having the expressions written out in it.

    Without it, Spark would also merge the Arrow call here with that of the cleaning that follows.
    """
    fields = ", ".join(f"{q(k)}, {e}" for k, e in exprs.items())
    return df.select(*[F.col(name(c)) for c in df.columns], F.expr(f"inline(array(named_struct({fields})))"))


def json_rebuilt(prefix: str, strings: str) -> str:
    """The documents with their string values replaced, and a fixed text for every value that was cut out; NULL where there are no strings."""
    column = lambda part: name(prefix + part)
    literals = f"regexp_extract_all(to_json({name(strings)}), {q('(?s)' + STRING + '|null')}, 0)"

    def tight(piece: str) -> str:
        bare = f"regexp_replace({piece}, {q(_BLANKS + '+')}, '')"
        return f"CASE WHEN {column('cut')} THEN replace({bare}, {q(_CUT)}, {q(chr(34) + NESTING_TEXT + chr(34))}) ELSE {bare} END"

    body = (f"array_join(transform({column('tokens')}, (t, i) -> concat({tight(f'get({column("pieces")}, i)')}, "
            f"CASE WHEN endswith(t, ':') THEN regexp_replace(t, {q(_BLANKS + '+:$')}, ':') ELSE get(l, i) END)), '')")
    whole = f"concat({body}, {tight(f'element_at({column("pieces")}, -1)')})"
    return f"CASE WHEN {name(strings)} IS NOT NULL THEN get(transform(array({literals}), l -> {whole}), 0) END"
