"""Unicode normalisation, the one step Spark has no built-in function for.

Text that cannot change under NFC is recognised by a regular expression and
never leaves the JVM; the rest goes through one Arrow function.  (Arrow's own
NFC kernel leaves text decomposed, so NFC is taken from the standard library.)
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .expr import is_ascii, let, name, q, replace, when

# Ranges whose characters are never changed by NFC and never combine with the
# character before them: Latin, Cyrillic, Hebrew letters, general punctuation,
# currency signs, CJK and Hangul syllables.  (Checked against unicodedata in
# the tests.)  Anything else may need normalising.
STABLE = (r"\x{0}-\x{2ff}\x{400}-\x{482}\x{48a}-\x{52f}\x{5d0}-\x{5ea}\x{2002}-\x{2064}\x{2066}-\x{206f}\x{20a0}-\x{20bf}"
          r"\x{3000}-\x{3029}\x{3041}-\x{3096}\x{30a0}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}"
          r"\x{feff}-\x{ffef}")
# one range first: a much cheaper test for most characters
_UNSTABLE = rf"(?=[^\x{{0}}-\x{{2ff}}])[^{STABLE}]"


def homoglyph_ratio(text: str) -> str:
    """Share of letters that lie outside ASCII; 0 where there are no letters."""
    odd = f"length({replace(text, r'[\x00-\x7F\P{L}]+', '')})"
    return f"({odd} / greatest({odd} + length({replace(text, '[^A-Za-z]+', '')}), 1))"


def ratio_if_above(text: str, threshold: float) -> str:
    """The share where it is above the threshold; 0 where it provably is not, and for a test against the threshold only.

    Every non-ASCII character takes at least one byte more than it has
    characters, which bounds the count before any letter is looked at.
    """
    if not 0 <= threshold < 1:
        raise ValueError("threshold must be in [0, 1)")

    def with_ascii(plain):
        surplus = f"(octet_length({text}) - length({text}))"
        odd = f"length({replace(text, r'[\x00-\x7f\P{L}]+', '')})"
        ratio = let(odd, lambda o: f"{o} / greatest({o} + {plain}, 1)")
        # 0.999: leave no room for a rounding error in the bound
        return when(f"{surplus} * {1 - threshold}D < {plain} * {threshold * 0.999}D", "0D", ratio)

    # three frequent letters already settle it for most texts in Latin script
    some = " - ".join([f"3 * length({text})"] + [f"length(replace({text}, '{c}', ''))" for c in "ein"])
    few = f"(octet_length({text}) - length({text})) * {1 - threshold}D < ({some}) * {threshold * 0.999}D"
    exact = let(f"length({replace(text, '[^A-Za-z]+', '')})", with_ascii)
    return f"CASE WHEN {is_ascii(text)} OR {few} THEN 0D ELSE {exact} END"


def may_change(text: str) -> str:
    """Whether NFC might change the text."""
    beyond_latin = r"[^\x{0}-\x{2ff}]"     # one range: a much cheaper test
    return f"(NOT {is_ascii(text)} AND {text} rlike {q(beyond_latin)} AND {text} rlike {q(_UNSTABLE)})"


def needs_normalising(text: str, threshold: float) -> str:
    return f"({may_change(text)} OR {ratio_if_above(text, threshold)} > {threshold}D)"


def normalise_states(dtype: T.DataType):
    """Arrow function over a column of (nested) leaf states of the given type:
    the text becomes NFC and the field beside it its ASCII form.

    Everything it calls is defined inside it, so it is shipped by value and the
    executors do not need this package.
    """
    def in_slices(change, arr, n=64):
        """Few texts at a time, so that what a step makes of them on its way does not grow with the batch."""
        parts = [change(arr.slice(i, n)) for i in range(0, len(arr), n)]
        return pa.concat_arrays(parts) if parts else arr

    def nfc(arr):
        return in_slices(lambda a: pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in a.to_pylist()], a.type), arr)

    def ascii_form(arr):
        return in_slices(lambda a: pc.replace_substring_regex(pc.utf8_normalize(a, form="NFKD"), r"[^\x00-\x7F]", ""), arr)

    def tree(arr):
        kind = arr.type
        mask = arr.is_null() if arr.null_count else None
        if pa.types.is_struct(kind):
            names = [f.name for f in kind]
            parts = dict(zip(names, arr.flatten()))
            if names[:2] == ["t", "a"]:
                parts["t"] = nfc(parts["t"])
                parts["a"] = ascii_form(parts["t"])
            else:
                parts = {n: tree(p) for n, p in parts.items()}
            return pa.StructArray.from_arrays(list(parts.values()), fields=list(kind), mask=mask)
        if pa.types.is_map(kind):
            return pa.MapArray.from_arrays(arr.offsets, arr.keys, tree(arr.items), type=kind, mask=mask)
        if pa.types.is_list(kind):
            return pa.ListArray.from_arrays(arr.offsets, tree(arr.values), type=kind, mask=mask)
        return arr

    @F.arrow_udf(dtype)
    def normalise(states: pa.Array) -> pa.Array:
        return tree(states)

    return normalise


def nfc_column(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add the NFC form of a text column; unaffected rows do not reach Python."""
    @F.arrow_udf(T.StringType())
    def nfc(text: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], text.type)

    c = name(col)
    return df.withColumn(out, F.coalesce(nfc(F.expr(f"CASE WHEN {may_change(c)} THEN {c} END")), F.col(c)))
