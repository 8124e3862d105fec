"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A sketch has cells of a count, a sum of paragraph digests and a sum of check
digests.  The sketch of one version minus that of another is the sketch of
their difference; cells that hold one digest are peeled off until none is left,
which recovers the digests that only one version has.  Where peeling gets
stuck, sketches of twice the cells are made and peeled, until it succeeds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import missing_columns

CELLS = 24
HASHES = 3
_LONG = 256
_SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def paragraphs(text: str | None) -> list[str]:
    """Lines that are not blank; a line of over 256 characters by sentences, a longer sentence by blocks of 256."""
    out: list[str] = []
    for line in (text or "").split("\n"):
        if not line.strip():
            continue
        for part in [line] if len(line) <= _LONG else _SENTENCE.findall(line):
            out += [part] if len(part) <= _LONG else [part[i:i + _LONG] for i in range(0, len(part), _LONG)]
    return out


def digests(text: str | None) -> np.ndarray:
    """64-bit digests; the second, third, ... occurrence of a paragraph has another digest than the first."""
    hashed = np.array([xxhash.xxh3_64_intdigest(p) for p in paragraphs(text)], np.uint64)
    if len(hashed) < 2:
        return hashed
    order = np.argsort(hashed, kind="stable")
    ordered = hashed[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    nth = np.arange(len(hashed)) - np.repeat(first, np.diff(np.append(first, len(hashed))))
    out = np.empty_like(hashed)
    out[order] = np.where(nth > 0, mixed(ordered + nth.astype(np.uint64) * _M[1]), ordered)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[0]
    x = (x ^ (x >> np.uint64(29))) * _M[1]
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Sketches:
    """Counts, digest sums and check sums of sketches of `cells` cells, end to end."""

    count: np.ndarray
    keys: np.ndarray
    marks: np.ndarray
    cells: int


def checks(d: np.ndarray) -> np.ndarray:
    return mixed(d + _M[3]) & np.uint64(0xFFFFFFFF)


def places(d: np.ndarray, cells: int) -> np.ndarray:
    """HASHES cells for each digest, one in each third of the sketch: shape (HASHES, n)."""
    third = cells // HASHES
    return np.stack([(mixed(d ^ _M[k]) % np.uint64(third)).astype(np.int64) + k * third for k in range(HASHES)])


def sketches(versions: list[np.ndarray], cells: int = CELLS) -> Sketches:
    """The sketch of each version's digests."""
    n = len(versions)
    d = np.concatenate(versions) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(x) for x in versions])
    at = (places(d, cells) + owner * cells).ravel()
    count = np.bincount(at, minlength=n * cells).astype(np.int64)
    keys, marks = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    np.add.at(keys, at, np.tile(d, HASHES))
    np.add.at(marks, at, np.tile(checks(d), HASHES))
    return Sketches(count, keys, marks, cells)


def subtract(a: Sketches, b: Sketches) -> Sketches:
    """Cell by cell: what is in both versions cancels out, and the sketch of their difference is left."""
    if a.cells != b.cells or len(a.count) != len(b.count):
        raise ValueError("sketches of different sizes")
    return Sketches(a.count - b.count, a.keys - b.keys, a.marks - b.marks, a.cells)


def peel(count: np.ndarray, keys: np.ndarray, marks: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests recovered, the sketch and side (+1, -1) of each, and whether each of the n sketches came out empty."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        side = count[look]
        d = np.where(side > 0, keys[look], np.uint64(0) - keys[look])
        mark = np.where(side > 0, marks[look], np.uint64(0) - marks[look])
        good = mark == checks(d)
        look, side, d = look[good], side[good], d[good]
        own = look // cells
        # one digest may lie alone in several of its cells
        _, first = np.unique(np.stack([own.astype(np.uint64), d]), axis=1, return_index=True)
        own, side, d = own[first], side[first], d[first]
        if not len(d):
            break
        found.append((d, own, side))
        at = (places(d, cells) + own * cells).ravel()
        s = np.tile(side, HASHES)
        np.add.at(count, at, -s)
        wrapped = (-s).astype(np.uint64)
        np.add.at(keys, at, np.tile(d, HASHES) * wrapped)
        np.add.at(marks, at, np.tile(checks(d), HASHES) * wrapped)
        touched = np.unique(at)
        look = touched[np.abs(count[touched]) == 1]
    empty = ~((count.reshape(n, cells) != 0).any(1) | (keys.reshape(n, cells) != 0).any(1) | (marks.reshape(n, cells) != 0).any(1))
    parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    return (*parts, empty)


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS, first: tuple[Sketches, Sketches] | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each pair of versions: digests only in a, digests only in b, cells of the sketches that gave them.

    The sketches of both are subtracted and what is left is peeled.  Where that fails, both are sketched again in twice
    the cells.  `first` are the sketches of that many cells, where they are there already.
    """
    out: list = [None] * len(a)
    todo = np.arange(len(a))
    while len(todo):
        pair = first or (sketches([a[i] for i in todo], cells), sketches([b[i] for i in todo], cells))
        first = None
        left = subtract(*pair)
        got, own, side, empty = peel(left.count, left.keys, left.marks, len(todo), cells)
        order = np.argsort(own, kind="stable")
        got, own, side = got[order], own[order], side[order]
        bounds = np.searchsorted(own, np.arange(len(todo) + 1))
        for k in np.flatnonzero(empty):
            part, s = got[bounds[k]:bounds[k + 1]], side[bounds[k]:bounds[k + 1]]
            out[todo[k]] = (part[s > 0], part[s < 0], cells)
        todo = todo[~empty]
        cells *= 2
    return out


def recovered(a: str, b: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Digests only in the first and only in the second of two encoded fingerprints; None if they differ in more than the cells give."""
    left = subtract(decoded(a), decoded(b))
    got, _, side, empty = peel(left.count, left.keys, left.marks, 1, left.cells)
    return (got[side > 0], got[side < 0]) if empty[0] else None


def likeness(n_a: int, n_b: int, differing: int) -> float:
    """Common paragraphs over all paragraphs; two texts without any are alike."""
    both = n_a + n_b
    return (both - differing) / (both + differing) if both else 1.0


_CELL = np.dtype([("c", "<u4"), ("k", "<u8"), ("m", "<u8")])


def encoded(made: Sketches) -> list[str]:
    """The sketches as text: count (4 bytes), digest sum (8), check sum (8) of each cell, in base 64."""
    packed = np.zeros(len(made.count), _CELL)
    packed["c"], packed["k"], packed["m"] = made.count, made.keys, made.marks
    raw, size = packed.tobytes(), made.cells * packed.itemsize
    return [base64.b64encode(raw[i:i + size]).decode() for i in range(0, len(raw), size)]


def decoded(text: str) -> Sketches:
    packed = np.frombuffer(base64.b64decode(text), _CELL)
    return Sketches(packed["c"].astype(np.int64), packed["k"].copy(), packed["m"].copy(), len(packed))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by as many, or all, of the first of the following text."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                 ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                 ("n_edited", pa.int64()), ("cells_edited", pa.int64())])
OUT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double, n_edited long, cells_edited long")


def compare(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Fingerprints and likeness for (id, text, following text)."""
    texts = [(t, edited(t, n), n) for _, t, n in pairs]
    own, changed, following = ([digests(t[k]) for t in texts] for k in range(3))
    made = [sketches(d) for d in (own, changed, following)]
    to_edited, to_next = (differences(own, d, first=(made[0], m)) for d, m in ((changed, made[1]), (following, made[2])))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
        [p[0] for p in pairs], [len(t[0]) for t in texts],
        [hashlib.sha256(t[1].encode("utf-8", "surrogatepass")).hexdigest() for t in texts], encoded(made[0]), encoded(made[1]),
        [likeness(len(a), len(b), len(x[0]) + len(x[1])) for a, b, x in zip(own, changed, to_edited, strict=True)],
        [likeness(len(a), len(b), len(x[0]) + len(x[1])) for a, b, x in zip(own, following, to_next, strict=True)],
        [len(x[0]) + len(x[1]) for x in to_edited], [x[2] for x in to_edited]), OUT, strict=True)], schema=OUT)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (part, ahead, id, text); a row with `ahead` only lends its text to the row before."""
    before = None
    pairs, size = [], 0
    for batch in batches:
        for part, ahead, key, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if before is not None and before[0] == part:
                pairs.append((before[1], before[2], text))
                size += len(before[2]) + len(text)
            before = None if ahead else (part, key, text)
            if size > 4_000_000 or len(pairs) >= 2000:
                yield compare(pairs)
                pairs, size = [], 0
    if pairs:
        yield compare(pairs)


def successors(docs: DataFrame, key: str, text: str, partitions: int) -> DataFrame:
    """(part, ahead, id, text): documents in ranges of the key; each range is closed by a copy of the row that follows it.

    Ranges begin at keys of the table (approximate quantiles), so one shuffle
    brings every row to its range, and the first row of a range to the one
    before too; the first of all closes the last.  The driver sees one key per
    range.  Rows with equal keys are in one range, in order of their text.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    probe = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls"), F.min("id").alias("low"),
                     F.percentile_approx("id", [i / partitions for i in range(1, partitions)] or [0.5], 10_000).alias("cuts")).first()
    first = None if probe["nulls"] else probe["low"]
    cuts = sorted({c for c in probe["cuts"] or [] if partitions > 1 and (probe["nulls"] or c > probe["low"])})
    # the first row of each range: of the rows with its first key, the one with the smallest text
    starts = F.col("id").isin(cuts) if cuts else F.lit(False)
    if len(cuts):
        bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
        part = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("id"))))
    else:
        part = F.lit(0)
    copies = F.concat(F.array(F.struct(part.cast("int").alias("part"), F.lit(0).alias("ahead"))),
                      F.when(starts, F.array(F.struct((part - 1).cast("int").alias("part"), F.lit(1).alias("ahead")))).otherwise(F.array().cast("array<struct<part:int,ahead:int>>")),
                      F.when(F.col("id").eqNullSafe(F.lit(first)), F.array(F.struct(F.lit(len(cuts)).alias("part"), F.lit(2).alias("ahead"))))
                      .otherwise(F.array().cast("array<struct<part:int,ahead:int>>")))
    dealt = rows.select(F.explode(copies).alias("c"), "id", "text").select("c.part", "c.ahead", "id", "text")
    return (dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "ahead", "id", "text"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Sketch of each document and of its edited text, and their likeness, and that to the next document by key.

    NULL text is empty.  A NULL key comes before all others.  Of rows with one
    key, the order is that of their texts; each row, repeats too, gives one row.
    The document after the last is the first; a single document follows itself.
    """
    missing_columns(docs, key, text)
    spark = docs.sparkSession
    n = partitions or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return successors(docs, key, text, n).mapInArrow(_run, OUT_DDL)
