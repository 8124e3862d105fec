"""Suffix-array dedup of long byte strings over a sparse set of suffixes.

Every string of `length` bytes has one anchor, its leftmost smallest q-gram by
hash, so equal strings have equal anchors at equal places.  Only suffixes at
anchors are sorted, about one in forty, instead of one at each byte:

1. suffixes are dealt by their leading eight bytes to the ranges between sampled splitters and sorted there by
   their token (the hash of the anchor's q-gram); tokens that occur once cannot be part of a repeat and go, and of
   suffixes that agree in the hash of all strings they anchor, all but the first are repeats;
2. first ones that share their token with others come back with the bytes of the strings, are dealt the same way, and within each bucket the
   strings are sorted by their bytes: multikey quicksort with keys of eight bytes, where only strings that are equal
   so far are looked at any deeper.  Of equal neighbours all but the earliest are
   repeats.  Neighbours are compared across the borders of chunks as well: a chunk that
   ends within a token hands its strings to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import missing_columns, release, staged
from .shingles import mixed, text_parts

Q = 24
LENGTH = 100
#: rows of anchored strings that a task compares at a time
CHUNK = 50_000
_SEGMENT = 8 << 20
_FACTORS = mixed(np.arange(1, 40, dtype=np.uint64))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position (from all that have eight) as a number."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.as_strided(np.ascontiguousarray(data).view(np.uint8), (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()


def hashes(words: np.ndarray, length: int, factors: np.ndarray) -> np.ndarray:
    """Hash of the `length` >= 8 bytes from each position."""
    n = max(0, len(words) - (length - 8))
    out = np.zeros(n, np.uint64)
    steps = [*range(0, length - 7, 8)]
    if steps[-1] != length - 8:
        steps.append(length - 8)
    for f, s in zip(factors, steps, strict=False):
        out = (out ^ words[s:s + n]) * f
        out ^= out >> np.uint64(31)
    return mixed(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by running minima within blocks from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, anchor, first, last) of each run of strings with one anchor; positions in `data`, in order.

    Text i lies from bounds[i] to bounds[i + 1]; strings do not cross from one to another.
    """
    parts = []
    for start in range(0, max(0, len(data) - length + 1), _SEGMENT):
        piece = data[start:start + _SEGMENT + length - 1]
        h = hashes(words_at(piece), Q, _FACTORS)
        place = np.arange(len(h), dtype=np.uint64)
        least = sliding_least(h >> np.uint64(24) << np.uint64(24) | place, length - Q + 1)
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        parts.append((start + at, h[at]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    at, token = (np.concatenate(x) for x in zip(*parts, strict=True))
    valid = np.zeros(len(at), bool)
    step = np.zeros(len(at) + 1, np.int64)
    long = np.diff(bounds) >= length
    np.add.at(step, bounds[:-1][long], 1)
    np.add.at(step, bounds[1:][long] - length + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    first = valid & np.concatenate(([True], (at[1:] != at[:-1]) | ~valid[:-1]))
    last = valid & np.concatenate(((at[1:] != at[:-1]) | ~valid[1:], [True]))
    # a text may begin right where the strings of the one before end
    new_text = np.zeros(len(at), bool)
    begins = bounds[:-1][long]
    new_text[begins] = True
    first |= valid & new_text
    last[:-1] |= valid[:-1] & new_text[1:]
    f, e = np.flatnonzero(first), np.flatnonzero(last)
    return token[f], at[f], f, e


def _doc(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def leading(words: np.ndarray) -> np.ndarray:
    """Eight bytes, read as a little-endian number, as a signed number that sorts as the bytes do."""
    return (words.byteswap() ^ np.uint64(1 << 63)).view(np.int64)


def _emit_leading(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, bounds, _ in text_parts(_doc(batch, "text")):
            at = anchors(data, bounds, length)[1]
            yield pa.RecordBatch.from_arrays([pa.array(leading(words_at(data)[at]))], names=["leading"])


def _emit_anchors(batches: Iterator[pa.RecordBatch], length: int, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = _doc(batch, "doc").to_numpy()
        for data, bounds, row in text_parts(_doc(batch, "text")):
            token, at, first, last = anchors(data, bounds, length)
            text = np.searchsorted(bounds, at, "right") - 1
            signed = token.view(np.int64)
            part = np.searchsorted(splitters, leading(words_at(data)[at]), "right")
            run = run_hashes(data, first, last, at, length).view(np.int64)
            packed = (at - bounds[text]) << 14 | (at - first) << 7 | (at - last)
            for i in range(0, max(1, len(at)), 500_000):
                s = slice(i, i + 500_000)
                yield pa.RecordBatch.from_arrays([pa.array(part[s], pa.int32()), pa.array(signed[s]), pa.array(run[s]),
                                                  pa.array(docs[row + text[s]]), pa.array(packed[s])], names=["part", "token", "run", "doc", "packed"])


class _Repeats:
    """Of rows in order of (token, run, doc, packed), what can be part of a repeat.

    Anchors of one token whose strings are all equal, one run, are one class.  All but its
    first are repeats as a whole (kind 1).  The first of each class has to be compared string by
    string (kind 0), but only with other classes of its token; where there are none, it goes.
    """

    def __init__(self):
        self.last: tuple | None = None  # the last row
        self.alone: tuple[int, int] | None = None  # doc and packed of the first class of the last row's token, while it is the only one

    def of(self, token: np.ndarray, run: np.ndarray, doc: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
        before = self.last or (~token[0], run[0], doc[0], packed[0])
        shifted = [np.concatenate(([b], x[:-1])) for b, x in zip(before, (token, run, doc, packed), strict=True)]
        new_token = token != shifted[0]
        new_class = new_token | (run != shifted[1])
        # a document that the table repeats is one document
        again = ~new_class & ~((doc == shifted[2]) & (packed == shifted[3]))
        group = np.cumsum(new_token)
        classes = np.bincount(group, weights=new_class, minlength=group[-1] + 1)
        first = new_class & (~new_token | (classes[group] > 1))
        docs, places, kinds = [doc[first], doc[again]], [packed[first], packed[again]], [np.zeros(first.sum(), np.int32), np.ones(again.sum(), np.int32)]
        if self.alone is not None and classes[0] > 0:  # the token goes on with a second class
            docs.append(np.array([self.alone[0]]))
            places.append(np.array([self.alone[1]]))
            kinds.append(np.zeros(1, np.int32))
        if group[-1] > 0 or classes[0] > 0:
            at = int(np.flatnonzero(new_token)[-1]) if group[-1] > 0 else -1
            self.alone = (doc[at], packed[at]) if at >= 0 and classes[-1] == 1 else None
        self.last = (token[-1], run[-1], doc[-1], packed[-1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, docs, places)], names=["kind", "doc", "packed"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repeats = _Repeats()
    for batch in batches:
        if len(batch):
            yield repeats.of(*(_doc(batch, n).to_numpy() for n in ("token", "run", "doc", "packed")))


def run_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of each anchor: the first and the last cover the others."""
    out = np.zeros(len(at), np.uint64)
    steps = [*range(0, length - 7, 8)]
    if steps[-1] != length - 8:
        steps.append(length - 8)
    words = words_at(data)
    for where, factors in ((first, _FACTORS), (last, _FACTORS[20:])):
        for f, s in zip(factors, steps, strict=False):
            out = (out ^ words[where + s]) * f
            out ^= out >> np.uint64(31)
    return mixed(out ^ ((at - first) << 8 | (at - last)).astype(np.uint64))


def _emit_strings(batches: Iterator[pa.RecordBatch], length: int, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per anchor of the documents: its token and the bytes of its strings."""
    names = ["part", "token", "doc", "packed", "strings"]
    for batch in batches:
        rows = []
        size = 0
        for doc, text, places in zip(_doc(batch, "doc").to_pylist(), _doc(batch, "text").cast(pa.large_binary()), _doc(batch, "places"), strict=True):
            body = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
            packed = np.sort(places.values.to_numpy())
            at, first, last = packed >> 14, (packed >> 14) - (packed >> 7 & 127), (packed >> 14) - (packed & 127)
            inside = last + length <= len(body)
            packed, at, first, last = packed[inside], at[inside], first[inside], last[inside]
            if not len(at):
                continue
            grams = body[at[:, None] + np.arange(Q)]
            words = np.ascontiguousarray(grams).view("<u8")
            token = np.zeros(len(at), np.uint64)
            for k in range(Q // 8):
                token = (token ^ words[:, k]) * _FACTORS[k]
                token ^= token >> np.uint64(31)
            token = mixed(token).view(np.int64)
            n = last - first + length
            offsets = np.concatenate(([0], np.cumsum(n)))
            index = np.repeat(first - offsets[:-1], n) + np.arange(offsets[-1])
            rows.append((np.searchsorted(splitters, leading(words[:, 0].copy()), "right"), token, np.full(len(at), doc), packed, n, body[index]))
            size += len(index)
            if size > 16 << 20:
                yield _strings_batch(rows, names)
                rows, size = [], 0
        if rows:
            yield _strings_batch(rows, names)


def _strings_batch(rows: list, names: list[str]) -> pa.RecordBatch:
    part, token, doc, packed, n, body = (np.concatenate(x) for x in zip(*rows, strict=True))
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    strings = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(token), pa.array(doc), pa.array(packed), strings], names=names)


def multikey_order(n: int, depth: int, key) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of n strings by `depth` keys, and for each string of the order whether it equals the one before.

    `key(k, rows)` gives the k-th key of some rows: the strings are sorted by the first, then runs of equal ones, and only
    these, by the next.
    """
    first = key(0, np.arange(n))
    order = np.argsort(first, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = first[order[1:]] == first[order[:-1]]
    for k in range(1, depth):
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        run = np.cumsum(~same[where])
        values = key(k, order[where])
        inner = np.lexsort((values, run))
        order[where] = order[where][inner]
        values = values[inner]  # runs stay where they are
        same = np.zeros(n, bool)
        same[where[1:]] = (run[1:] == run[:-1]) & (values[1:] == values[:-1])
    return order, same


class _Chunks:
    """Rows in order of (token, doc, place), compared chunk by chunk; `seen` holds the strings, end to end, of a token that a chunk border cuts."""

    def __init__(self, length: int):
        self.length = length
        self.steps = [*range(0, length - 7, 8)]
        if self.steps[-1] != length - 8:
            self.steps.append(length - 8)
        self.token: int | None = None
        self.seen = np.zeros(0, np.uint8)

    def intervals(self, token: np.ndarray, doc: np.ndarray, packed: np.ndarray, offsets: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
        n = np.diff(offsets) - self.length + 1  # strings of each row
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        old = self.seen if len(token) and token[0] == self.token else self.seen[:0]
        m = len(old) // self.length
        data = np.concatenate((old, body))
        words = words_at(data).byteswap()  # in the order of bytes
        at = np.concatenate((np.arange(m) * self.length, len(old) + offsets[row] + within))
        # stable: equal strings stay in order, those of the chunks before first, then by document and place
        order, same = multikey_order(len(at), len(self.steps), lambda k, rows: words[at[rows] + self.steps[k]])
        repeated = np.zeros(len(at), bool)
        repeated[order] = same
        if len(token):
            ends = np.concatenate((np.full(m, token[-1] == self.token), token[row] == token[-1])) & ~repeated
            self.seen = data[at[ends][:, None] + np.arange(self.length)].ravel()
            self.token = token[-1]
        repeat = repeated[m:]
        start = (packed >> 14) - (packed >> 7 & 127)
        edge = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
        first = repeat & (edge | ~np.concatenate(([False], repeat[:-1])))
        last = repeat & (np.concatenate((edge[1:], [True])) | ~np.concatenate((repeat[1:], [False])))
        f, e = np.flatnonzero(first), np.flatnonzero(last)
        return pa.RecordBatch.from_arrays([pa.array(doc[row[f]]), pa.array(start[row[f]] + within[f]), pa.array(start[row[e]] + within[e] + self.length)],
                                          names=["doc", "from", "to"])


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    chunks, held, rows = _Chunks(length), [], 0

    def run() -> Iterator[pa.RecordBatch]:
        token, doc, packed, n, body = (np.concatenate(x) for x in zip(*held, strict=True))
        # a document that the table repeats is one document
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]) | (packed[1:] != packed[:-1])))
        if not new.all():
            body = body[np.repeat(new, n)]
            token, doc, packed, n = token[new], doc[new], packed[new], n[new]
        yield chunks.intervals(token, doc, packed, np.concatenate(([0], np.cumsum(n))), body)

    for batch in batches:
        for i in range(0, len(batch), CHUNK):
            part = batch.slice(i, CHUNK)
            strings = _doc(part, "strings").cast(pa.large_binary())
            _, offsets, data = strings.buffers()
            at = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
            held.append((_doc(part, "token").to_numpy(), _doc(part, "doc").to_numpy(), _doc(part, "packed").to_numpy(), np.diff(at),
                         np.frombuffer(data, np.uint8)[at[0]:at[-1]]))
            rows += len(part)
            if rows >= CHUNK:
                yield from run()
                held, rows = [], 0
    if held:
        yield from run()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


ANCHORS = "part int, token long, run long, doc long, packed long"
CUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from: long, to: long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_kept: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    for batch in batches:
        rows = []
        for key, text, starts, ends, runs in zip(_doc(batch, "id").to_pylist(), _doc(batch, "text").cast(pa.large_binary()), _doc(batch, "starts").to_pylist(),
                                                 _doc(batch, "ends").to_pylist(), _doc(batch, "runs").to_pylist(), strict=True):
            body = text.as_py() or b""
            whole = [((p >> 14) - (p >> 7 & 127), (p >> 14) - (p & 127) + length) for p in runs or []]
            gone = merged([(a, min(b, len(body))) for a, b in [*zip(starts or [], ends or [], strict=True), *whole] if a < len(body)])
            kept, at = [], 0
            for a, b in gone:
                kept.append(body[at:a])
                at = b
            rest = b"".join([*kept, body[at:]])
            rows.append((key, len(body), len(body) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(),
                         [{"from": a, "to": b} for a, b in gone], rest if with_kept else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def sampled_splitters(rows: DataFrame, length: int, partitions: int, one_in: int) -> np.ndarray:
    """Leading bytes that cut a sample of the documents' suffixes into equal ranges; the driver sees one number per range."""
    sample = rows.where(F.pmod(F.xxhash64("doc"), F.lit(one_in)) == 0)
    found = sample.mapInArrow(partial(_emit_leading, length=length), "leading long")
    cuts = found.agg(F.percentile_approx("leading", [i / partitions for i in range(1, partitions)] or [0.5], 10_000).alias("c")).first()["c"]
    if not cuts:  # nothing sampled: even ranges
        cuts = [-(1 << 63) + i * ((1 << 64) // partitions) for i in range(1, partitions)]
    return np.unique(np.array(cuts, np.int64))


def dedup_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, partitions: int | None = None,
                  sample_one_in: int = 64, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (the bytes left, if asked for): one row per input row.

    A byte goes if a string of `length` (at least 32, at most 150) bytes that covers it also starts earlier: in a document with
    a smaller key, or earlier in the same.  A NULL key is the smallest.  Rows with
    one key are one document: equal texts do not repeat each other, different
    ones are ordered by place.  NULL text is empty.  Strings are
    compared by their bytes, but for suffixes whose strings all agree by a hash of 64 bits (and a token of 64 bits).
    """
    missing_columns(docs, key, text)
    if not 32 <= length <= 150:
        raise ValueError("length must be from 32 to 150")
    spark = docs.sparkSession
    n = partitions or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    splitters = sampled_splitters(rows.select("doc", "text"), length, n, sample_one_in)
    found = (rows.select("doc", "text").mapInArrow(partial(_emit_anchors, length=length, splitters=splitters), ANCHORS)
             .repartitionById(len(splitters) + 1, F.col("part")).drop("part").sortWithinPartitions("token", "run", "doc", "packed")
             .mapInArrow(_repeated, "kind int, doc long, packed long"))
    found = staged(found, "suffix-anchors")
    release(spark)
    # the texts are dealt by document once; both joins below read that exchange
    dealt = rows.repartition(n, "doc")
    places = found.where("kind = 0").groupBy("doc").agg(F.collect_set("packed").alias("places"))
    strings = (dealt.join(places, "doc").select("doc", "text", "places")
               .mapInArrow(partial(_emit_strings, length=length, splitters=splitters), "part int, token long, doc long, packed long, strings binary")
               .repartitionById(len(splitters) + 1, F.col("part")).sortWithinPartitions("token", "doc", "packed"))
    spans = strings.mapInArrow(partial(_compare, length=length), "doc long, from long, to long")
    spans = spans.groupBy("doc").agg(F.collect_list("from").alias("starts"), F.collect_list("to").alias("ends"))
    runs = found.where("kind = 1").groupBy("doc").agg(F.collect_list("packed").alias("runs"))
    return (dealt.join(spans, "doc", "left").join(runs, "doc", "left").select("id", "text", "starts", "ends", "runs")
            .mapInArrow(partial(_cut, length=length, with_kept=with_kept), CUT_DDL))
