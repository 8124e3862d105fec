"""Jaccard join of shingle sets by PartEnum signatures.

Sets are banded by size.  Two sets of a band with the wanted similarity differ
in at most k elements.  The domain of the elements is cut into n1 parts, each
into n2 parts again: of the n1, one has at most one differing element, so all
but one of its n2 parts are equal.  A set has a signature for each such subset
of parts; similar sets share one.

What shares a signature is compared exactly, without forming all pairs of a
large group: each member with the group's hub, the member with the most company.
Where members are left that the hub does not connect, one of each run of equal
sets goes on.  A group of few forms its pairs, at most FEW / 2 to a member.  In a
larger one members meet by their differences from the hub, of which two linked
sets must share one of a few, the first in a fixed order.  Before full sets meet,
a bit per element or so (the parity of the elements that fall into it) and then a
byte rule out the pairs that differ in more cells than linked sets can differ in
elements.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, missing_columns, release, staged
from .components import components
from .shingles import mixed, shingle_sets

_SCHEMES = 3


@dataclass(frozen=True)
class Measure:
    """Sets link when den * |intersection| >= num * |union|; `words` to a shingle; `n2` parts of which one may differ."""

    words: int = 5
    num: int = 80
    den: int = 100
    n2: int = 3

    def differing(self, total):
        """The most elements in which two linked sets of `total` elements together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)


class Bands:
    """Bands of sizes: band i ends at ends[i]; k differing elements, n1 parts and the smallest projection that makes a signature."""

    def __init__(self, measure: Measure, largest: int):
        ratio = max(5 * measure.num, 4 * measure.den), 4 * measure.num  # 1.25, or the largest ratio of linked sizes
        self.measure = measure
        self.ends, end = [], 1
        while True:
            self.ends.append(end)
            if end > 2 * largest * measure.den // measure.num + 2:
                break
            end = max(end + 1, end * ratio[0] // ratio[1])
        self.ends = np.array(self.ends)
        self.k = measure.differing(2 * self.ends)
        n1 = self.k // 2 + 1
        self.spare = np.where(self.k > 0, 1 + n1 // 16, 0)
        self.n1 = n1 + self.spare
        projected = np.maximum(self.ends * 0.9 / self.n1 * (measure.n2 - 1) / measure.n2, 0)
        self.least = np.where(projected >= 8, 3, np.where(projected >= 6, 2, 1))

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band of each size, and whether a linked set may lie in the next."""
        band = np.searchsorted(self.ends, sizes)
        return band, self.measure.den * sizes >= self.measure.num * (self.ends[band] + 1)


def signatures(values: np.ndarray, sizes: np.ndarray, measure: Measure, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of sets that lie end to end in `values`.

    Linked sets have at least spare + 1 of the n1 parts with at most one
    differing element.  Projections of fewer than `least` elements say little
    and are left out; should that leave out the shared ones, then both sets
    have more than `spare` parts with one, and such sets are signed again with
    other parts, the last time with all projections.
    """
    out = []
    band, also = bands.of(sizes)
    todo = [(np.flatnonzero(sizes > 0), band), (np.flatnonzero((sizes > 0) & also), band + 1)]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for chosen, in_band in todo:
        for scheme in range(_SCHEMES):
            if not len(chosen):
                break
            owner, sig, bad = _signed(values, first, sizes, chosen, in_band[chosen], measure, bands, scheme)
            out.append((owner, sig))
            chosen = bad
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _signed(values, first, sizes, chosen, band, measure, bands, scheme):
    n = sizes[chosen]
    index = np.repeat(first[chosen] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    v = values[index]
    seed = mixed((band * 8 + scheme).astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    exact = bands.k[band] == 0
    n1 = bands.n1[band]
    parts = n1 * measure.n2
    base = np.concatenate(([0], np.cumsum(parts)[:-1]))
    h = mixed(v ^ np.repeat(seed, n))
    at = (h % np.repeat(parts.astype(np.uint64), n)).astype(np.int64) + np.repeat(base, n)
    total = int(parts.sum())
    count = np.bincount(at, minlength=total).reshape(-1, measure.n2)
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, at, mixed(h + np.uint64(1)))
    sums = sums.reshape(-1, measure.n2)
    whole, n_whole = sums.sum(1, dtype=np.uint64), count.sum(1)
    owner = np.repeat(np.arange(len(chosen)), n1)
    part = np.arange(len(owner)) - np.repeat(base // measure.n2, n1)
    least = bands.least[band] if scheme < _SCHEMES - 1 else np.zeros(len(chosen), np.int64)
    poor = ((n_whole[:, None] - count) < least[owner][:, None]).any(1) & ~exact[owner]
    keep_owner, keep_sig = [], []
    for j in range(measure.n2):
        good = ~exact[owner] & (n_whole - count[:, j] >= least[owner])
        tag = mixed(seed[owner] + (part * measure.n2 + j).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keep_owner.append(owner[good])
        keep_sig.append(mixed((whole - sums[:, j]) ^ tag)[good])
    one = np.flatnonzero(exact)  # only equal sets link: one signature, the whole set
    keep_owner.append(one)
    keep_sig.append(mixed(np.array([whole[base[i] // measure.n2:base[i] // measure.n2 + n1[i]].sum(dtype=np.uint64) for i in one], np.uint64) ^ seed[one]))
    n_poor = np.bincount(owner, weights=poor, minlength=len(chosen))
    bad = chosen[(n_poor > bands.spare[band]) & ~exact]
    return chosen[np.concatenate(keep_owner)], np.concatenate(keep_sig), bad


def signed(docs: DataFrame, key: str, text: str, measure: Measure) -> DataFrame:
    """(id, n_shingles, sigs) of each row."""
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(_signer(measure), "id long, n_shingles long, sigs array<long>")


def _signer(measure: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(measure, 1 << 12)
        for batch in batches:
            for row, values, sizes in shingle_sets(batch.column(1), measure.words):
                if len(sizes) and sizes.max() * 2 > bands.ends[-1]:
                    bands = Bands(measure, int(sizes.max()) * 2)  # the same bands, further up
                owner, sig = signatures(values, sizes, measure, bands)
                order = np.argsort(owner, kind="stable")
                offsets = np.searchsorted(owner[order], np.arange(len(sizes) + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sizes)), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sig[order].view(np.int64)))],
                    names=["id", "n_shingles", "sigs"])

    return run


#: given ids in order of their signatures and the first place of each signature, the mask of the ids that are needed
Needed = Callable[[np.ndarray, np.ndarray], np.ndarray]


def repeated(sigs: DataFrame, needed: Needed | None = None) -> DataFrame:
    """(sig, id) of the signatures that stand more than once in the table (id, sigs); a few others may go along.

    Most signatures stand once.  To find those that do not, tasks send each range of the hash space its signatures in
    packed form, sorted and compressed, a third of the bytes of rows.  There are four ranges per shuffle partition;
    32 bits of a signature and its range are kept, and one that falls together with another only adds a candidate.
    """
    return _found(sigs.mapInArrow(_packer(_ranges(sigs)), "part int, packed binary"), needed)


def repeated_in(docs: DataFrame, key: str, text: str, measure: Measure) -> DataFrame:
    """`repeated` of the signatures of texts with a key, signed and packed by one Python worker; they are never rows."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text)).where("id IS NOT NULL")
    sign, pack_ = _signer(measure), _packer(_ranges(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack_(batch.select(["id", "sigs"]) for batch in sign(batches))

    return _found(texts.mapInArrow(run, "part int, packed binary"))


def _ranges(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _found(packed: DataFrame, needed: Needed | None = None) -> DataFrame:
    dealt = packed.repartition(_ranges(packed) // 4, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(lambda batches: _repeats(batches, needed), "sig long, id long")


def _planes(values: np.ndarray) -> bytes:
    """Compressed, the bytes of equal weight together."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _unplanes(data: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def pack(values: np.ndarray, ids: np.ndarray) -> bytes:
    """Values (uint32) and their ids; four lengths, then differences of the values, places of the ids, differences of the ids."""
    order = np.argsort(values, kind="stable")
    known, place = np.unique(ids[order], return_inverse=True)
    fields = (_planes(np.diff(values[order], prepend=np.uint32(0))), _planes(place.astype(np.uint32)), _planes(np.diff(known, prepend=np.int64(0))))
    return np.array([len(values), len(known), len(fields[0]), len(fields[1])], np.int64).tobytes() + b"".join(fields)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, n_ids, a, b = np.frombuffer(data[:32], np.int64).tolist()
    values = np.cumsum(_unplanes(data[32:32 + a], n, np.uint32), dtype=np.uint32)
    place = _unplanes(data[32 + a:32 + a + b], n, np.uint32)
    return values, np.cumsum(_unplanes(data[32 + a + b:], n_ids, np.int64))[place]


#: signatures that a task packs at a time, and of one range that it holds at a time
CHUNK, HELD = 1 << 21, 1 << 24


def _packer(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sigs, held = [], [], 0
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            own = batch.column(0).to_numpy(zero_copy_only=False)
            i = 0
            while i < len(own):  # whole rows, unless one alone is more
                j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK - held, "right")) - 1)
                ids.append(np.repeat(own[i:j], np.diff(at[i:j + 1])))
                sigs.append(values[at[i]:at[j]])
                held += int(at[j] - at[i])
                i = j
                if held >= CHUNK // 2:
                    yield from packed(np.concatenate(ids), np.concatenate(sigs))
                    ids, sigs, held = [], [], 0
        if held:
            yield from packed(np.concatenate(ids), np.concatenate(sigs))

    def packed(ids: np.ndarray, sigs: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = ((sigs >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, ids, low = part[order], ids[order], (sigs[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        last = np.append(first[1:], len(part))
        rows = [pack(low[a:b], ids[a:b]) for a, b in zip(first, last, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(rows, pa.binary())], ["part", "packed"])

    return run


def _repeats(batches: Iterator[pa.RecordBatch], needed: Needed | None = None) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part.  Of a part that is too large to be held, all goes on; what stands once is then found by the count."""
    part, held, n, whole = None, [], 0, True

    def found() -> Iterator[pa.RecordBatch]:
        values, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        if whole:
            order = np.argsort(values, kind="stable")
            values, ids = values[order], ids[order]
            same = values[1:] == values[:-1]
            kept = np.concatenate((same, [False])) | np.concatenate(([False], same))
            values, ids = values[kept], ids[kept]
            if needed and len(values):
                kept = needed(ids, np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))))
                values, ids = values[kept], ids[kept]
        sig = values.astype(np.int64) + (np.int64(part) << np.int64(32))
        for i in range(0, len(sig), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(sig[i:i + (1 << 17)]), pa.array(ids[i:i + (1 << 17)])], ["sig", "id"])

    for batch in batches:
        for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and (p != part or n > HELD):
                whole = whole and p != part
                yield from found()
                held, n = [], 0
            if p != part:
                part, whole = p, True
            held.append(unpack(data.as_py()))
            n += len(held[-1][0])
    if held:
        yield from found()


def cells(size: int) -> int:
    """Cells of the sketch of a set: a power of two, at least 0.6 of its elements."""
    return 1 << max(0, (6 * size // 10)).bit_length()


def sketch(values: np.ndarray) -> np.ndarray:
    """A byte per cell, the sum of the digests of the elements that fall into it."""
    m = cells(len(values))
    h = mixed(values ^ np.uint64(0x2545F4914F6CDD1D))
    digests = ((h >> np.uint64(48)) & np.uint64(0xFF)).astype(np.float64)
    return np.bincount((h & np.uint64(m - 1)).astype(np.int64), digests, m).astype(np.int64).astype(np.uint8)


def differing_cells(a: np.ndarray, b: np.ndarray) -> int:
    """At most as many as elements that only one of two sets has; the sketch with more cells is folded."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[:len(a) // 2] + a[len(a) // 2:]
    return int(np.count_nonzero(a != b))


def parities(values: np.ndarray, m: int) -> np.ndarray:
    """A bit per cell of m, whether an odd number of elements falls into it; eight cells to a byte."""
    h = mixed(values ^ np.uint64(0x1B873593CC9E2D51)) & np.uint64(m - 1)
    return np.packbits((np.bincount(h.astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little")


def differing_bits(a: np.ndarray, b: np.ndarray) -> int:
    """At most as many as elements that only one of two sets has; of parities the one with more cells is folded."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


#: longs of parities that go along with each element of a large group
MARKS = 4


def sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, n, elements, sketch, parity, marks, digest) of each row; equal sets have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, sizes in shingle_sets(batch.column(1), words):
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                each = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                marks = np.concatenate([parities(v, 64 * MARKS) for v in each] or [np.zeros(0, np.uint8)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sizes)), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64))),
                     pa.array([sketch(v).tobytes() for v in each], pa.binary()),
                     pa.array([parities(v, 1 << max(6, len(v).bit_length())).tobytes() for v in each], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1) * MARKS, pa.int32()), pa.array(marks)),
                     pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in each], pa.binary())],
                    names=["id", "n", "elements", "sketch", "parity", "marks", "digest"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(
        run, "id long, n long, elements array<long>, sketch binary, parity binary, marks array<long>, digest binary")


def possible(pairs: DataFrame, all_sets: DataFrame, measure: Measure, a: str, b: str) -> DataFrame:
    """The (a, b) of `pairs` that sizes, parities and sketches do not rule out; no linked pair is left out."""
    return _passing(_passing(pairs, all_sets, measure, a, b, "parity", differing_bits), all_sets, measure, a, b, "sketch", differing_cells)


def _passing(pairs: DataFrame, all_sets: DataFrame, measure: Measure, a: str, b: str, by: str,
             differing: Callable[[np.ndarray, np.ndarray], int]) -> DataFrame:
    drawn = all_sets.select("id", "n", F.col(by).alias("sketch"))
    both = (pairs.select(a, b).alias("p").join(drawn.alias("y").hint("merge"), F.col(f"p.{b}") == F.col("y.id"))
            .where(F.col("y.n") > 0).join(drawn.alias("x").hint("merge"), F.col(f"p.{a}") == F.col("x.id"))
            .select(F.col(f"p.{a}").alias("a"), F.col(f"p.{b}").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"),
                    F.col("x.sketch").alias("s_a"), F.col("y.sketch").alias("s_b")))
    sized = both.where(F.abs(F.col("n_a") - F.col("n_b")) * (measure.den + measure.num) <= (F.col("n_a") + F.col("n_b")) * (measure.den - measure.num))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.array([differing(np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8))
                              for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], [a, b]).filter(pa.array(apart <= measure.differing(n)))

    return sized.mapInArrow(run, f"{a} long, {b} long")


def members(own: DataFrame) -> DataFrame:
    """(sig, hub, id): of each signature (`own`: sig, id) that several ids have, every other id with the hub.

    The hub is the id that shares most signatures with others, counted over all its signatures.
    """
    shared = own.withColumn("n", F.count("*").over(Window.partitionBy("sig"))).where("n > 1")
    shared = staged(shared, "partenum-shared")
    company = shared.groupBy("id").agg(F.sum("n").alias("company"))
    ranked = shared.select("id", "sig").join(company, "id")
    hub = ranked.groupBy("sig").agg(F.max(F.struct("company", (-F.col("id")).alias("minus"))).alias("h"))
    out = staged(shared.select("id", "sig").join(hub, "sig").select("sig", (-F.col("h.minus")).alias("hub"), "id").where("hub <> id"), "partenum-members")
    discard(shared)
    return out


def linked(measure: Measure, h: str, n: str):
    """Whether sets of together `n` elements, `h` of them differing, link."""
    return F.col(h) * (measure.den + measure.num) <= F.col(n) * (measure.den - measure.num)


def compared(pairs: DataFrame, all_sets: DataFrame, measure: Measure, a: str, b: str) -> DataFrame:
    """`pairs` with n_a, n_b and the elements that only a and only b has.

    Both joins read one exchange of the sets; a hot id's pairs are split by Spark.  The merge hints keep the
    plan the same at all sizes, and the sets, which grow with the input, from being sent to the driver.
    """
    both = (pairs.alias("p").join(all_sets.alias("y").hint("merge"), F.col(f"p.{b}") == F.col("y.id"))
            .join(all_sets.alias("x").hint("merge"), F.col(f"p.{a}") == F.col("x.id")))
    x, y = F.col("x.elements"), F.col("y.elements")
    return both.select(*[F.col(f"p.{c}") for c in pairs.columns], F.size(x).cast("long").alias("n_a"), F.size(y).cast("long").alias("n_b"),
                       F.array_except(x, y).alias("only_a"), F.array_except(y, x).alias("only_b"))


def links(docs: DataFrame, own: DataFrame, key: str, text: str, measure: Measure) -> DataFrame:
    """(a, b): links enough to connect whatever links connect, each one verified on the full sets; `own` has the repeated signatures (sig, id)."""
    groups = members(own)
    release(docs.sparkSession)
    stars = staged(groups.select("hub", "id").distinct(), "partenum-stars")
    involved = stars.select("id").unionByName(stars.select(F.col("hub").alias("id"))).distinct()
    wanted = docs.select(F.col(key).cast("long").alias(key), text).join(involved.withColumnRenamed("id", key).hint("merge"), key, "left_semi")
    all_sets = staged(sets(wanted, key, text, measure.words), "partenum-sets")
    release(docs.sparkSession)
    maybe = staged(possible(stars, all_sets, measure, "hub", "id"), "partenum-maybe")
    release(docs.sparkSession)
    near = compared(maybe, all_sets, measure, "hub", "id").where(linked_sets(measure))
    near = staged(near.select("hub", "id"), "partenum-near")
    star_links = near.select(F.col("hub").alias("a"), F.col("id").alias("b"))
    equal = staged(copies(all_sets), "partenum-copies")
    star_links = star_links.unionByName(equal.where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    labels = components(star_links)
    left = unsettled(groups, near, labels, equal)
    discard(groups)
    release(docs.sparkSession)
    many = left.groupBy("sig").agg(F.count("*").alias("m")).where(F.col("m") > FEW).select("sig")
    open_pairs = staged(left.join(many, "sig", "left_semi").select("hub", "id", "near").distinct(), "partenum-open")
    direct = staged(few_pairs(left.join(many, "sig", "left_anti"), measure), "partenum-direct")
    discard(left)
    release(docs.sparkSession)
    seen = None
    for i in range(SLICES):  # hub by hub's hash, so that the sets on their way take a part of the disk at a time
        slice_ = compared(open_pairs.where(F.pmod(F.xxhash64("hub"), F.lit(SLICES)) == i), all_sets.select("id", "elements"), measure, "hub", "id")
        part = staged(first_differences(slice_, measure), "partenum-compared")
        seen = part if seen is None else seen.unionByName(part)
        release(docs.sparkSession)
    across = cross_candidates(seen, labels, all_sets, measure)
    release(docs.sparkSession)
    more = direct.unionByName(across).distinct()
    few = of_pairs(all_sets, more)
    likely = staged(possible(more, few, measure, "a", "b"), "partenum-possible")
    checked = compared(likely, of_pairs(all_sets, likely), measure, "a", "b").where(linked_sets(measure))
    checked = staged(checked.select("a", "b"), "partenum-checked")
    for done in (all_sets, direct, across, likely):
        discard(done)
    release(docs.sparkSession)
    return star_links.unionByName(checked).distinct()


def of_pairs(all_sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that stand in pairs (a, b); few pairs take few sets along."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return all_sets.join(ids, "id", "left_semi")


#: parts in which the pairs whose differences are wanted are compared, one after the other
SLICES = 4


def first_differences(pairs: DataFrame, measure: Measure) -> DataFrame:
    """(hub, id, near, h, size, first, early, mid) of compared pairs: the elements by which `id` differs from the hub, as many as are needed.

    With `cross_candidates`' e, sets x and y that link share more than h(x) - m of e(x) if m bounds (h(x) - h(y) + d) / 2,
    d the most that they can differ in; the first m + 1 of e(x) then hold a shared one.  As y is not linked to the hub,
    h(y) > r (n(hub) + n(y)) with d = r (n(x) + n(y)), and m = (h(x) + r (n(x) - n(hub))) / 2 will do; d / 2 will, if h(x) <= h(y), and d always.
    """
    less, more = measure.den - measure.num, measure.den + measure.num
    # no set linked to this one differs from it in more than `most` elements
    most = F.floor(F.col("n_b") * less / F.lit(measure.num))
    bound = F.floor((F.col("h") * more + (F.col("n_b") - F.col("n_a")) * less) / F.lit(2 * more))
    # of the differences from the hub, the first in this order are all that is needed: not in the hub, by value; then in the hub
    order = F.concat(F.array_sort("only_b"), F.array_sort("only_a"))
    early = F.least(F.when(F.col("near"), most).otherwise(F.floor(most / 2)), bound) + 1
    need = F.least(F.col("h"), F.when(F.col("near"), early).otherwise(most + 1)).cast("int")
    counted = pairs.withColumn("h", (F.size("only_a") + F.size("only_b")).cast("long"))
    return counted.select("hub", "id", "near", "h", F.col("n_b").alias("size"), F.slice(order, F.lit(1), need).alias("first"),
                          early.alias("early"), (F.least(most, bound) + 1).alias("mid"))


def copies(all_sets: DataFrame) -> DataFrame:
    """(id, n, rep): the smallest id that has the same set."""
    rep = all_sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"))
    return all_sets.select("id", "n", "digest").join(rep, "digest").select("id", "n", "rep")


def unsettled(groups: DataFrame, near: DataFrame, labels: DataFrame, equal: DataFrame) -> DataFrame:
    """(sig, hub, id, near, component, n) of the groups in which members other than the hub may still have to be linked.

    That needs two of them that are not connected yet, one of which is not linked to the hub: two that both are, are
    connected by it.  Of equal sets, which are connected already, one stands for all.
    """
    known = (groups.join(near.withColumn("near", F.lit(True)), ["hub", "id"], "left").join(labels, "id", "left")
             .select("sig", "hub", "id", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("component", "id").alias("component")))
    known = staged(known, "partenum-known")
    states = known.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_and("near").alias("settled"))
    out = staged(known.join(states.where("lo <> hi AND NOT settled").select("sig"), "sig", "left_semi").join(equal, "id")
                 .groupBy("sig", "hub", F.col("rep").alias("id"), "component", "n").agg(F.bool_and("near").alias("near")), "partenum-left")
    discard(known)
    return out


#: members of a group, besides the hub, whose pairs are formed at once; pairs that a task holds at a time
FEW, HELD_PAIRS = 32, 1 << 14


def few_pairs(left: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): the pairs of members of small groups that are not connected, one of them not linked to the hub, and that sizes do not rule out.

    Near copies share most of their signatures, so groups of the same members are told once.
    """
    groups = left.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("id", "near", "component", "n"))).alias("m")).select("m").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            at = lists.offsets.to_numpy()
            own, near, component, n = (x.to_numpy(zero_copy_only=False) for x in lists.values.flatten())
            out, held = [], 0
            for i, j in zip(at[:-1], at[1:], strict=True):
                x, y = np.triu_indices(j - i, 1)
                x, y = x + i, y + i
                may = ((component[x] != component[y]) & (own[x] != own[y]) & ~(near[x] & near[y])
                       & (np.abs(n[x] - n[y]) * (measure.den + measure.num) <= (n[x] + n[y]) * (measure.den - measure.num)))
                out.append(np.sort(np.stack((own[x[may]], own[y[may]])), axis=0))
                held += out[-1].shape[1]
                if held >= HELD_PAIRS:
                    yield told(out)
                    out, held = [], 0
            if held:
                yield told(out)

    def told(pairs: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def linked_sets(measure: Measure):
    """`linked` on the columns that `compared` adds."""
    h = F.size("only_a") + F.size("only_b")
    return h * (measure.den + measure.num) <= (F.col("n_a") + F.col("n_b")) * (measure.den - measure.num)


#: an element that x brings, being linked to the hub, or not; one that only y brings; one that y brings to such x as are linked to the hub
LINKED_EARLY, EARLY, MID, LATE = range(4)


def meeting(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """`Needed` of `cross_candidates`: whether an id's element has one of another row to meet."""
    kind = ids & 3
    linked_early, early, mid, late = (np.add.reduceat(kind == k, first, dtype=np.int64) for k in range(4))
    met = np.stack((early + mid + late > 0, (linked_early > 0) | (early + mid > 1), linked_early + early > 0, linked_early > 0))
    return met[kind, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))]


def cross_candidates(seen: DataFrame, labels: DataFrame, all_sets: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): members of one hub, one of them not linked to it, that may link and are not connected yet; deletes `seen`.

    Let e(x) be the elements in which x and the hub differ; x and y differ in
    |e(x)| + |e(y)| - 2 |e(x) & e(y)|.  With y not linked to the hub, a link needs
    so large an intersection that, in any fixed order, the first `early` of e(x), x the smaller or linked to the hub, and
    the first `mid` of e(y) (or all of `first`, if x is linked to the hub) have one in common; see `first_differences`.

    Most elements differ in one member only.  Hashes of hub and element find those that several have, as those of
    signatures do; what falls together by chance only adds a candidate.  What no pair can meet by is not told.
    """
    rows = (seen.withColumn("row", F.monotonically_increasing_id()).join(labels, "id", "left")
            .withColumn("component", F.coalesce("component", "id")))
    rows = staged(rows, "partenum-differing")
    discard(seen)
    def part(kind: Column, within: Callable[[Column], Column]) -> Column:
        return F.struct((F.col("row") * 4 + kind).alias("id"), F.filter("first", lambda e, i: within(i)).alias("part"))

    # the last two bits of an id say what its elements are for
    parts = F.array(part(F.when(F.col("near"), LINKED_EARLY).otherwise(EARLY), lambda i: i < F.col("early")),
                    part(F.lit(MID), lambda i: (i >= F.col("early")) & (i < F.col("mid"))),
                    part(F.lit(LATE), lambda i: i >= F.greatest("early", "mid")))
    hashed = rows.select("hub", F.explode(parts).alias("p")).select("p.id", F.expr("transform(p.part, e -> xxhash64(hub, e))").alias("sigs"))
    found = repeated(hashed, meeting).select("sig", F.shiftright("id", 2).alias("row"), (F.col("id").bitwiseAND(3)).alias("kind"))
    # an id with several texts has a row with each one's marks
    info = rows.select("row", "hub", "id", "near", "h", "size", "component").join(all_sets.select("id", "marks"), "id")
    found = staged(found.join(info, "row"), "partenum-elements")
    discard(rows)
    release(seen.sparkSession)
    spread = found.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_and("near").alias("settled"))
    some = found.join(spread.where("lo <> hi AND NOT settled").select("sig"), "sig", "left_semi")
    x = some.where(F.col("kind") <= EARLY).select("sig", "hub", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("h").alias("ha"), F.col("size").alias("na"), F.col("kind").alias("ka"), F.col("marks").alias("ma"))
    y = some.where(F.col("kind") >= EARLY).select("sig", "hub", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("h").alias("hb"), F.col("size").alias("nb"), F.col("kind").alias("kb"), F.col("marks").alias("mb"))
    # sizes alone, by the triangle inequality the differences from the hub, and the marks rule pairs out before they are rows
    apart = sum(F.bit_count(F.col("ma")[i].bitwiseXOR(F.col("mb")[i])) for i in range(MARKS))
    may = (linked(measure, "d", "n") & (F.abs(F.col("ha") - F.col("hb")) * (measure.den + measure.num) <= F.col("n") * (measure.den - measure.num))
           & (apart * (measure.den + measure.num) <= F.col("n") * (measure.den - measure.num)))
    pairs = (x.join(y, ["sig", "hub"]).where(f"ca <> cb AND (ka = {LINKED_EARLY} OR (kb <> {LATE} AND (ha < hb OR (ha = hb AND a < b))))")
             .withColumn("n", F.col("na") + F.col("nb")).withColumn("d", F.abs(F.col("na") - F.col("nb"))).where(may))
    out = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "partenum-more")
    discard(found)
    return out


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", measure: Measure = Measure()) -> DataFrame:
    """(id, n_shingles, component_id): each row with the smallest key that links reach.

    NULL or blank text has no shingles and no links.  Rows with one key are one
    document, linked by any of their texts; a NULL key is linked with nothing
    and its component is NULL.  Hashes of 64 bits stand for shingles.
    """
    missing_columns(docs, key, text)
    sigs = staged(signed(docs, key, text, measure), "partenum-signed")
    found = components(links(docs, repeated(sigs.where("id IS NOT NULL").select("id", "sigs")), key, text, measure))
    return (sigs.select("id", "n_shingles").join(found, "id", "left")
            .select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", measure: Measure = Measure()) -> DataFrame:
    """The rows of `docs` whose key is the smallest of its component: one document of each group of near copies stays."""
    missing_columns(docs, key, text)
    found = components(links(docs, repeated_in(docs, key, text, measure), key, text, measure))
    gone = found.where("id <> component").select("id")
    # the row goes along as one value, so that no name of a column is in the way
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")
