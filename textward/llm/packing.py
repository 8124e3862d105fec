"""Packing token sequences by non-negative least squares on the length histogram.

A document's full windows are sequences of their own; its tail (shorter than a
window) is put in a bin of `unit` tokens.  All combinations of at most `depth`
bins that fill a window exactly are enumerated, non-negative least squares
gives how often each should occur to meet the histogram, and the counts are
rounded down.  Tails that no combination takes are the residual: laid end to
end, they are cut greedily into what the binned tails leave open, and the rest
into windows, the last one by powers of two.  Nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import missing_columns, staged
from .wordids import WordIds

FINAL_ID = 1
_BLOCK = 4096


@dataclass(frozen=True)
class Shape:
    """`unit`: bin width in tokens.  `depth`: most tails in a combination.  `held_back`: share of each count left to
    the residual, so that it fills what the bins' rounding leaves open; raised where that is too little."""

    window: int = 2048
    unit: int = 32
    depth: int = 4
    held_back: float = 0.03

    @property
    def bins(self) -> int:
        return self.window // self.unit


def combinations(total: int, depth: int) -> list[list[int]]:
    """All multisets of at most `depth` numbers from 1 that add up to `total`."""

    def fill(left: int, most: int, slots: int) -> Iterator[list[int]]:
        if left == 0:
            yield []
        elif slots:
            for part in range(min(left, most), 0, -1):
                if part * slots < left:
                    break
                for rest in fill(left - part, part, slots - 1):
                    yield [part, *rest]

    return list(fill(total, total, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """x >= 0 with least |ax - b|, by an active set: free the column with the steepest gain, step back where one turns negative."""
    x = np.zeros(a.shape[1])
    free: list[int] = []
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        free.append(best)
        while free:
            z = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z.min() > 0:
                x[:] = 0
                x[free] = z
                break
            now = x[free]
            low = z <= 0
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))
            x[free] = now + step * (z - now)
            free = [c for c, v in zip(free, x[free], strict=True) if v > 1e-12]
            keep = np.zeros_like(x)
            keep[free] = x[free]
            x = keep
    return x


def repeats(histogram: np.ndarray, shape: Shape, held_back: float) -> list[tuple[int, list[int]]]:
    """(count, bins) of each combination used; never takes more of a bin than there is.  histogram[b]: tails in bin b."""
    kinds = combinations(shape.bins, shape.depth)
    a = np.zeros((shape.bins + 1, len(kinds)))
    for k, kind in enumerate(kinds):
        for b in kind:
            a[b, k] += 1
    weight = np.arange(shape.bins + 1)[:, None]  # a tail counts by its tokens
    x = nnls(a * weight, histogram * weight[:, 0]) if histogram.any() else np.zeros(len(kinds))
    left, used = histogram.astype(np.int64), []
    for k in np.argsort(-x, kind="stable"):
        need = a[:, k].astype(np.int64)
        count = int(min([int(x[k] * (1 - held_back)), *(left[need > 0] // need[need > 0])]))
        if count > 0:
            left -= count * need
            used.append((count, kinds[k]))
    return used


TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("pos", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())),
                    ("full_before", pa.int64()), ("tail", pa.int64()), ("tail_crc", pa.int64()), ("bin", pa.int32()), ("rank", pa.int64()),
                    ("tail_ids", pa.binary())])
TOKENS_DDL = ("doc_id long, part long, pos long, doc_tokens long, crcs array<long>, full_before long, tail long, tail_crc long, "
              "bin int, rank long, tail_ids binary")


def tokenized(docs: DataFrame, key: str, text: str, path: str, shape: Shape) -> DataFrame:
    """One row per document, numbered within its task: `pos` overall, `full_before` full windows, `rank` within the bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = WordIds(path), TaskContext.get().partitionId()
        width, size = words.width, 4 * shape.window
        last = np.array([FINAL_ID], "<u4").tobytes()
        pos = full = 0
        ranks = [0] * (shape.bins + 1)
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(body) + last
                n = len(ids) // 4
                whole = n // shape.window
                tail = ids[whole * size:]
                b = -(-(len(tail) // 4) // shape.unit)
                rows.append((doc_id, part, pos, n, [zlib.crc32(ids[i * size:(i + 1) * size]) for i in range(whole)], full, len(tail) // 4,
                             zlib.crc32(tail), b, ranks[b], np.frombuffer(tail, "<u4").astype(width).tobytes()))
                pos += 1
                full += whole
                ranks[b] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TOKENS, strict=True)]
                                             if rows else [pa.array([], f.type) for f in TOKENS], schema=TOKENS)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, TOKENS_DDL)


def before(df: DataFrame, value: str, order: str, *group: str):
    """Sum of `value` over the rows before, in `order`; 0 for the first."""
    per = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return F.coalesce(F.sum(value).over(per.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    NULL text is empty: one final id.  Rows are packed as they come, so repeated
    or NULL keys are packed as often as they occur.  The driver sees the
    histogram (`bins` numbers), the counts of combinations and two sums; the
    running sums need one row per scan task or per 4096 sequences.
    """
    missing_columns(docs, key, text)
    fed = staged(tokenized(docs, key, text, tokenizer, shape), "packing-tokens")
    narrow = fed.select("doc_id", "part", "pos", "doc_tokens", "tail", "tail_crc", "bin", "rank")
    per_bin = fed.where("bin > 0").groupBy("part", "bin").agg(F.count("*").alias("n"))
    counts = {r["bin"]: r["n"] for r in per_bin.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    histogram = np.array([counts.get(b, 0) for b in range(shape.bins + 1)], np.int64)
    first = per_bin.withColumn("bin_before", before(per_bin, "n", "part", "bin")).drop("n")
    ranked = narrow.where("bin > 0").join(first, ["part", "bin"]).withColumn("g", F.col("bin_before") + F.col("rank")).drop("bin_before", "rank")

    held_back = shape.held_back
    while True:
        used = repeats(histogram, shape, held_back)
        sequences = sum(n for n, _ in used)
        placed = staged(placements(ranked, used), "packing-placed")
        taken = placed.where("seq IS NOT NULL")
        sums = placed.agg(F.coalesce(F.sum(F.when(F.col("seq").isNotNull(), F.col("tail"))), F.lit(0)).alias("taken"),
                          F.coalesce(F.sum("tail"), F.lit(0)).alias("all")).first()
        open_tokens, residual_tokens = sequences * shape.window - sums["taken"], sums["all"] - sums["taken"]
        if open_tokens <= residual_tokens:
            break
        held_back = min(1.0, 2 * held_back) if held_back else 0.01

    full_rows = fed.where(F.size("crcs") > 0)
    per_part = full_rows.groupBy("part").agg(F.sum(F.size("crcs")).alias("n"))
    n_full = per_part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    full = (full_rows.join(per_part.withColumn("full_first", before(per_part, "n", "part")).drop("n"), "part")
            .select("doc_id", "doc_tokens", F.col("full_first"), "full_before", F.posexplode("crcs").alias("i", "crc"))
            .select("doc_id", (F.col("i") * shape.window).cast("long").alias("start"), F.lit(shape.window).cast("long").alias("length"),
                    F.col("crc").alias("ids_crc32"), "doc_tokens",
                    (F.col("full_first") + F.col("full_before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    start = F.col("doc_tokens") - F.col("tail")
    binned = taken.withColumn("offset", before(taken, "tail", "slot", "seq")).select(
        "doc_id", start.alias("start"), F.col("tail").alias("length"), F.col("tail_crc").alias("ids_crc32"), "doc_tokens",
        (F.col("seq") + n_full).alias("sequence_id"), "offset")
    cuts = residual_cuts(placed.where("seq IS NULL"), open_places(taken, shape), open_tokens, residual_tokens, n_full, n_full + sequences, shape)
    ids = fed.select("part", "pos", "tail_ids").join(cuts, ["part", "pos"])
    rest = ids.mapInArrow(_residual_pieces(shape), full.schema)
    return full.unionByName(binned).unionByName(rest)


def placements(ranked: DataFrame, used: list[tuple[int, list[int]]]) -> DataFrame:
    """Adds seq and slot: the g-th tail of a bin goes to the combination whose range of that bin holds g.

    The table of ranges has a row per used combination and distinct bin: at most `bins` combinations of `depth` bins.
    """
    at: dict[int, int] = {}
    rows, base = [], 0
    for count, kind in used:
        for b in sorted(set(kind)):
            c = kind.count(b)
            rows.append((b, at.get(b, 0), at.get(b, 0) + c * count, base, c, kind.index(b)))
            at[b] = at.get(b, 0) + c * count
        base += count
    ranges = ranked.sparkSession.createDataFrame(rows, "r_bin int, r_from long, r_to long, r_seq long, r_each long, r_slot long")
    on = (F.col("bin") == F.col("r_bin")) & (F.col("g") >= F.col("r_from")) & (F.col("g") < F.col("r_to"))
    nth = F.col("g") - F.col("r_from")
    return (ranked.join(F.broadcast(ranges), on, "left")
            .withColumn("seq", F.col("r_seq") + F.floor(nth / F.col("r_each")))
            .withColumn("slot", F.col("r_slot") + nth % F.col("r_each"))
            .select("doc_id", "part", "pos", "doc_tokens", "tail", "tail_crc", "seq", "slot"))


def open_places(taken: DataFrame, shape: Shape) -> DataFrame:
    """What is open at the end of each sequence, laid end to end: seq, at (in the sequence), p_from, p_to (on the line)."""
    each = taken.groupBy("seq").agg(F.sum("tail").alias("at")).withColumn("open", F.lit(shape.window) - F.col("at"))
    each = each.where("open > 0").withColumn("block", F.floor(F.col("seq") / _BLOCK))
    blocks = each.groupBy("block").agg(F.sum("open").alias("n"))
    blocks = blocks.withColumn("block_from", before(blocks, "n", "block")).drop("n")
    return (each.withColumn("p", before(each, "open", "seq", "block")).join(blocks, "block")
            .select("seq", "at", (F.col("block_from") + F.col("p")).alias("p_from"))
            .join(each.select("seq", "open"), "seq").withColumn("p_to", F.col("p_from") + F.col("open")).drop("open"))


def residual_cuts(residual: DataFrame, places: DataFrame, open_tokens: int, residual_tokens: int, first_seq: int, first_new: int,
                  shape: Shape) -> DataFrame:
    """Per residual tail: doc_id, doc_tokens, part, pos, cuts(from, length, sequence_id, offset), a tail has at most its tokens of them."""
    parts = residual.groupBy("part").agg(F.sum("tail").alias("n"))
    parts = parts.withColumn("part_from", before(parts, "n", "part")).drop("n")
    line = (residual.withColumn("t", before(residual, "tail", "pos", "part")).join(parts, "part")
            .withColumn("t_from", F.col("part_from") + F.col("t")).withColumn("t_to", F.col("t_from") + F.col("tail"))
            .select("doc_id", "doc_tokens", "part", "pos", "tail", "t_from", "t_to"))
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / _BLOCK), F.floor((F.col(b) - 1) / _BLOCK)))
    low, high = F.greatest("t_from", "p_from"), F.least("t_to", "p_to")
    inside = (line.where(F.col("t_from") < open_tokens).withColumn("block", blocks("t_from", "t_to"))
              .join(places.withColumn("block", blocks("p_from", "p_to")), "block")
              # of the blocks that both touch, the one in which the overlap begins
              .where((low < high) & (F.floor(low / _BLOCK) == F.col("block")))
              .select("part", "pos", F.struct((low - F.col("t_from")).alias("from"), (high - low).alias("length"), (F.col("seq") + first_seq).alias("sequence_id"),
                                              (F.col("at") + low - F.col("p_from")).alias("offset")).alias("cut")))
    new = residual_tokens - open_tokens
    whole, ends, left = new // shape.window, [], new % shape.window
    at = whole * shape.window
    for k in range(shape.window.bit_length() - 1, -1, -1):
        if left >> k & 1:
            ends.append((at, 1 << k))
            at += 1 << k
    piece = lambda a, n, s: F.struct((a + F.lit(open_tokens)).cast("long").alias("w"), F.lit(n).cast("long").alias("n"), s.cast("long").alias("s"))
    windows = F.transform(
        F.when((F.col("t_to") > open_tokens) & (F.col("t_from") < open_tokens + whole * shape.window),
               F.sequence(F.floor(F.greatest(F.col("t_from") - open_tokens, F.lit(0)) / shape.window),
                          F.least(F.floor((F.col("t_to") - 1 - open_tokens) / shape.window), F.lit(whole - 1))))
        .otherwise(F.array().cast("array<bigint>")), lambda k: piece(k * shape.window, shape.window, k + first_new))
    tail_windows = F.filter(F.array(*[piece(F.lit(a), n, F.lit(first_new + whole + i)) for i, (a, n) in enumerate(ends)]),
                            lambda w: (w["w"] < F.col("t_to")) & (w["w"] + w["n"] > F.col("t_from"))) if ends else None
    beyond = line.where(F.col("t_to") > open_tokens).withColumn("w", F.explode(F.concat(windows, tail_windows) if ends else windows))
    lo, hi = F.greatest(F.col("t_from"), F.col("w.w")), F.least(F.col("t_to"), F.col("w.w") + F.col("w.n"))
    outside = beyond.select("part", "pos", F.struct((lo - F.col("t_from")).alias("from"), (hi - lo).alias("length"), F.col("w.s").alias("sequence_id"),
                                                    (lo - F.col("w.w")).alias("offset")).alias("cut"))
    cuts = inside.unionByName(outside).groupBy("part", "pos").agg(F.collect_list("cut").alias("cuts"))
    return residual.select("doc_id", "doc_tokens", "part", "pos", "tail").join(cuts, ["part", "pos"])


def _residual_pieces(shape: Shape):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "doc_tokens", "tail", "tail_ids", "cuts")]
            for doc_id, n, tail, raw, cuts in zip(*columns, strict=True):
                ids = np.frombuffer(raw, np.dtype("<u2") if len(raw) == 2 * tail else np.dtype("<u4")).astype("<u4").tobytes()
                for c in cuts:
                    a, m = c["from"], c["length"]
                    rows.append((doc_id, n - tail + a, m, zlib.crc32(ids[4 * a:4 * (a + m)]), n, c["sequence_id"], c["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

    return run
