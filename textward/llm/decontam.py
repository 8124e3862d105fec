"""Benchmark decontamination: documents scanned for the n-grams of test items.

The items' windows of words are hashed into a sorted array that is broadcast;
the windows of each document are looked up in it, hits are verified by their
words, and the words of verified windows can be cut out, or their documents
dropped.  Documents are not shuffled.

The set is broadcast in slices of a stated size.  Benchmarks that need one
slice, which is the normal case, take one scan; larger ones one scan a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .common import missing_columns

#: words are runs of digits, letters a-z (A-Z are lower-cased) and everything outside ASCII
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: bytes scanned at a time, unless one window is longer
PIECE = 1 << 19
#: leading bits of a hash that a table of flags is indexed by, before the sorted array is searched
BITS = 20

SCAN = "n_words long, spans array<struct<start: long, end: long, words: long>>, items array<string>"


@dataclass(frozen=True)
class Windows:
    """Some distinct windows: sorted hashes, the words of window i at words[starts[i]:starts[i + 1]], its items, and all lengths in words."""

    hashes: np.ndarray
    starts: np.ndarray
    words: bytes
    item_starts: np.ndarray
    items: list[str]
    lengths: tuple[int, ...]


class Words:
    """The words of one text: the text folded, with where each word starts and ends (bytes)."""

    def __init__(self, data: np.ndarray):
        self.folded = _FOLD[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = self.folded != 32
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

    def window(self, first: int, n: int) -> bytes:
        return b" ".join(self.folded[self.starts[i]:self.ends[i]].tobytes() for i in range(first, first + n))

    def hashes(self, lengths: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(length, first word, hashes of the windows of that length from there on), piece by piece."""
        n, most = len(self.starts), max(lengths)
        first = 0
        while first < n:
            upto = min(n, max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + PIECE))))
            over = min(n, upto + most - 1)  # windows that begin here may end in the next piece
            part = self.folded[self.starts[first]:self.ends[over - 1]]
            at, end = self.starts[first:over] - self.starts[first], self.ends[first:over] - self.starts[first]
            kept = part != 32
            kept[end[:-1]] = True  # one blank after each word
            place = np.cumsum(kept) - kept
            # a polynomial in the place of each byte, so that equal windows differ by a power of the base only
            powers = np.multiply.accumulate(np.full(int(place[-1]) + 1, _BASE, np.uint64))
            sums = np.concatenate(([np.uint64(0)], np.cumsum((part[kept].astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
            back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(place[-1]), _INVERSE, np.uint64))))
            low, high = place[at], place[end - 1] + 1
            for k in lengths:
                m = min(upto, over - k + 1) - first
                if m > 0:
                    yield k, first, _mixed((sums[high[k - 1:k - 1 + m]] - sums[low[:m]]) * back[low[:m]])
            first = upto


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for i, there in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        yield data[at[i]:at[i + 1]] if there else None


def item_windows(n: int):
    """For mapInArrow over (item, text): hash, words, item, length of the windows of n words, or of all words if there are fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                words = Words(text) if text is not None else None
                if words is None or not len(words.starts):
                    continue
                k = min(n, len(words.starts))
                for _, first, found in words.hashes((k,)):
                    rows += [(h, words.window(first + i, k), item, k) for i, h in enumerate(found.view(np.int64).tolist())]
            for i in range(0, len(rows), 1 << 14):
                columns = zip(*rows[i:i + (1 << 14)], strict=True)
                types = (pa.int64(), pa.binary(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["hash", "words", "item", "length"])

    return run


def slices(benchmark: DataFrame, key: str, text: str, n: int, slice_bytes: int) -> Iterator[Windows]:
    """The distinct windows of the benchmark, in sets of about `slice_bytes`: their size is counted before any of them is gathered."""
    spark = benchmark.sparkSession
    path = new_path(spark, "benchmark-windows")
    (benchmark.select(F.col(f"`{key}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
     .mapInArrow(item_windows(n), "hash long, words binary, item string, length int").distinct().write.parquet(path))
    table = spark.read.schema("hash long, words binary, item string, length int").parquet(path)
    size = F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 40
    total, lengths = table.agg(F.coalesce(F.sum(size), F.lit(0)), F.sort_array(F.collect_set("length"))).first()
    count = max(1, -(-total // slice_bytes))
    for i in range(count if total else 0):
        part = table.where(F.pmod("hash", F.lit(count)) == i) if count > 1 else table
        rows = [(r["hash"] & (1 << 64) - 1, bytes(r["words"]), r["item"]) for r in part.collect()]
        rows.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        if rows:
            yield packed(rows, tuple(lengths))


def packed(rows: list[tuple[int, bytes, str | None]], lengths: tuple[int, ...]) -> Windows:
    hashes, starts, words, item_starts, items = [], [0], [], [0], []
    for h, w, item in rows:
        if not hashes or (h, w) != (hashes[-1], words[-1]):
            hashes.append(h)
            words.append(w)
            starts.append(starts[-1] + len(w))
            item_starts.append(item_starts[-1])
        if item is not None:
            items.append(item)
            item_starts[-1] += 1
    return Windows(np.array(hashes, np.uint64), np.array(starts), b"".join(words), np.array(item_starts), items, lengths)


def scan_text(data: np.ndarray | None, windows: Windows | None, filled: np.ndarray | None) -> tuple[int, list[dict], list[str]]:
    """Words, runs of hit words as byte ranges with their number of words, and the items of the windows found."""
    if data is None:
        return 0, [], []
    text = Words(data)
    n = len(text.starts)
    if windows is None or not n:
        return n, [], []
    depth, items = np.zeros(n + 1, np.int64), set()
    for k, first, found in text.hashes(windows.lengths):
        for i in np.flatnonzero(filled[(found >> np.uint64(64 - BITS)).astype(np.int64)]).tolist():
            at = int(np.searchsorted(windows.hashes, found[i]))
            words = None
            while at < len(windows.hashes) and windows.hashes[at] == found[i]:
                words = words if words is not None else text.window(first + i, k)
                if words == windows.words[windows.starts[at]:windows.starts[at + 1]]:
                    depth[first + i] += 1
                    depth[first + i + k] -= 1
                    items.update(windows.items[windows.item_starts[at]:windows.item_starts[at + 1]])
                at += 1
    hit = np.cumsum(depth[:-1]) > 0
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    spans = [{"start": int(text.starts[a]), "end": int(text.ends[b - 1]), "words": int(b - a)} for a, b in zip(begins, ends, strict=True)]
    return n, spans, sorted(items)


def scanner(broadcast):
    """For mapInArrow over (..., text): the other columns, and what the scan finds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, filled = broadcast.value if broadcast is not None else None, None
        if windows is not None:
            filled = np.zeros(1 << BITS, bool)
            filled[(windows.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        for b in batches:
            found = [scan_text(t, windows, filled) for t in _texts(b.column(b.num_columns - 1))]
            span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(span)),
                       pa.array([f[2] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], [*b.schema.names[:-1], "n_words", "spans", "items"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
         n: int = 10, slice_bytes: int = 64 << 20) -> DataFrame:
    """(key, n_words, n_hit, spans, items), one row per row of `docs`.

    A window is `n` consecutive words of an item; an item of fewer words, but not none, is one window.  `spans` are the
    maximal runs of words inside occurrences of windows, as byte ranges of the text in UTF-8 with their number of words;
    `n_hit` is the sum of these; `items` the ids, sorted as text, of the items whose windows occur.  NULL and
    empty texts have no words.  Items of equal id are one item; the windows of an item whose id is NULL hit, but are not
    listed.  Repeated documents each have their row.  An empty benchmark hits nothing.
    """
    missing_columns(docs, key, text)
    missing_columns(benchmark, item, item_text)
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    sets = slices(benchmark, item, item_text, n, slice_bytes)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    first = next(sets, None)
    found = rows.mapInArrow(scanner(spark.sparkContext.broadcast(first) if first is not None else None), f"key {kind}, {SCAN}")
    second = next(sets, None)
    if second is not None:
        found = merged(spark, rows, kind, [first, second], sets)
    return found.select(F.col("key").alias(key), "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"]).alias("n_hit"),
                        "spans", "items")


def merged(spark, rows: DataFrame, kind: str, head: list[Windows], rest: Iterator[Windows]) -> DataFrame:
    """One scan a slice, each written before the next slice is gathered; then the runs of each document are put together."""
    path = new_path(spark, "scans")
    numbered = new_path(spark, "scan-rows")
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(numbered)
    numbered = spark.read.schema(f"key {kind}, text string, row long").parquet(numbered)
    schema = f"key {kind}, row long, {SCAN}"
    sets = (w for part in (head, rest) for w in part)
    for windows in sets:
        sent = spark.sparkContext.broadcast(windows)
        numbered.select("key", "row", "text").mapInArrow(scanner(sent), schema).write.mode("append").parquet(path)
        sent.destroy()
    texts = numbered.select("key", "row", "text")
    found = spark.read.schema(schema).parquet(path).groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return texts.join(found, "row").select("key", "text", "parts", "items").mapInArrow(_united, f"key {kind}, {SCAN}")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, spans = [], []
        for text, parts in zip(_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = Words(text if text is not None else np.zeros(0, np.uint8))
            depth = np.zeros(len(words.starts) + 1, np.int64)
            for p in parts:
                a = int(np.searchsorted(words.starts, p["start"]))
                depth[a] += 1
                depth[a + p["words"]] -= 1
            edges = np.diff(np.concatenate(([0], (np.cumsum(depth[:-1]) > 0).astype(np.int8), [0])))
            begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            counts.append(len(words.starts))
            spans.append([{"start": int(words.starts[x]), "end": int(words.ends[y - 1]), "words": int(y - x)} for x, y in zip(begins, ends, strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), b.column(3)],
                                         ["key", "n_words", "spans", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False, **settings) -> DataFrame:
    """`docs` without what a benchmark holds: documents with a hit are dropped (`whole`), or the runs of hit words cut out.

    A run is replaced by one blank.  Rows keep all their columns, whatever their names, and their number (unless
    `whole`).  NULL and empty texts stay as they are.
    """
    missing_columns(docs, key, text)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = scan(wide, benchmark, key="row", text="text", **settings)
    if whole:
        return found.where("n_hit = 0").select("row.*")
    body = F.col(f"row.`{text}`").cast("binary")
    # what lies between the runs: from the end of one to the start of the next
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))),
                     F.array(F.octet_length(body).cast("long")))
    between = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.substring(
        body, (F.get("edges", i * 2) + 1).cast("int"), (F.get("edges", i * 2 + 1) - F.get("edges", i * 2)).cast("int")).cast("string"))
    cut = found.withColumn("edges", edges).withColumn("cut", F.when(F.size("spans") > 0, F.array_join(between, " ")).otherwise(F.col(f"row.`{text}`")))
    return cut.withColumn("row", F.col("row").withField(f"`{text}`", F.col("cut"))).select("row.*")


#: the registered query in DuckDB's words
SCAN_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
hits AS (
  SELECT r, i, k, item_id FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM places) JOIN windows USING (k, s)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item_id::varchar AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
