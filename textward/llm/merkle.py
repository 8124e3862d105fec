"""Merkle manifest of a dataset, with proofs made by pointer jumping.

Every row is a leaf.  The leaves of a group form a tree, the groups' subroots,
in the order of the groups, the tree above.  All trees share one numbering: a
group's leaves take a slot of 2^depth positions, so the ancestor of a node `d`
levels up is its position shifted right by `d`, through the subroot to the root.

Nodes are hashed in blocks of 4096 neighbours, twelve levels a pass.  Each node
starts with the segment to its parent: its sibling.  Then the table of nodes is
joined with itself: a node that holds the segment over `d` levels is joined with
its ancestor, which holds the next `d`, and the two are concatenated.  The
distance doubles each time, until every leaf holds all siblings up to the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows, salted_join
from .common import missing_columns, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: levels hashed in one pass: a block of neighbours has 2^12 nodes at most
LEVELS = 12
#: a segment has for each level that hashes: one byte that tells where the sibling is, and its digest
LEFT, RIGHT, ALONE = b"L", b"R", b"N"
STEP = 33
#: a side of at most so many bytes, by the known number of nodes, is broadcast
BROADCAST_BYTES = 2 << 20

RESULT = "leaf string, subroot string, root string, proof binary, proof_sha256 string, folded_root string, verified boolean"


def leaf(values: list[Column]) -> Column:
    """Hex SHA-256 of the values, each `-` if NULL, else its bytes, `:` and itself."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS,
             received: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of `docs`: its key (by its name), leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    Leaves of a group ascend by key, NULL first; rows of one key by their digest, so rows that repeat in all fields
    have equal leaves and places next to each other.  A NULL group is a group, the first one.  NULL and empty values
    hash differently.  `received` names fields as they came in, where these may differ from `docs`: `folded_root` is
    what a receiver computes from them and the original proof, `verified` tells if that is the root.  Other columns
    of `docs` have no influence, whatever their names.  An empty table gives no rows.
    """
    missing_columns(docs, key, group, *fields)
    spark = docs.sparkSession
    column = lambda c: docs[f"`{c}`"]
    sent = leaf([column(c) for c in fields])
    came = leaf([(received or {}).get(c, column(c)) for c in fields])
    rows = docs.select(column(key).alias("key"), column(group).alias("grp"), F.unhex(sent).alias("digest"),
                       F.unhex(came).alias("came"), F.monotonically_increasing_id().alias("tie"))
    placed = number_rows(rows, ["grp"], ["key", "digest", "tie"], "pos").drop("tie")
    groups = number_rows(placed.groupBy("grp").agg(F.max("pos").alias("n")), [], ["grp"], "rank")
    groups = staged(groups.select("grp", "n", (F.col("rank") - 1).alias("slot"), levels_above(F.col("n")).alias("depth")), "merkle-groups")
    total, many, deepest = groups.agg(F.sum("n"), F.count("*"), F.max("depth")).first()
    if total is None:
        return spark.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, {RESULT}")
    height = deepest + (many - 1).bit_length()
    leaves = staged(salted_join(placed, groups.select("grp", "slot", "depth"), ["grp"], "inner").select(
        "key", "came", "digest", "depth", (F.shiftleft("slot", deepest) + F.col("pos") - 1).alias("id")), "merkle-leaves")
    nodes = hashed_nodes(leaves, deepest, height)
    root = nodes.where(F.col("level") == height).first()["digest"]
    subroots = nodes.where(F.col("level") == deepest).select(F.col("id").alias("slot"), F.col("digest").alias("subroot"))
    proven = jump(nodes, leaves, total, many, height)
    rows = salted_join(proven.withColumn("slot", F.shiftright("id", deepest)), subroots, ["slot"], "inner")
    steps = F.expr(f"transform(filter(sequence(0, length(proof) div {STEP}), i -> i < length(proof) div {STEP}), i -> substring(proof, i * {STEP} + 1, {STEP}))")
    # bound once: the steps are read twice
    rows = rows.select("key", "digest", "came", "subroot", "proof", F.transform(F.array(steps), lambda s: F.struct(
        siblings_hash(s).alias("proof_sha256"), folded(s, F.col("came")).alias("folded_root")))[0].alias("f"))
    return rows.select(F.col("key").alias(key), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(root.hex()).alias("root"),
                       "proof", "f.proof_sha256", "f.folded_root", (F.col("f.folded_root") == root.hex()).alias("verified"))


def levels_above(n: Column) -> Column:
    """How often n nodes must be halved, rounding up, until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def hexed(digest: str | Column) -> Column:
    return F.lower(F.hex(digest))


def hashed_nodes(leaves: DataFrame, deepest: int, height: int) -> DataFrame:
    """(level, id, digest, proof, depth) of all nodes; `proof` is the segment to the parent, empty if the parent is the node itself."""
    schema = "level int, id long, digest binary, proof binary, depth int"
    out, level = leaves.select(F.lit(0).alias("level"), "id", "digest", F.lit(b"").alias("proof"), "depth"), 0
    if height == 0:
        return out
    parts, last = [], out
    while level < height:
        upto = min(level + LEVELS, height)
        block = F.shiftright("id", upto - level)
        dealt = last.select("id", "digest", "depth").repartition(block).sortWithinPartitions("id")
        part = staged(dealt.mapInArrow(_hasher(level, upto, deepest), schema), "merkle-nodes")
        parts.append(part.where(F.col("level") < upto))
        last, level = part.where(F.col("level") == upto), upto
    nodes = last
    for part in parts:
        nodes = nodes.unionByName(part)
    return nodes


def _hasher(level: int, upto: int, deepest: int):
    """Hash blocks of neighbours from `level` to `upto`; rows come sorted by id, so a block is complete when the next begins."""
    shift = upto - level

    def block(rows: list[tuple], out: list[tuple]) -> None:
        for at in range(level, upto):
            above, i = [], 0
            while i < len(rows):
                node, digest, depth = rows[i]
                pair = i + 1 < len(rows) and rows[i + 1][0] == node + 1 and not node & 1
                if pair:
                    other = rows[i + 1]
                    out.append((at, node, digest, RIGHT + other[1], depth))
                    out.append((at, other[0], other[1], LEFT + digest, other[2]))
                    digest = sha256((digest.hex() + other[1].hex()).encode()).digest()
                elif at >= deepest or at < depth:
                    out.append((at, node, digest, ALONE + bytes(32), depth))
                    digest = sha256(digest.hex().encode()).digest()
                else:  # the group's tree is lower than the others: its subroot goes up as it is
                    out.append((at, node, digest, b"", depth))
                above.append((node >> 1, digest, depth))
                i += 1 + pair
            rows = above
        out += [(upto, node, digest, b"", depth) for node, digest, depth in rows]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["level", "id", "digest", "proof", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and row[0] >> shift != rows[0][0] >> shift:
                    block(rows, out)
                    rows = []
                    if len(out) > 1 << 14:
                        yield batch(out)
                        out = []
                rows.append(row)
        if rows:
            block(rows, out)
        if out:
            yield batch(out)

    return run


def jump(nodes: DataFrame, leaves: DataFrame, total: int, many: int, height: int) -> DataFrame:
    """`leaves` with `proof`: the segments from each leaf to the root, by joins that double the distance.

    After the join of distance d only nodes on every 2d-th level are needed any more, which is where the next join
    looks for ancestors; the leaves' own rows are read from level 0.
    """
    inner = nodes.where(F.col("level") > 0).select("level", "id", "proof")
    rows = (leaves.join(nodes.where(F.col("level") == 0).select("id", "proof"), "id") if height
            else leaves.withColumn("proof", F.lit(b"")))
    d = 1
    while d < height:
        ancestors = inner.where(F.col("level") == d).drop("level")
        rows = extended(rows, ancestors, ["id"], d, (total >> d) + many)
        if 2 * d < height:
            upper = inner.where(F.col("level") % (2 * d) == d)
            lower = inner.where(F.col("level") % (2 * d) == 0)
            n = sum((total >> at) + many for at in range(3 * d, height, 2 * d))
            inner = staged(extended(lower, upper.withColumn("level", F.col("level") - d), ["level", "id"], d, n), "merkle-jump")
        d *= 2
    return rows


def extended(rows: DataFrame, ancestors: DataFrame, on: list[str], d: int, n: int) -> DataFrame:
    """`rows`, each segment followed by that of the ancestor `d` levels up; at most `n` ancestors.

    An ancestor has at most 2^d rows below it.  Where there are few ancestors, they are broadcast.
    """
    named = ancestors.select(*[F.col(c).alias(f"a_{c}") for c in on], F.col("proof").alias("a_proof"))
    if n * (STEP * d + 64) <= BROADCAST_BYTES:
        named = F.broadcast(named)
    match = F.shiftright(rows["id"], d) == F.col("a_id")
    if "level" in on:
        match = match & (rows["level"] == F.col("a_level"))
    joined = rows.join(named, match, "left")
    return joined.withColumn("proof", F.concat("proof", F.coalesce("a_proof", F.lit(b"")))).drop("a_proof", *[f"a_{c}" for c in on])


def siblings_hash(steps: Column) -> Column:
    """Hex SHA-256 of the siblings' hex digests, from the leaf upwards."""
    known = F.filter(steps, lambda s: F.substring(s, 1, 1) != F.lit(ALONE))
    return F.sha2(F.array_join(F.transform(known, _sibling), "").cast("binary"), 256)


def folded(steps: Column, digest: Column) -> Column:
    """Hex digest of the root that a leaf's digest and the siblings lead to."""
    def up(acc: Column, s: Column) -> Column:
        side = F.substring(s, 1, 1)
        both = F.when(side == F.lit(LEFT), F.concat(_sibling(s), acc)).when(side == F.lit(RIGHT), F.concat(acc, _sibling(s))).otherwise(acc)
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(steps, hexed(digest), up)


def _sibling(step: Column) -> Column:
    return hexed(F.substring(step, 2, 32))


#: the registered query in DuckDB's words: the trees level by level, then each leaf's way up
MANIFEST_SQL = r"""
WITH RECURSIVE crc_bits AS (
  SELECT i, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM crc_bits WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM crc_bits WHERE step = 8),
rows AS (
  SELECT *, doc_id::varchar AS t, CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(
      list_concat([4294967295::bigint], list_transform(range(1, len(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint)),
      lambda a, b: xor(a // 256, crcs[xor(a, b) % 256 + 1])), 4294967295) % 7 = 0 END AS bad
  FROM documents, crc_table),
hashed AS (
  SELECT doc_id, lang, sha256(e1 || e2 || e3 || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') || e5) AS leaf,
    sha256(e1 || e2 || e3 || coalesce(strlen((n_chars::hugeint + CASE WHEN bad THEN 1 ELSE 0 END)::varchar)::varchar || ':'
      || (n_chars::hugeint + CASE WHEN bad THEN 1 ELSE 0 END)::varchar, '-') || e5) AS came
  FROM (SELECT *, coalesce(strlen(t)::varchar || ':' || t, '-') AS e1, coalesce(strlen(source)::varchar || ':' || source, '-') AS e2,
          coalesce(strlen(lang)::varchar || ':' || lang, '-') AS e3, coalesce(strlen(text)::varchar || ':' || text, '-') AS e5 FROM rows)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM hashed),
low AS (
  SELECT 0 AS level, g, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT level + 1, g, pos // 2, sha256(d || coalesce(following, '')), (n + 1) // 2
  FROM (SELECT *, lead(d) OVER (PARTITION BY g ORDER BY pos) AS following FROM low WHERE n > 1) WHERE pos % 2 = 0),
subroots AS (SELECT g, d AS subroot FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, g AS pos, subroot AS d, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(d || coalesce(following, '')), (n + 1) // 2
  FROM (SELECT *, lead(d) OVER (ORDER BY pos) AS following FROM high WHERE n > 1) WHERE pos % 2 = 0),
walk AS (
  SELECT doc_id, leaf, g, pos, came AS acc, '' AS proof, 0 AS level FROM placed
  UNION ALL
  SELECT doc_id, leaf, w.g, w.pos // 2, sha256(CASE WHEN w.pos % 2 = 0 THEN acc || coalesce(s.d, '') ELSE s.d || acc END),
    proof || coalesce(s.d, ''), w.level + 1
  FROM walk w JOIN low o ON o.level = w.level AND o.g = w.g AND o.pos = w.pos AND o.n > 1
  LEFT JOIN low s ON s.level = w.level AND s.g = w.g AND s.pos = xor(w.pos, 1)),
ends AS (SELECT w.* FROM walk w JOIN low o ON o.level = w.level AND o.g = w.g AND o.n = 1),
climb AS (
  SELECT doc_id, leaf, g, g AS pos, acc, proof, 0 AS level FROM ends
  UNION ALL
  SELECT doc_id, leaf, w.g, w.pos // 2, sha256(CASE WHEN w.pos % 2 = 0 THEN acc || coalesce(s.d, '') ELSE s.d || acc END),
    proof || coalesce(s.d, ''), w.level + 1
  FROM climb w JOIN high o ON o.level = w.level AND o.pos = w.pos AND o.n > 1
  LEFT JOIN high s ON s.level = w.level AND s.pos = xor(w.pos, 1))
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.d AS verified
FROM climb JOIN (SELECT * FROM high WHERE n = 1) r ON climb.level = r.level JOIN subroots USING (g)
"""
