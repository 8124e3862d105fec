"""Audit log: entries, hash chain, verification, rotation.

An entry is one JSON line.  Each carries the first 16 hex digits of the SHA-256
of the line before it.  A chain is sequential by nature, so a large log is many
chains: a chain starts anew ("genesis") after ``rows_per_chain`` entries, which
bounds what one task has to walk through.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.reports import threat_count, threats_found, without_evidence
from ..session import new_path
from .numbering import number_rows, salted_join

GENESIS = "genesis"
#: rows of one level under a row of the next
FAN = 1000
MARKER = "rotation_marker"
# fixed value
MARKER_NOTE = "log rotated; previous entries discarded"

DETECTION4 = "struct<category:string,vector:string,severity:string,action:string>"
SCHEMA = (f"timestamp string, prev_hash string, destination string, context string, action string, "
          f"original_length int, cleaned_length int, threats_found boolean, threat_count int, "
          f"detections array<{DETECTION4}>, type string, dropped_count int, dropped_tail_sha string, note string")


def audit_entries(df: DataFrame, destination: str | Column, context: str | Column, action: str | Column, *,
                  report: str = "report", timestamp: Column | None = None, keep: tuple[str, ...] = (),
                  only_threats: bool = False) -> DataFrame:
    """One audit entry per reported row, without the chain fields."""
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    at = F.current_timestamp() if timestamp is None else timestamp
    rows = df.filter(threats_found(report)) if only_threats else df
    return rows.select(
        *keep,
        F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        col(destination).alias("destination"), col(context).alias("context"), col(action).alias("action"),
        F.col(f"{report}.original_length").cast("int").alias("original_length"),
        F.col(f"{report}.cleaned_length").cast("int").alias("cleaned_length"),
        threats_found(report).alias("threats_found"), threat_count(report).alias("threat_count"),
        without_evidence(report).alias("detections"))


def entry_hash(line: Column) -> Column:
    return F.substring(F.sha2(F.trim(line), 256), 1, 16)


def tail_hash(line: Column) -> Column:
    """Hash as taken by writers that looked at the last 4096 bytes of the log only."""
    data = F.encode(F.trim(line), "UTF-8")
    tail = F.when(F.octet_length(line) > 4095, F.substring(data, -4095, 4095)).otherwise(data)
    return F.substring(F.sha2(tail, 256), 1, 16)


ENTRY_FIELDS = ("destination", "context", "action", "original_length", "cleaned_length", "threats_found",
                "threat_count", "detections")


def build_chain(entries: DataFrame, log: str, order: list[str], *, rows_per_chain: int = 5000,
                heads: DataFrame | None = None) -> DataFrame:
    """Chain the entries of each log: ``log, chain, seq, prev_hash, line``.

    ``order`` sorts the entries of a log (first column numeric or a timestamp);
    entry n of a log is entry ``(n - 1) % rows_per_chain + 1`` of its chain.
    ``heads`` (``log, head_seq, head_hash``) continues logs already written: the
    first new entry follows the head.
    """
    numbered = number_rows(entries, [log], order, "__pos")
    base = F.lit(0)
    if heads is not None:
        numbered = salted_join(numbered, heads.select(log, "head_seq", "head_hash"), [log])
        base = F.coalesce(F.col("head_seq"), F.lit(0))
    position = F.col("__pos") + base - 1
    head = F.concat(F.lit('{"timestamp":"'), F.col("timestamp"), F.lit('","prev_hash":"'))
    rest = F.substring(F.to_json(F.struct(*ENTRY_FIELDS), {"ignoreNullFields": "false"}), 2, 2 ** 30)
    rows = numbered.select(
        F.col(log), F.floor(position / rows_per_chain).alias("chain"),
        (position % rows_per_chain + 1).alias("seq"), head.alias("head"), F.concat(F.lit('",'), rest).alias("tail"),
        (F.col("head_hash") if heads is not None else F.lit(None).cast("string")).alias("start"))

    genesis = GENESIS

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        first = rows.iloc[0]
        prev = first["start"] if first["seq"] > 1 and isinstance(first["start"], str) else genesis
        prevs, lines = [], []
        for head, tail in zip(rows["head"], rows["tail"]):
            line = f"{head}{prev}{tail}"
            prevs.append(prev)
            lines.append(line)
            prev = hashlib.sha256(line.strip().encode("utf-8")).hexdigest()[:16]
        return rows.drop(columns=["head", "tail", "start"]).assign(prev_hash=prevs, line=lines)

    kind = entries.schema[log].dataType.simpleString()
    return rows.groupBy(log, "chain").applyInPandas(
        walk, f"`{log}` {kind}, chain long, seq long, prev_hash string, line string")


def chain_heads(chained: DataFrame, log: str) -> DataFrame:
    """Last entry of each log, to continue it later."""
    last = chained.groupBy(log).agg(F.max_by("line", F.struct("chain", "seq")).alias("line"), F.count("*").alias("head_seq"))
    return last.select(log, "head_seq", entry_hash(F.col("line")).alias("head_hash"))


def last_heads(chained: DataFrame, log: str, rows_per_chain: int) -> DataFrame:
    """As ``chain_heads``, from the newest lines alone: the number of a log's last line follows from its chain."""
    last = chained.groupBy(log).agg(F.max_by("line", F.struct("chain", "seq")).alias("line"), F.max(F.struct("chain", "seq")).alias("at"))
    return last.select(log, (F.col("at.chain") * rows_per_chain + F.col("at.seq")).alias("head_seq"), entry_hash(F.col("line")).alias("head_hash"))


def verify_chain(log_rows: DataFrame, keys: list[str], seq: str = "seq", line: str = "line") -> DataFrame:
    """Check every entry against the one before it: ``keys, seq, prev_hash, expected, status``.

    One pass over the log: the predecessor is the row before in the chain's
    order, if it has the number before (a chain of ``build_chain`` is as long as
    its ``rows_per_chain``, so no task sorts more than that).  Status: ``ok``,
    ``rotated`` (first kept entry after a marker), ``unchained`` (no prev_hash)
    or ``broken``.  That no chain is missing as a whole, see ``verify_seals``; chains of any
    length, as other writers make them, see ``verify_long_chains``.
    """
    rows = _links(log_rows, keys, seq, line)
    chain = Window.partitionBy(*keys).orderBy("seq")
    before = F.lag(F.struct(*_BEFORE)).over(chain)
    return _statuses(rows.withColumn("before", before), keys)


_BEFORE = ("seq", "hash", "hash_tail", "type", "tail_sha")


def _links(log_rows: DataFrame, keys: list[str], seq: str, line: str) -> DataFrame:
    """What of each line the check of the next one needs."""
    field = lambda f: F.get_json_object(F.col(line), f"$.{f}")
    return log_rows.select(
        *keys, F.col(seq).alias("seq"), field("prev_hash").alias("prev_hash"), field("type").alias("type"),
        field("dropped_tail_sha").alias("tail_sha"), entry_hash(F.col(line)).alias("hash"), tail_hash(F.col(line)).alias("hash_tail"))


def _statuses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The status of each row of ``_links``, with the row before it in ``before``."""
    follows = F.col("before.seq") == F.col("seq") - 1
    before = lambda c: F.when(follows, F.col(f"before.{c}"))
    rows = rows.withColumns({"expected": before("hash"), "expected_tail": before("hash_tail"), "type_before": before("type"), "dropped": before("tail_sha")})
    prev = F.col("prev_hash")
    status = (F.when(prev.isNull(), "unchained")
              .when(F.col("expected").isNull(), F.when(prev == GENESIS, "ok").otherwise("broken"))
              .when((prev == F.col("expected")) | (prev == F.col("expected_tail")), "ok")
              .when((F.col("type_before") == MARKER) & (prev == F.col("dropped")), "rotated")
              .otherwise("broken"))
    return rows.select(*keys, "seq", "prev_hash", F.coalesce("expected", F.lit(GENESIS)).alias("expected"), status.alias("status"))


def verify_long_chains(log_rows: DataFrame, keys: list[str], seq: str = "seq", line: str = "line") -> DataFrame:
    """As ``verify_chain``, for chains of any length: no task sorts more than one range of a chain.

    The hashes of the lines are range-partitioned by chain and number and written to the shared folder, since a second run would
    draw other bounds.  Inside a range each row has the one before at hand; the last row of each range, one row
    per range and chain, is passed on to the first row of the next.
    """
    spark = log_rows.sparkSession
    ranged = _links(log_rows, keys, seq, line).repartitionByRange(*keys, "seq").withColumn("__range", F.spark_partition_id())
    path = new_path(spark, "audit-ranges")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    here = Window.partitionBy(*keys, "__range").orderBy("seq")
    rows = ranged.withColumn("before", F.lag(F.struct(*_BEFORE)).over(here))
    last = ranged.groupBy(*keys, "__range").agg(F.max(F.struct(*_BEFORE)).alias("last"))
    handed = last.withColumn("handed", F.lag("last").over(Window.partitionBy(*keys).orderBy("__range")))
    handed = handed.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), "handed")
    on = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return _statuses(rows.join(handed, on, "left").withColumn("before", F.coalesce("before", "handed")), keys)


def seals(log_rows: DataFrame, log: str = "log") -> DataFrame:
    """What ties the chains of a log together: ``log, level, node, n, hash``.

    Level 0 has a row per chain: its number of lines and the hash of its last
    one, hence of all of them.  A row of a level above hashes up to ``FAN`` rows
    of the one below, up to a single row per log, so no task ever sees more
    than that many.  Kept apart from the log, it shows chains that were removed or cut.
    """
    return tree(_chains(log_rows, log))


def _chains(log_rows: DataFrame, log: str) -> DataFrame:
    return log_rows.groupBy(F.col(log).alias("log"), F.col("chain").alias("node")).agg(
        F.count("*").alias("n"), entry_hash(F.max_by("line", "seq")).alias("hash"))


def _above(level: DataFrame, *by: str) -> DataFrame:
    """One row per up to ``FAN`` rows of ``log, node, n, hash``."""
    rows = F.array_sort(F.collect_list(F.struct("node", "n", "hash")))
    return (level.groupBy("log", *by, F.floor(F.col("node") / FAN).alias("node"))
            .agg(F.sum("n").alias("n"), F.substring(F.sha2(F.to_json(rows), 256), 1, 16).alias("hash")))


def tree(level: DataFrame) -> DataFrame:
    """Seals of all levels from those of level 0 (``log, node, n, hash``)."""
    most = level.agg(F.max("node")).first()[0] or 0
    out, depth = level.withColumn("level", F.lit(0)), 0
    while most > 0:
        most, depth = most // FAN, depth + 1
        level = _above(level)
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out.select("log", "level", "node", "n", "hash")


def finished(new: DataFrame, log: str, rows_per_chain: int) -> DataFrame:
    """Level-0 seals of the chains that end in new lines: ``log, node, n, hash``."""
    return new.where(F.col("seq") == rows_per_chain).select(
        F.col(log).alias("log"), F.col("chain").alias("node"), F.col("seq").alias("n"), entry_hash(F.col("line")).alias("hash"))


EDGE = "array<struct<level:int,node:long,n:long,hash:string>>"


def grown(new: DataFrame, edge: DataFrame | None) -> DataFrame:
    """Seals to add for new chains: their own (``log, node, n, hash``) and those of every level above them.

    ``edge`` (``log, level, node, n, hash``) is the right edge of the tree so far: the seals whose parent can still
    get children, at most ``FAN`` a level.  Nothing else of the tree is needed, so an append costs the same
    however long the log is.
    """
    most = new.agg(F.max("node")).first()[0] or 0
    level, depth = new.select("log", "node", "n", "hash"), 0
    out = level.withColumn("level", F.lit(0))
    while most > 0:
        below = level
        if edge is not None:
            parent = F.floor(F.col("node") / FAN)
            asked = below.select(F.col("log").alias("__log"), parent.alias("__parent")).distinct()
            old = edge.where(F.col("level") == depth).select("log", "node", "n", "hash")
            old = old.join(asked, F.col("log").eqNullSafe(F.col("__log")) & (parent == F.col("__parent")), "left_semi")
            again = below.select(F.col("log").alias("__log"), F.col("node").alias("__node"))
            old = old.join(again, F.col("log").eqNullSafe(F.col("__log")) & (F.col("node") == F.col("__node")), "left_anti")
            below = below.unionByName(old)
        level = _above(below)
        most, depth = most // FAN, depth + 1
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out.select("log", "level", "node", "n", "hash")


def right_edge(seals_: DataFrame, before: DataFrame | None) -> DataFrame:
    """``log, edge`` after ``seals_`` were added: of each level the seals under the last parent, the newest state of each."""
    rows = seals_ if before is None else seals_.unionByName(before)
    rows = rows.groupBy("log", "level", "node").agg(F.max("n").alias("n"), F.max_by("hash", "n").alias("hash"))
    parent = F.floor(F.col("node") / FAN)
    last = F.max(parent).over(Window.partitionBy("log", "level"))
    rows = rows.withColumn("__last", last).where(parent == F.col("__last"))
    return rows.groupBy("log").agg(F.sort_array(F.collect_list(F.struct("level", "node", "n", "hash"))).alias("edge"))


def exploded_edge(heads: DataFrame) -> DataFrame:
    """The edges of heads as ``log, level, node, n, hash``."""
    return heads.select("log", F.explode("edge").alias("e")).select("log", "e.*")


def next_heads(new: DataFrame, seals_: DataFrame | None, before: DataFrame | None, rows_per_chain: int) -> DataFrame:
    """``log, head_seq, head_hash, edge`` of the logs that new lines went to."""
    last = last_heads(new, "log", rows_per_chain)
    old = None if before is None else before.join(last.select(F.col("log").alias("__log")), F.col("log").eqNullSafe(F.col("__log")), "left_semi")
    if seals_ is not None:
        edge = right_edge(seals_, None if old is None else exploded_edge(old))
    elif old is not None:
        edge = old.select("log", "edge")
    else:
        return last.withColumn("edge", F.array().cast(EDGE))
    edge = edge.withColumnRenamed("log", "__log")
    return (last.join(edge, F.col("log").eqNullSafe(F.col("__log")), "left")
            .select("log", "head_seq", "head_hash", F.coalesce("edge", F.array().cast(EDGE)).alias("edge")))


def latest_seals(kept: DataFrame) -> DataFrame:
    """The newest state of each seal: the last seal of a level above 0 is written again as it grows."""
    return kept.groupBy("log", "level", "node").agg(F.max("n").alias("n"), F.max_by("hash", "n").alias("hash"))


def _differences(now: DataFrame, was: DataFrame) -> DataFrame:
    a, b = now.alias("a"), was.alias("b")
    on = F.col("a.log").eqNullSafe(F.col("b.log")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.node") == F.col("b.node"))
    status = (F.when(F.col("a.node").isNull(), "missing").when(F.col("b.node").isNull(), "unsealed")
              .when((F.col("a.n") != F.col("b.n")) | (F.col("a.hash") != F.col("b.hash")), "changed"))
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("log", "level", "node")],
                                              status.alias("status")).where("status IS NOT NULL")


def verify_seals(log_rows: DataFrame, kept: DataFrame, log: str = "log", open_chains: DataFrame | None = None) -> DataFrame:
    """What differs from the seals: ``log, level, node, status``, status ``missing``, ``changed`` or ``unsealed``.

    Level 0 compares the chains with their seals, each level above compares the
    seals kept there with those made of the level below, up to the root.  So a
    chain that goes with its seal shows in the level above.  ``open_chains``
    (``log, node, n, hash``) vouches for chains that are not finished.
    """
    zero = kept.where("level = 0").select("log", "level", "node", "n", "hash")
    if open_chains is not None:
        zero = zero.unionByName(open_chains.withColumn("level", F.lit(0)).select(zero.columns))
    chains = _differences(_chains(log_rows, log).withColumn("level", F.lit(0)), zero)
    # a root has nothing above it: its level has node 0 only
    made = _above(kept, "level").withColumn("level", F.col("level") + 1)
    last = kept.groupBy("log", "level").agg(F.max("node").alias("most"))
    above = _differences(made, kept.where("level > 0"))
    roots = last.where("most = 0").select("log", (F.col("level") + 1).alias("level"), F.lit("unsealed").alias("status"))
    roots = roots.withColumnRenamed("log", "__log").withColumnRenamed("level", "__level").withColumnRenamed("status", "__status")
    above = above.join(roots, above["log"].eqNullSafe(F.col("__log")) & (above["level"] == F.col("__level")) & (above["status"] == F.col("__status")), "left_anti")
    return chains.unionByName(above)


def verify_log(log_rows: DataFrame, heads: DataFrame, kept: DataFrame, rows_per_chain: int) -> DataFrame:
    """All that is wrong with a log: ``log, level, node, status``.

    Lines that do not follow the line before (level -1, node is the chain),
    chains and seals as in ``verify_seals`` with the heads vouching for the last chain
    of each log, and logs whose seals do not add up to their head (level -2).
    """
    lines = verify_chain(log_rows, ["log", "chain"]).where("status <> 'ok'")
    size = F.lit(rows_per_chain)
    rest = F.col("head_seq") % size
    last = heads.where(rest > 0).select("log", F.floor(F.col("head_seq") / size).alias("node"), rest.alias("n"), F.col("head_hash").alias("hash"))
    sealed = kept.where("level = 0").groupBy(F.col("log").alias("__log")).agg(F.sum("n").alias("__n"))
    short = heads.join(sealed, F.col("log").eqNullSafe(F.col("__log")), "left").where(F.coalesce("__n", F.lit(0)) != F.col("head_seq") - rest)
    return (lines.select("log", F.lit(-1).alias("level"), F.col("chain").alias("node"), "status")
            .unionByName(verify_seals(log_rows, kept, open_chains=last))
            .unionByName(short.select("log", F.lit(-2).alias("level"), F.lit(None).cast("long").alias("node"), F.lit("changed").alias("status"))))


def orphans(log_rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Entries of an unordered log whose predecessor is not in it."""
    rows = log_rows.select(*keys, F.col(line).alias("line"),
                           F.get_json_object(F.col(line), "$.prev_hash").alias("prev_hash"))
    hashes = log_rows.select(*keys, F.explode(F.array(entry_hash(F.col(line)), tail_hash(F.col(line)))).alias("prev_hash"))
    dropped = log_rows.select(*keys, F.get_json_object(F.col(line), "$.dropped_tail_sha").alias("prev_hash")).dropna()
    known = hashes.unionByName(dropped)
    return rows.filter(F.col("prev_hash") != GENESIS).join(known, [*keys, "prev_hash"], "left_anti")


def forks(log_rows: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Hashes that more than one entry claims as predecessor."""
    prev = F.get_json_object(F.col(line), "$.prev_hash")
    return (log_rows.select(*keys, prev.alias("prev_hash")).dropna(subset=["prev_hash"])
            .groupBy(*keys, "prev_hash").agg(F.count("*").alias("n")).filter("n > 1"))


def rotate(log_rows: DataFrame, keys: list[str], seq: str = "seq", line: str = "line", *, limit: int = 5000,
           timestamp: Column | None = None) -> DataFrame:
    """Drop the older half of each log with more than ``limit`` lines.

    ``seq`` numbers the lines from 1 without gaps.  A rotation marker naming the
    number of dropped lines and the hash of the last one takes line 1.
    """
    at = F.current_timestamp() if timestamp is None else timestamp
    sizes = log_rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    cut = sizes.filter(F.col("__n") > limit).select(*keys, F.floor(F.col("__n") / 2).alias("__drop"))
    rows = salted_join(log_rows.select(*keys, F.col(seq).alias("seq"), F.col(line).alias("line")), cut, keys)
    drop = F.coalesce(F.col("__drop"), F.lit(0))
    shift = F.when(F.col("__drop").isNotNull(), 1).otherwise(0)
    kept = rows.filter(F.col("seq") > drop).select(*keys, (F.col("seq") - drop + shift).alias("seq"), "line")
    marker = rows.filter(F.col("seq") == F.col("__drop")).select(*keys, F.lit(1).cast("long").alias("seq"), F.to_json(F.struct(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        F.lit(GENESIS).alias("prev_hash"), F.lit(MARKER).alias("type"), F.col("__drop").alias("dropped_count"),
        entry_hash(F.col("line")).alias("dropped_tail_sha"), F.lit(MARKER_NOTE).alias("note"))).alias("line"))
    return kept.unionByName(marker)


def rotate_log(log_rows: DataFrame, *, rows_per_chain: int = 5000, limit: int = 5000, timestamp: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop the older half of each log (``log, chain, seq, line``) with more than ``limit`` lines, by whole chains: ``kept, markers``.

    The size of a log is the running number of its last line over all its chains.  ``markers`` has a row per rotated log: ``log, chain`` (the
    first chain that stays), ``line`` (the marker, with the number of lines dropped and the hash of the last one).  Seals are kept as they
    are; ``verify_retained`` checks what stays against them.  A log whose older half is less than a chain stays whole.
    """
    at = F.current_timestamp() if timestamp is None else timestamp
    ends = log_rows.groupBy("log").agg(F.max(F.col("chain") * rows_per_chain + F.col("seq")).alias("n"))
    cut = ends.where(F.col("n") > limit).select("log", F.floor(F.floor(F.col("n") / 2) / rows_per_chain).alias("first")).where("first > 0")
    rows = salted_join(log_rows, cut, ["log"])
    kept = rows.where(F.col("first").isNull() | (F.col("chain") >= F.col("first"))).drop("first")
    last = rows.where((F.col("chain") == F.col("first") - 1) & (F.col("seq") == rows_per_chain))
    marker = F.to_json(F.struct(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"), F.lit(GENESIS).alias("prev_hash"), F.lit(MARKER).alias("type"),
        (F.col("first") * rows_per_chain).alias("dropped_count"), entry_hash(F.col("line")).alias("dropped_tail_sha"), F.lit(MARKER_NOTE).alias("note")))
    return kept, last.select("log", F.col("first").alias("chain"), marker.alias("line"))


def verify_retained(log_rows: DataFrame, markers: DataFrame, kept: DataFrame) -> DataFrame:
    """As ``verify_seals`` for a rotated log: chains before the first that stays may be missing if its marker fits.

    A marker fits if the hash it names is that of the seal of the last chain dropped and it counts the lines of the seals dropped; if it does not,
    the row has level -3, the first kept chain and ``changed``.
    """
    found = verify_seals(log_rows, kept)
    gone = markers.select(F.col("log").alias("__log"), F.col("chain").alias("__first"), F.get_json_object("line", "$.dropped_tail_sha").alias("__tail"),
                          F.get_json_object("line", "$.dropped_count").cast("long").alias("__dropped"))
    same = F.col("log").eqNullSafe(F.col("__log"))
    rest = found.join(gone, same, "left").where(~F.coalesce((F.col("level") == 0) & (F.col("status") == "missing") & (F.col("node") < F.col("__first")), F.lit(False)))
    sealed = kept.where("level = 0").join(gone, same).where(F.col("node") < F.col("__first")).groupBy("__log", "__first", "__tail", "__dropped").agg(
        F.sum("n").alias("n"), F.max_by("hash", "node").alias("hash"))
    wrong = sealed.where((F.col("n") != F.col("__dropped")) | (F.col("hash") != F.col("__tail")))
    return rest.select("log", "level", "node", "status").unionByName(
        wrong.select(F.col("__log").alias("log"), F.lit(-3).alias("level"), F.col("__first").alias("node"), F.lit("changed").alias("status")))


def modified_files(edits: DataFrame, session: str, path: str) -> DataFrame:
    """Files touched per session, each once."""
    return edits.select(session, path).dropDuplicates([session, path])


def threat_entries(log: DataFrame) -> DataFrame:
    """Entries of a parsed audit log in which threats were found."""
    return log.filter(F.col("threats_found"))
