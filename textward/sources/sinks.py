"""Guarded writes: check the path, clean, write aside, log, publish.

Nothing appears at a destination if any step fails.  A blocked path is refused
before the job starts.  Cleaned data, its audit lines, the seals of finished chains and
the new heads are written to folders that nobody reads; then one commit file names
all of them (``journal.py``), and they are moved into place.  When anything fails before
the commit, all of them go and earlier data and log stay as they were; when a writer dies
after it, whoever reads or writes the log next finishes the moves.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.paths import OUTSIDE_REFUSAL, SYSTEM_PREFIXES, SYSTEM_REFUSAL
from ..operators.audit import EDGE, SCHEMA, audit_entries, build_chain, exploded_edge, finished, grown, latest_seals, next_heads, verify_log
from ..operators.items import sanitize_lines
from ..operators.sanitize import sanitize
from ..operators.structured import sanitize_json
from ..session import new_path
from . import journal as J


def check_destination(path: str, root: str) -> str:
    """The normalised destination, or ValueError."""
    home = posixpath.normpath(root)
    dest = posixpath.normpath(posixpath.join(home, path))
    if dest.startswith(SYSTEM_PREFIXES):
        raise ValueError(SYSTEM_REFUSAL + dest)
    if dest != home and not dest.startswith(home.rstrip("/") + "/"):
        raise ValueError(OUTSIDE_REFUSAL + dest)
    return dest


def _action(mode: str) -> str:
    return {"overwrite": "write", "append": "append"}[mode]


def _staged(df: DataFrame) -> DataFrame:
    """Write a cleaned table once; data and audit are both taken from it, and the caller may read its reports there."""
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _guarded(spark: SparkSession, dest: str, mode: str, write, entries: DataFrame, audit_path: str, order: list[str]) -> None:
    """Write to a pending folder, log, publish both at once."""
    pending = f"{dest}.pending-{uuid.uuid4().hex}"
    path, fs = J.hadoop(spark, pending)
    try:
        write(pending)
        there = J.replace(pending, dest) if mode == "overwrite" else J.append(pending, dest)
        append_audit(entries, audit_path, order, also=[there])
    except Exception:
        if not _committed(spark, audit_path, pending):
            fs.delete(path, True)
        raise


def _committed(spark: SparkSession, audit_path: str, pending: str) -> bool:
    """Whether a commit names the folder, so that its moves are to be finished rather than undone."""
    journal = f"{audit_path}/_journal"
    last = J._numbers(spark, journal)[-1:]
    return bool(last) and pending in J._read(spark, f"{journal}/{last[0]}")


#: appends after which the heads of all logs are written anew, as one table
COMPACT = 20
ATTEMPTS = 5


def append_audit(entries: DataFrame, audit_path: str, order: list[str], *, rows_per_chain: int = 5000, also: list[dict] | None = None) -> None:
    """Chain new entries, per destination, onto the log at ``audit_path``.

    The last line of each log and the right edge of its seals are kept in a table of their own (``_heads``), so that
    nothing but it is read to go on.  Chains that are finished get a seal (``_seals``), and so does
    every level above them; ``verify_audit`` checks all three tables.  New lines, seals, heads and
    the moves of ``also`` are published by one commit.  If another writer commits meanwhile, the lines are chained again, onto its head.
    """
    spark = entries.sparkSession
    journal = f"{audit_path}/_journal"
    rows = entries.withColumn("log", F.col("destination"))
    for attempt in range(ATTEMPTS):
        seen = J.recover(spark, journal)
        pending = f"{audit_path}/_pending-{uuid.uuid4().hex}"
        try:
            moves = _prepared(spark, rows, audit_path, pending, order, rows_per_chain, seen)
            J.commit(spark, journal, seen, [*(also or []), *moves])
            return
        except Exception as e:
            if not _committed(spark, audit_path, pending):
                path, fs = J.hadoop(spark, pending)
                fs.delete(path, True)
            if not isinstance(e, J.Conflict) or attempt == ATTEMPTS - 1:
                raise


def _prepared(spark: SparkSession, rows: DataFrame, audit_path: str, pending: str, order: list[str], rows_per_chain: int, seen: int) -> list[dict]:
    old = read_heads(spark, audit_path)
    build_chain(rows, "log", order, rows_per_chain=rows_per_chain, heads=old).write.parquet(f"{pending}/lines")
    new = spark.read.schema(LOG_SCHEMA).parquet(f"{pending}/lines")
    moves = [J.append(f"{pending}/lines", audit_path)]
    ended, sealed = finished(new, "log", rows_per_chain), None
    if not ended.isEmpty():
        grown(ended, None if old is None else exploded_edge(old)).write.parquet(f"{pending}/seals")
        sealed = spark.read.schema(SEAL_SCHEMA).parquet(f"{pending}/seals")
        moves.append(J.append(f"{pending}/seals", f"{audit_path}/_seals"))
    heads = next_heads(new, sealed, old, rows_per_chain)
    compact = old is not None and (seen + 1) % COMPACT == 0
    if compact:
        changed = heads.select(F.col("log").alias("__log"))
        heads = heads.unionByName(old.join(changed, F.col("log").eqNullSafe(F.col("__log")), "left_anti"))
    heads.write.parquet(f"{pending}/heads")
    there = f"{audit_path}/_heads"
    moves.append(J.replace(f"{pending}/heads", there) if compact else J.append(f"{pending}/heads", there))
    return moves


SEAL_SCHEMA = "log string, level int, node long, n long, hash string"


def _there(spark: SparkSession, audit_path: str, table: str = "_heads") -> bool:
    """Whether the table is there, once a commit that broke off has been finished."""
    J.recover(spark, f"{audit_path}/_journal")
    path, fs = J.hadoop(spark, f"{audit_path}/{table}")
    return fs.exists(path)


def read_seals(spark: SparkSession, audit_path: str) -> DataFrame:
    """``log, level, node, n, hash`` of all seals, as they are now; no rows where no chain is finished yet."""
    there = _there(spark, audit_path, "_seals")
    return latest_seals(spark.read.schema(SEAL_SCHEMA).parquet(f"{audit_path}/_seals") if there else spark.createDataFrame([], SEAL_SCHEMA))


def verify_audit(spark: SparkSession, audit_path: str, *, rows_per_chain: int = 5000) -> DataFrame:
    """All that is wrong with the log at ``audit_path``: ``log, level, node, status``, see ``verify_log``."""
    return verify_log(read_log(spark, audit_path), read_heads(spark, audit_path).drop("edge"), read_seals(spark, audit_path), rows_per_chain)


HEAD_SCHEMA = f"log string, head_seq long, head_hash string, edge {EDGE}"


def read_heads(spark: SparkSession, audit_path: str) -> DataFrame | None:
    """``log, head_seq, head_hash, edge`` of each log's last entry, or None where there is no log yet."""
    if not _there(spark, audit_path):
        return None
    kept = spark.read.schema(HEAD_SCHEMA).parquet(f"{audit_path}/_heads")
    last = kept.groupBy("log").agg(F.max_by(F.struct("head_seq", "head_hash", "edge"), "head_seq").alias("h"))
    return last.select("log", "h.head_seq", "h.head_hash", "h.edge")


LOG_SCHEMA = "log string, chain long, seq long, prev_hash string, line string"


def read_log(spark: SparkSession, audit_path: str) -> DataFrame | None:
    """The raw audit lines, or None where there is no log yet."""
    return spark.read.schema(LOG_SCHEMA).parquet(audit_path) if _there(spark, audit_path) else None


def read_audit(spark: SparkSession, audit_path: str) -> DataFrame:
    """The audit entries as typed columns."""
    J.recover(spark, f"{audit_path}/_journal")
    log = spark.read.schema(LOG_SCHEMA).parquet(audit_path)
    return log.select("log", "chain", "seq", F.from_json("line", SCHEMA).alias("e")).select("log", "chain", "seq", "e.*")


def export_audit_jsonl(spark: SparkSession, audit_path: str, path: str) -> None:
    """The log's lines as text files, one entry a line, for other readers."""
    J.recover(spark, f"{audit_path}/_journal")
    spark.read.schema(LOG_SCHEMA).parquet(audit_path).select("line").write.text(path)


def read_audit_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """An audit log kept as JSON lines by another writer."""
    return spark.read.schema(SCHEMA).json(path)


def write_text(df: DataFrame, col: str, destination: str, audit_path: str, *, root: str, key: str,
               context: str = "general", mode: str = "overwrite", timestamp: Column | None = None, **kw) -> DataFrame:
    """Clean a text column and write the table; returns the written rows with their reports."""
    dest = check_destination(destination, root)
    clean = _staged(sanitize(df, col, context, cleaned="__clean", **kw).drop(col).withColumnRenamed("__clean", col))
    _guarded(df.sparkSession, dest, mode, clean.drop("report").write.parquet,
             *_log(clean, dest, context, _action(mode), audit_path, [key], timestamp))
    return clean


def write_json(df: DataFrame, col: str, destination: str, audit_path: str, *, root: str, key: str,
               context: str = "general", mode: str = "overwrite", timestamp: Column | None = None, **kw) -> DataFrame:
    """Clean a nested column and write it as JSON lines.

    A list at the root is one level deeper than its own nesting, as if it were
    held in a field; a scalar is cleaned as text.
    """
    dest = check_destination(destination, root)
    depth = 1 if isinstance(df.schema[col].dataType, T.ArrayType) else 0
    clean = _staged(sanitize(df, col, context, cleaned="__clean", root_depth=depth, **kw)
                    .drop(col).withColumnRenamed("__clean", col))
    _guarded(df.sparkSession, dest, mode, clean.drop("report").write.option("ignoreNullFields", "false").json,
             *_log(clean, dest, context, "write_json", audit_path, [key], timestamp))
    return clean


def write_json_documents(df: DataFrame, col: str, destination: str, audit_path: str, *, root: str, key: str,
                         context: str = "general", mode: str = "overwrite", timestamp: Column | None = None, **kw) -> DataFrame:
    """Clean JSON documents of any shape held as text, and write them as JSON lines."""
    dest = check_destination(destination, root)
    clean = _staged(sanitize_json(df, col, context, cleaned="__clean", **kw).drop(col).withColumnRenamed("__clean", col))
    _guarded(df.sparkSession, dest, mode, clean.where(F.col(col).isNotNull()).select(col).write.text,
             *_log(clean, dest, context, "write_json", audit_path, [key], timestamp))
    return clean


def write_lines(df: DataFrame, keys: list[str], order: str, col: str, destination: str, audit_path: str, *, root: str,
                separator: str = "\n\n", context: str = "general", mode: str = "overwrite",
                timestamp: Column | None = None, **kw) -> DataFrame:
    """Clean list items, join them per group in order, and write one row per group."""
    dest = check_destination(destination, root)
    clean = _staged(sanitize_lines(df, keys, order, col, separator=separator, context=context, **kw))
    by = [*keys, "part"] if "part" in clean.columns else keys
    _guarded(df.sparkSession, dest, mode, clean.drop("report").write.parquet,
             *_log(clean, dest, context, "write_lines", audit_path, by, timestamp))
    return clean


def _log(clean, dest, context, action, audit_path, keys, timestamp):
    return audit_entries(clean, dest, context, action, keep=tuple(keys), timestamp=timestamp), audit_path, list(keys)


def sanitize_only(df: DataFrame, col: str, audit_path: str, *, key: str, context: str = "general",
                  timestamp: Column | None = None, **kw) -> DataFrame:
    """Clean without writing the data; entries are logged for rows with threats only."""
    nested = isinstance(df.schema[col].dataType, (T.StructType, T.MapType, T.ArrayType))
    where, action = ("(in-memory-dict)", "sanitize_dict_only") if nested else ("(in-memory)", "sanitize_only")
    clean = _staged(sanitize(df, col, context, **kw))
    append_audit(audit_entries(clean, where, context, action, keep=(key,), timestamp=timestamp, only_threats=True),
                 audit_path, [key])
    return clean
