"""The gateway on streams: clean, write with audit, chain, count per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.reports import threats_found
from ..operators.audit import EDGE, audit_entries, build_chain, exploded_edge, finished, grown, latest_seals, next_heads, verify_log
from ..operators.sanitize import sanitize
from ..session import spread

SEAL_SCHEMA = "log string, level int, node long, n long, hash string, batch_id long"
HEAD_SCHEMA = f"log string, head_seq long, head_hash string, edge {EDGE}"


def sanitize_stream(stream: DataFrame, col: str, context: str = "general", **kw) -> DataFrame:
    """Clean a stream; stateless, the same plan as for a table."""
    return sanitize(stream, col, context, **kw)


def write_with_audit(stream: DataFrame, col: str, key: str, data_path: str, audit_path: str, checkpoint: str, *,
                     context: str = "general", log: str = "stream", rows_per_chain: int = 5000, **trigger):
    """Write cleaned rows and their chained audit entries batch by batch.

    Each batch owns one directory below either path and overwrites it, so a
    batch repeated after a failure leaves the same files.  The chain of a batch
    starts at the head of the batches before it.  Heads and the seals of finished
    chains are kept beside the log (``-heads``, ``-seals``), see ``verify_stream_audit``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows_path, log_path = f"{data_path}/batch_id={batch_id}", f"{audit_path}/batch_id={batch_id}"
        clean = sanitize(spread(batch), col, context, cleaned="__clean").drop(col).withColumnRenamed("__clean", col)
        clean.write.mode("overwrite").parquet(rows_path)
        written = spark.read.schema(clean.schema).parquet(rows_path)
        heads = None
        if batch_id > 0:  # the batch before tells all that is needed of the log: its last line and the right edge of its seals
            heads = spark.read.schema(HEAD_SCHEMA).parquet(f"{audit_path}-heads/batch_id={batch_id - 1}")
        entries = audit_entries(written, data_path, context, "append", keep=(key,)).withColumn("log", F.lit(log))
        (build_chain(entries, "log", [key], rows_per_chain=rows_per_chain, heads=heads)
         .write.mode("overwrite").parquet(log_path))
        new = spark.read.parquet(log_path)
        seals_path = f"{audit_path}-seals/batch_id={batch_id}"
        grown(finished(new, "log", rows_per_chain), None if heads is None else exploded_edge(heads)).write.mode("overwrite").parquet(seals_path)
        sealed = spark.read.schema("log string, level int, node long, n long, hash string").parquet(seals_path)
        after = next_heads(new, sealed, heads, rows_per_chain)
        if heads is not None:  # logs without new lines go along, so that the next batch needs no earlier one
            after = after.unionByName(heads.join(after.select(F.col("log").alias("__log")), F.col("log").eqNullSafe(F.col("__log")), "left_anti"))
        after.write.mode("overwrite").parquet(f"{audit_path}-heads/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def verify_stream_audit(spark, audit_path: str, *, rows_per_chain: int = 5000) -> DataFrame:
    """All that is wrong with the log of ``write_with_audit``: ``log, level, node, status``, see ``verify_log``."""
    heads = spark.read.parquet(f"{audit_path}-heads").groupBy("log").agg(
        F.max("head_seq").alias("head_seq"), F.max_by("head_hash", "head_seq").alias("head_hash"))
    sealed = latest_seals(spark.read.schema(SEAL_SCHEMA).parquet(f"{audit_path}-seals"))
    return verify_log(spark.read.parquet(audit_path), heads, sealed, rows_per_chain)


def threats_per_window(stream: DataFrame, time: str, *by: str, window: str = "1 hour", slide: str | None = None,
                       delay: str = "1 hour", report: str = "report") -> DataFrame:
    """Rows and rows with threats per event-time window; late rows are dropped after ``delay``."""
    local = dict(stream.dtypes)[time] == "timestamp_ntz"
    if local:       # a watermark needs an instant; the windows are given back as local times
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    span = F.window(time, window, slide) if slide else F.window(time, window)
    start, end = (F.col(f"w.{b}").cast("timestamp_ntz" if local else "timestamp") for b in ("start", "end"))
    return (stream.withWatermark(time, delay).groupBy(span.alias("w"), *by)
            .agg(F.count("*").alias("n_rows"), F.count_if(threats_found(report)).alias("n_threats"))
            .select(start.alias("window_start"), end.alias("window_end"), *by, "n_rows", "n_threats"))
