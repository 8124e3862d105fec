"""Exact dedup by a stream with keyed state on disk.

A narrow feed (digest, id, locator of each row) is streamed into an aggregation
by digest without watermark, so nothing expires.  Its state lies in RocksDB and
is checkpointed to the shared folder: per digest the number of rows, the row
that stays (largest id) and where its content lies.  Tasks combine the rows of
a digest before the shuffle, so a hot text sends one row per task and batch.
Wherever a digest was hit more than once, the full bytes of every row are then
compared with those of the row that stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import new_path
from .common import missing_columns, staged

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass(frozen=True)
class Decisions:
    """`rows`: id, digest, file, at (the locator), keep_id, group_size, kept, one row per input row.
    `source`: the input, a row as one value in `row`, with its locator in `__file`, `__at`."""

    rows: DataFrame
    source: DataFrame


def locate(docs: DataFrame) -> DataFrame:
    """(row, __file, __at): the rows of `docs`, each as one value, with their content locator, file and row position in it.

    A table that is not a plain file scan has no such positions and is written
    to the shared folder first, once, under names that hide nothing.
    """
    place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at")
    plain = [F.col(f"`{c}`") for c in docs.columns]
    if "_metadata" not in map(str.lower, docs.columns):
        try:
            return docs.select(F.struct(*plain).alias("row"), *place)
        except AnalysisException:
            pass
    copy = staged(docs.select(*[c.alias(f"c{i}") for i, c in enumerate(plain)]), "exact-source")
    return copy.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("row"), *place)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, batch_bytes: int = 256 << 20) -> Decisions:
    """Of rows with identical text the one with the largest key stays; of equal keys, the one with the largest locator.

    NULL text counts as empty; NULL keys are smallest.  Exactly one row of each
    text stays, also among rows that repeat in every column.  `digest` may be
    any function of the text: rows that share a digest but not their bytes are
    told apart by full comparison.  An empty table gives no rows.
    """
    missing_columns(docs, key, text)
    spark = docs.sparkSession
    source = locate(docs)
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    path = new_path(spark, "exact-feed")
    source.select(F.col(f"row.`{key}`").alias("id"), digest(body).alias("digest"), F.col("__file").alias("file"),
                  F.col("__at").alias("at")).write.parquet(path)
    feed = spark.read.parquet(path)
    state = run_stream(spark, path, feed.schema, batch_bytes)
    decided = (feed.join(state, "digest")
               .withColumn("kept", F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("file") == F.col("keep.file")) & (F.col("at") == F.col("keep.at"))))
    differing = staged(different_bytes(source, decided, body), "exact-collisions")
    if not differing.isEmpty():
        decided = by_bytes(source, decided, differing, body)
    return Decisions(decided.select("id", "digest", "file", "at", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), "kept"),
                     source)


def run_stream(spark: SparkSession, path: str, feed: StructType, batch_bytes: int) -> DataFrame:
    """The final state of each digest: n, keep(id, file, at).

    Each batch writes the states that it changed to a folder of its own, which a
    repeated batch replaces; counts and kept ids only grow, so the largest is last.
    """
    schema = f"digest binary, n long, keep struct<id: {feed['id'].dataType.simpleString()}, file: string, at: long>"
    out = new_path(spark, "exact-state")
    stream = (spark.readStream.schema(feed).option("maxBytesPerTrigger", batch_bytes).parquet(path)
              .groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "file", "at")).alias("keep")))
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS,
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
                # one store a partition: space set aside for each would be most of what they take
                "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = (stream.writeStream.outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", new_path(spark, "exact-checkpoint"))
                 .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
                 .start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    changed = spark.read.schema(schema).parquet(out)
    return changed.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))


def different_bytes(source: DataFrame, decided: DataFrame, body: Column) -> DataFrame:
    """Digests of which some row's bytes are not those of the row that stays.

    Only rows of repeated digests carry their text on; a hot digest's rows are
    the side of the join that Spark splits, its kept row the side that is copied.
    """
    hits = decided.where("n > 1").select("digest", F.col("file").alias("__file"), F.col("at").alias("__at"), "kept")
    texts = source.select("__file", "__at", body.alias("body")).join(hits, ["__file", "__at"])
    first = texts.where("kept").select("digest", F.col("body").alias("kept_body"))
    return texts.where("NOT kept").join(first, "digest").where(F.col("body") != F.col("kept_body")).select("digest").distinct()


def by_bytes(source: DataFrame, decided: DataFrame, differing: DataFrame, body: Column) -> DataFrame:
    """Decide the rows of the digests in `differing` by their full text."""
    rows = decided.join(differing, "digest", "left_semi")
    texts = rows.select("id", "digest", "file", "at").join(
        source.select(F.col("__file").alias("file"), F.col("__at").alias("at"), body.alias("body")), ["file", "at"])
    groups = texts.groupBy("digest", "body").agg(F.count("*").alias("n"), F.max(F.struct("id", "file", "at")).alias("keep"))
    again = (texts.join(groups, ["digest", "body"])
             .withColumn("kept", F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("file") == F.col("keep.file")) & (F.col("at") == F.col("keep.at"))))
    columns = ["id", "digest", "file", "at", "n", "keep", "kept"]
    return decided.join(differing, "digest", "left_anti").select(columns).unionByName(again.select(columns))


def distinct_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns of `docs`."""
    found = dedup(docs, key, text)
    kept = found.rows.where("kept").select(F.col("file").alias("__file"), F.col("at").alias("__at"))
    return found.source.join(kept, ["__file", "__at"], "left_semi").select("row.*")
