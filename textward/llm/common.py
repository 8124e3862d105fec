"""Helpers of the operators in this folder."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

#: a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` below the shared folder and read it back.

    This cuts the lineage: what follows reads files that all executors see, so
    a lost executor costs its own tasks only.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by `staged` that nothing reads any more: whatever was made of it must be written."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark deletes them once the driver's garbage collection finds that nothing
    refers to them, which otherwise may be long after the table that was made of
    them is written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def missing_columns(df: DataFrame, *names: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}; there are {', '.join(df.columns)}")


def held_out(doc_id: str) -> Column:
    """True for one document in five, by CRC-32 of its id as text; a NULL id counts as empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
