"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "textward", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this package relies on.

    Adaptive execution splits skewed joins and merges small partitions; UTC
    makes timestamps comparable; the byte limits keep scan tasks and Arrow
    batches small although single texts may have 100 MB.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "32m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.driver.extraJavaOptions": "-Xss8m",
        "spark.executor.extraJavaOptions": "-Xss8m",
        # call-site capture costs more than building the plans here
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session, which has no other executors, gets one of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="textward-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: bytes of files that one task is to clean at most, on average
TASK_BYTES = 16 << 20
#: Spark states a size beyond this for plans whose size it does not know
UNKNOWN_SIZE = 1 << 60


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that yields too few tasks one per core at least, and one per ``TASK_BYTES`` of its files.

    Cleaning text costs far more than moving it, and a file with one row group
    is read by one task however large it is.  Scans of enough tasks
    are returned as they are.  Call this on a plain scan, or on a batch of a stream, whose size is
    not known to Spark: it gets one task per core.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = -(-size // TASK_BYTES) if size < UNKNOWN_SIZE else 1
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, tasks)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
