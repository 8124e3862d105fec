"""Positions inside groups of any size, and joins that bear hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import new_path


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add the position (1, 2, ...) of each row in its group; NULL keys are one group, order columns may have any type.

    A window over the group alone would sort a hot group in one task.  Here the
    rows are range-partitioned once by group and order, which cuts a hot group
    into as many ranges as it needs.  Rows are numbered where they lie; the
    sizes of a group's earlier ranges, a row per group and range, are added.
    The order columns should tell all rows of a group apart.

    The numbered rows are written to the shared folder at once: two runs of one
    range partitioning draw other bounds, so sizes of one would not fit the other.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__range", F.shiftright("__id", 33))
    path = new_path(spark, "ranged")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    sizes = ranged.groupBy(*keys, "__range").agg(F.min("__id").alias("__low"), F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"),
                          (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__low") + 1).alias("__shift"))
    on = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    drop = [f"__k{i}" for i in range(len(keys))]
    return ranged.join(shifts, on).withColumn(out, F.col("__id") + F.col("__shift")).drop(*drop, "__id", "__range", "__r", "__shift")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 16,
                salt: Column | None = None) -> DataFrame:
    """Join a large table with one that has few rows per key.

    The small side is repeated once per salt, so that a key that holds a third
    of the large table is spread over several partitions.  (Spark still turns
    this into a broadcast join where its own size check allows it.)
    """
    many = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many = many.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in many.columns if c not in keys])
    many = many.withColumnRenamed("__salt", "__s")
    if salt is None:  # any spread will do; the row's place in its task costs nothing
        salt = F.monotonically_increasing_id()
    on = F.col("__salt") == F.col("__s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (big.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
            .join(many, on, how).drop("__salt", "__s", *[f"__k{i}" for i in range(len(keys))]))
