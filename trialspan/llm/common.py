"""Small helpers of this subpackage: stored intermediate tables, size-checked and skew-safe joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

# Rows of a side that every executor may hold; the sides broadcast here have a few narrow columns.
BROADCAST_ROWS = 500_000
# A key is heavy when it has more than one in SHARE rows, so there are fewer than SHARE heavy keys.
SHARE = 1000
# White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow tasks exchange whole texts in smaller batches than Spark's 10,000 rows, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Let the shuffle files of each query that runs inside go when it is over, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if it has at most ``rows`` rows; otherwise Spark shuffles the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join to a table with one row per key that also counts the left rows of each key.

    Keys with over ``total / SHARE`` rows (fewer than SHARE of them) are broadcast, so their rows stay where
    they are; in the shuffled join their key is replaced by a spread one that matches nothing. ``right`` must
    be stored, for it is read twice. Null keys match nothing.
    """
    cols = [c for c in right.columns if c != key]
    bar = total // SHARE
    heavy = F.broadcast(right.where(F.col(count) > bar).select(
        F.col(key).alias("__hk"), F.struct(*cols).alias("__h")))
    light = right.where(F.col(count) <= bar).select(F.col(key).alias("__lk"), F.struct(*cols).alias("__l"))
    out = left.join(heavy, F.col(key) == F.col("__hk"), "left")
    out = out.withColumn("__j", F.when(F.col("__hk").isNull() & F.col(key).isNotNull(), F.xxhash64(key)).otherwise(
        F.xxhash64(F.rand(7))))
    light = light.withColumn("__jl", F.xxhash64("__lk"))
    out = out.join(light, (F.col("__j") == F.col("__jl")) & (F.col(key) == F.col("__lk")) & F.col("__hk").isNull(), "left")
    return out.select(*[f"`{c}`" for c in left.columns],
                      *[F.coalesce(F.col("__h")[c], F.col("__l")[c]).alias(c) for c in cols])


def no_space(text: Column) -> Column:
    """The text without its white space."""
    return F.translate(text, SPACES, "")


def numbered(df: DataFrame, order: list[Column], name: str, out: str = "at") -> DataFrame:
    """A stored copy whose column ``out`` counts the rows from 0 in the order given, whatever keys are frequent.

    Sort ranges are spread over tasks; a table with one row per range says how many rows come before it. Rows that
    tie in ``order`` are numbered in any order, the same one at every later read.
    """
    cut = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("__m", F.monotonically_increasing_id()), name)
    part = F.shiftright("__m", 33)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # no more rows than shuffle partitions
    starts = cut.groupBy(part.alias("__p")).count().select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))
    return cut.join(F.broadcast(starts), part == F.col("__p")).withColumn(
        out, F.col("__s") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__s")
