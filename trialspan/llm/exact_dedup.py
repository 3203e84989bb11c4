"""Exact deduplication as a stateful stream.

Every document arrives on a stream as (digest, id, code points, locator). The state is keyed by digest, lives
on disk (RocksDB) and has no expiry; it retains the row that stays, its stable id, the locator of its content
and the number of rows seen. Each micro-batch appends the keys it touched to an update log, which replays to
the same files after a failure. On hits the full bytes are compared; should two texts share a digest, the run
is repeated with the whole text as key.

Defined cases: a null text is empty; empty texts are equal to one another; rows that repeat an id each get a
row, count in ``group_size``, and only one of them is ``kept``; a null id loses ties; an empty table gives an
empty result; columns other than the id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import SPACES, folder, join_counted, no_space, read, small, stored

STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: each would reserve some MB on disk for its logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def whole_text(text: Column) -> Column:
    return text


def arrivals(docs: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> DataFrame:
    """What arrives for each row: state key, position, id, code points, content locator, digest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(key(no_space(text)).alias("key"), F.monotonically_increasing_id().alias("pos"),
                       F.col(id_col).alias("doc_id"), F.length(text).alias("n"),
                       F.input_file_name().alias("locator"), F.sha2(no_space(text), 256).alias("text_sha256"))


def update_log(spark: SparkSession, source: str, schema, max_bytes: int) -> DataFrame:
    """Run the stream over the arrivals in ``source`` to its end; the log has each key's state after each batch."""
    shared_dir(spark)
    log, own = folder(spark, "state-log"), spark.newSession()
    for k, v in {**STATE, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos",
                          "locator"))
    state = (own.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(source)
             .groupBy("key").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    empty = own.createDataFrame([], state.schema)
    empty.write.parquet(f"{log}/batch=-1")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = (state.writeStream.outputMode("update").foreachBatch(append)
             .option("checkpointLocation", folder(spark, "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(empty.schema.add("batch", "long")).parquet(log)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 64 << 30,
                keys: tuple[Callable[[Column], Column], ...] = (sha256, whole_text)) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting white space. Of equal texts the row with the most code points
    stays, then the smallest id. ``max_bytes`` bounds a micro-batch of arrivals.
    """
    spark = docs.sparkSession
    for key in keys:
        path = folder(spark, "arrivals")
        narrow = arrivals(docs, id_col, text_col, key)
        narrow.write.parquet(path)
        rows = spark.read.schema(narrow.schema).parquet(path)
        state = stored(update_log(spark, path, narrow.schema, max_bytes).groupBy("key")
                       .agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s"))
                       .select("key", F.col("s.best.doc_id").alias("keep_id"), F.col("s.best.pos").alias("keep_pos"),
                               "s.group_size"), "state-end")
        told = stored(join_counted(rows, state, "key", "group_size", rows.count()), "told")
        if key is whole_text or same_bytes(docs, told, id_col, text_col, key):
            break
    return told.select("doc_id", "keep_id", "group_size", (F.col("pos") == F.col("keep_pos")).alias("kept"),
                       "text_sha256")


def same_bytes(docs: DataFrame, told: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> bool:
    """Whether all rows of each key have the same bytes; only the texts of keys with hits are read."""
    hits = told.where("group_size > 1").select("key", F.col("doc_id").alias("__id")).distinct()
    text = no_space(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("__id"), text.alias("t")).select("__id", "t", key(F.col("t")).alias("key"))
    found = texts.alias("a").join(small(hits).alias("b"), (F.col("a.key") == F.col("b.key"))
                                  & F.col("a.__id").eqNullSafe(F.col("b.__id")), "left_semi")
    # least and greatest text of a key: equal only if all are; large groups shrink before the shuffle
    unlike = found.groupBy("key").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi")
    return unlike.isEmpty()


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of those that repeat an id and text."""
    told = exact_dedup(docs, id_col, text_col)
    gone = told.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    twice = told.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("k")).where("n > 1 and k")
    sha = F.sha2(no_space(F.coalesce(F.col(text_col), F.lit(""))), 256)
    match = F.col(id_col).eqNullSafe(F.col("__id")) & (sha == F.col("__sha"))
    if twice.isEmpty():
        return docs.join(small(gone), match, "left_anti")
    twice = twice.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    out = docs.join(small(gone.unionByName(twice)), match, "left_anti")
    again = docs.join(small(twice), match, "left_semi")
    return out.unionByName(again.withColumn("__sha", sha).dropDuplicates([id_col, "__sha"]).drop("__sha"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


_BARE = f"translate(coalesce(text, ''), {' || '.join(f'chr({ord(c)})' for c in SPACES)}, '')"
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op10_exact_dedup": f"""
with d as (select doc_id, length(coalesce(text, '')) n, sha256({_BARE}) text_sha256 from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by text_sha256) group_size,
  doc_id = first_value(doc_id) over w kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id)"""}
