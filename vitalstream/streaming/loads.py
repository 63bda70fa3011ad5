"""Incremental loads by Structured Streaming; the checkpoint is the cursor."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import keep_first
from ..sources.tables import COLUMNS, STREAMS

DROP = "record_key string, canonical_person_id string, event_time timestamp, value double"
LOADED = ", ".join(f"{c} {'timestamp_ntz' if c == 'event_time' else 'string'}" for c in COLUMNS if c != "stream")


def incremental(spark: SparkSession, drops: str, sink: str, checkpoint: str) -> None:
    """Append what is new below drops to the Parquet sink, then stop. A rerun without new files writes nothing."""
    rows = spark.readStream.schema(DROP).json(drops)
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Where a stream's state lies: in files of each task's own store with a bounded cache, not on the heap; a batch saves only what
#: it has changed.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state on disk; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    for k, v in ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replay_safe(spark: SparkSession, drops: str, tables: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Load drops so that a record key comes once, however often a drop is replayed.

    The hashes of the keys seen so far are the stream's state (16 bytes each, so a wrong hit is out of the question), dealt over
    the shuffle partitions, on disk, and kept with the checkpoint. So neither the heap nor a batch's work grows with what
    earlier batches loaded, and the sink commits each batch once. Rows without a key are one key.
    """
    key = F.coalesce("record_key", F.lit("\0"))
    rows = spark.readStream.schema(DROP).option("maxFilesPerTrigger", files_per_batch).json(drops)
    rows = rows.withColumn("h1", F.xxhash64(key)).withColumn("h2", F.xxhash64(F.reverse(key), F.length(key))).dropDuplicates(["h1", "h2"]).drop("h1", "h2")
    with state_on_disk(spark):
        rows.writeStream.format("parquet").option("path", tables).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_counts(spark: SparkSession, drops: str, out: str, checkpoint: str) -> DataFrame:
    """(day, rows) kept current: state is one row per day, and a batch writes the days that it has changed, no others.

    The table has a folder per day; a batch replaces the folders of its days, so doing it again after a failure gives the same.
    What is returned is the table, without rows where nothing has been loaded yet.
    """
    table = "day date, rows long"
    spark.createDataFrame([], table).write.mode("append").parquet(out)

    def put(batch: DataFrame, number: int) -> None:
        batch.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)

    rows = spark.readStream.schema(DROP).json(drops).where("event_time is not null")
    counts = rows.groupBy(F.window("event_time", "1 day").alias("w")).agg(F.count("*").alias("rows"))
    counts = counts.select(F.to_date("w.start").alias("day"), "rows")
    with state_on_disk(spark):
        counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(table).parquet(out).select("day", "rows")


def load_streams(rows: DataFrame, tables: str) -> None:
    """Append rows to a table per stream, created if absent: the first row of each record key that the table has not."""
    spark = rows.sparkSession
    columns = [c for c in COLUMNS if c != "stream"]
    for stream in STREAMS:
        path = f"{tables}/{stream}"
        spark.createDataFrame([], LOADED).write.mode("append").parquet(path)
        new = keep_first(rows.where(F.col("stream") == stream).select(*columns), "record_key", *[c for c in columns if c != "record_key"])
        old = spark.read.schema(LOADED).parquet(path)
        new.join(old.select("record_key"), "record_key", "left_anti").select(*columns).write.mode("append").parquet(path)


def loaded_streams(spark: SparkSession, tables: str) -> DataFrame:
    """The tables of load_streams() as one, with their stream."""
    first, *rest = [spark.read.schema(LOADED).parquet(f"{tables}/{s}").select(F.lit(s).alias("stream"), "*") for s in STREAMS]
    for df in rest:
        first = first.unionByName(df)
    return first
