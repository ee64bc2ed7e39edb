"""Structured Streaming jobs: live log counters, and a collection that counts each example once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def session_windows(spark: SparkSession, source: str, schema, width: str = "1 hour", late: str = "10 minutes", files: int | None = None) -> DataFrame:
    """window_start, event_type, level, n: counts by tumbling window over what is at source now. A batch hands on only the windows
    that it changed, windows before the watermark leave the state, and rows that come later than that are dropped. The target
    holds every version of a window by batch; the latest one counts."""
    out = _folder(spark, "windows")
    reader = spark.readStream.schema(schema)
    logs = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    logs = logs.withColumn("level", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"))
    counts = logs.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type", "level").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "level", "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out).groupBy("window_start", "event_type", "level").agg(F.max_by("n", "batch").alias("n"))


@contextmanager
def _states_on_disk(spark: SparkSession) -> Iterator[None]:
    """Keys of a stream that are remembered forever belong in RocksDB, not in the executors' heaps."""
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _once(spark: SparkSession, source: str, schema, key: str, files: int, form: str) -> DataFrame:
    """The stream of what is at source, each key once: the state knows which keys have come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(source).dropDuplicates([key])


def collect_once(spark: SparkSession, source: str, schema, key: str, files: int = 1, form: str = "parquet", out: str | None = None) -> DataFrame:
    """The rows at source, each key once. A batch of so many files reads its files and the state of its keys, nothing else, so its work
    doesn't grow with what came before; a batch that runs again overwrites its own folder. With out, a later call goes on where the
    last one ended."""
    out = out or _folder(spark, "collection")

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _states_on_disk(spark):
        rows = _once(spark, source, schema, key, files, form)
        rows.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def running_stats(spark: SparkSession, source: str, schema, key: str, stats: Callable[[DataFrame], DataFrame], files: int = 1, form: str = "parquet", out: str | None = None) -> DataFrame:
    """batch and the columns of stats (one row of aggregates of a table) after each batch, over all rows at source so far, each key
    once. Sums are kept in the state, and a batch adds its own rows to them. With out, a later call goes on."""
    out = out or _folder(spark, "stats")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _states_on_disk(spark):
        rows = stats(_once(spark, source, schema, key, files, form))
        rows.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out)
