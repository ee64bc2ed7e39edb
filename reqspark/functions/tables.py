"""Tables written between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """What is set as spark.checkpoint.dir; outside local mode there must be one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table: this cuts the lineage, and a lost executor costs nothing that was written. The table goes when
    the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Spark's cleaner drops the shuffle files that only plans that have ended needed, not when the driver happens to collect its garbage."""
    for _ in range(2):  # the first lets go of the plan, the second of its files
        spark._jvm.System.gc()
        time.sleep(0.3)


def session_with(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same context with the settings of spark and these, which then hold for what is made and written of its
    DataFrames; those of spark stay as they are."""
    out = spark.newSession()
    for k, v in (spark.conf.getAll | settings).items():
        if out.conf.get(k, None) != v:
            out.conf.set(k, v)
    return out


#: Rows a partition, about.
EACH = 250_000


def partitions_for(spark: SparkSession, rows: int, each: int = EACH) -> int:
    """The session's number of shuffle partitions, or as many more as leave a partition no more than about each rows: what a task holds
    then doesn't grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column name of value, which is evaluated once a row: later filters and columns that use it refer to the result, where
    the plain column's expression would be copied into each of them."""
    return df.select("*", F.explode(F.array(value)).alias(name))
