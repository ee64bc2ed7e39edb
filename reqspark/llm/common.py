"""What the corpus operators share: tables, words, and the folder that all executors see."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and a word (as regular expressions of Java, RE2 and Python alike).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words in order; an empty array if there are none."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once for a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(values: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Where strings are cut into slices of up to size bytes; a longer string is a slice of its own."""
    ends, at = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, to
        at = to


def in_shuffles(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. Spark takes a table for as small as its compressed files, and does not count the
    rows that an explode makes: what it would broadcast as 10 MB can be hundreds in the driver."""
    return df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what is set as spark.checkpoint.dir. Outside local mode there must be one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/shared")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialise(df: DataFrame, release: bool = False, level: int = 3) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: this cuts the lineage, and a lost executor
    costs nothing that was written. The table goes when the driver's JVM ends. With release, Spark's cleaner gets to drop at
    once the shuffle files that only the written plan needed. level is that of zstandard."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    if release:
        for _ in range(2):  # the first lets go of the plan, the second of its files
            spark._jvm.System.gc()
            time.sleep(0.4)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise wrote, once nothing that will still be read is made of it."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
