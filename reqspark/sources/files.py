"""Files of the pipeline: examples, chat rows, logs, case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.images import safe_name
from .sinks import file_name, write_named

#: Partitions over which the names of case tables are dealt, at least.
APART = 256
CHAT = "example_id long, messages array<struct<role:string,content:string,images:array<string>>>, metadata struct<requirement_id:long,quality_rating:int,annotation_notes:string,original_model:string,image_count:int,oracle_image_count:int>"
LOG = "event_id long, timestamp string, level string, session_id long, event_type string, value double"


def read_examples(spark: SparkSession, folder: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One JSON object a file, in any folder below; unreadable files are left out. Adds file."""
    rows = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(folder)
    return rows.withColumn("file", F.input_file_name()).where("_broken IS NULL").drop("_broken")


def read_chat(spark: SparkSession, path: str, lines: bool = True, schema: str = CHAT) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_logs(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    return spark.read.schema(schema).json(path).withColumn("ts", F.to_timestamp("timestamp"))


def read_open_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log records whose fields differ from event to event: ts, level, message, event_type, session_id, uptime_seconds, and the open parts
    extra and final_metrics as variants, and the whole record."""
    rows = spark.read.format("json").option("singleVariantColumn", "record").load(path)
    field = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind).alias(name)
    names = ["level", "message", "event_type", "session_id"]
    return rows.select(
        F.try_to_timestamp(F.try_variant_get("record", "$.timestamp", "string")).alias("ts"), *(field(n, "string") for n in names), field("uptime_seconds", "double"),
        field("extra", "variant"), field("final_metrics", "variant"), "record",
    )


def read_cases_csv(spark: SparkSession, path: str) -> DataFrame:
    """A case table of an earlier run: quoted cells may span lines; a byte-order mark goes."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def write_cases(table: DataFrame, folder: str, by: str, order: tuple[str, ...] = (), gzip: bool = False) -> None:
    """One CSV file for each value of by, called after it, its rows in order. A null value's rows go to a file called unknown. With gzip
    it is compressed, and its name ends in .csv.gz: a case table is mostly fixed values. One task writes a file; names are dealt over so
    many partitions that few share one."""
    columns = [c for c in table.columns if c != by]
    line = F.concat(F.to_csv(F.struct(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns)), {"quoteAll": "true", "escape": '"'}), F.lit("\n"))
    name = file_name(F.coalesce(F.col(by).cast("string"), F.lit("unknown")), ".csv.gz" if gzip else ".csv")
    rows = table.select(name.alias("name"), line.alias("content"), *(F.col(f"`{c}`").alias(f"order_{k}") for k, c in enumerate(order)))
    rows = rows.repartition(max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), APART), "name").sortWithinPartitions("name", *(f"order_{k}" for k in range(len(order))))
    head = ",".join('"' + c.replace('"', '""') + '"' for c in columns) + "\n"
    write_named(rows.select("name", "content"), folder, head=head, gzip=str(gzip).lower())


def write_chat(chat: DataFrame, folder: str) -> None:
    if chat.isEmpty():
        raise ValueError("there are no chat rows to write")
    chat.write.json(folder)


def write_examples(examples: DataFrame, folder: str) -> None:
    """JSON, a folder for each status."""
    examples.write.partitionBy("status").json(folder)


def write_images(images: DataFrame, folder: str) -> None:
    """source_file, seq, name, content as image files, a folder for each archive. Of images that get the same name the last one stays:
    the last place of each name is found first, so that no others are written."""
    name = F.concat_ws("/", file_name(F.col("source_file")), safe_name(F.col("name")))
    rows = images.select(name.alias("name"), "content", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("place"))
    last = rows.groupBy("name").agg(F.max("place").alias("place"))
    write_named(rows.join(last, ["name", "place"], "left_semi").select("name", "content", "place"), folder, whole="true")
