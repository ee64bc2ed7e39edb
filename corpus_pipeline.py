"""The corpus pipeline: documents to packed sequences, five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return rows of documents with their columns.
What a stage wrote is deleted once the next one is written.
The order of the mixture is that of the files' numbers and of the rows within them. Spark reads files by their size, so packing
restores that order first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqspark.llm import line_dedup, mixing, packing, quality_rules, simhash
from reqspark.llm.common import discard, materialise, table
from reqspark.llm.tokens import default_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one; n_chars counts the new text."""
    out = line_dedup.drop_repeated_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixing.in_mixed_order(docs)


def as_written(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of written documents, by number of the file and row within it: partitions follow each other."""
    name, order = F.col("_metadata.file_name"), ["number", "file", "row"]
    number = F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long")
    rows = docs.select("doc_id", "text", number.alias("number"), name.alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, in the order in which the documents were written."""
    return packing.pack(as_written(docs), vocabulary=default_vocabulary(), by_doc_id=False)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixture),
    ("packing", packed),
]

#: Tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), release=True)
        discard(*used)
        used = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
