"""Token ids as bit planes: a chunked, indexed, compressed table of ids in the order of documents.

Writing: documents are range-partitioned and sorted by doc_id; each partition is a shard and is encoded as a stream. Whole
documents are gathered into chunks of about ``chunk_ids`` ids. Inside a chunk, blocks of ``block`` ids are transposed into
bit planes (plane p holds bit p of every id; only as many planes as the largest id needs) or byte planes, and each plane is
compressed with zstandard. A chunk is one row of a Parquet table without further compression; all its columns but
``payload`` are the chunk index (shard, chunk, ids before it in its shard, its documents and their lengths), which can be
read alone. Spark's committed writes make the files; a lost task is written again.

Payload: ``PLNS``, then little-endian unsigned 32-bit integers: bits a plane (1 or 8), ids a block, ids, frames; the length
of each frame; the frames, block after block, lowest plane first. A block's first 32-bit integer in the frame table is its
number of planes.

Reading decodes chunks one by one; where a shard starts is summed from the index (one row a shard).

Defined cases: a null text is empty and has the end id alone; a null doc_id sorts first; rows that repeat a doc_id keep a
row each; a text of more ids than a chunk is a chunk of its own; an empty table writes an empty table; other columns are not
looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import shared_dir, table, whole_text
from .tokens import default_vocabulary, encoder, runs

MAGIC = b"PLNS"
CHUNK_SCHEMA = "shard int, chunk int, start_in_shard long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _planes(ids: np.ndarray, bits: int) -> list[bytes]:
    count = max(1, -(-int(ids.max(initial=0)).bit_length() // bits))
    if bits == 8:
        return [((ids >> (8 * p)) & 255).astype(np.uint8).tobytes() for p in range(count)]
    return [np.packbits(((ids >> p) & 1).astype(np.uint8), bitorder="little").tobytes() for p in range(count)]


def pack_ids(ids: np.ndarray, block: int = 1 << 16, bits: int = 1) -> bytes:
    """The payload of a chunk."""
    compress = zstandard.ZstdCompressor(level=1).compress
    table_, frames = [], []
    for at in range(0, len(ids), block):
        made = [compress(p) for p in _planes(ids[at : at + block].astype(np.uint32), bits)]
        table_ += [len(made), *map(len, made)]
        frames += made
    head = struct.pack("<4I", bits, block, len(ids), len(table_))
    return MAGIC + head + np.array(table_, "<u4").tobytes() + b"".join(frames)


def unpack_ids(payload: bytes) -> np.ndarray:
    """The ids of a chunk."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    bits, block, n, size = struct.unpack_from("<4I", payload, 4)
    lengths = np.frombuffer(payload, "<u4", size, 20).tolist()
    decompress = zstandard.ZstdDecompressor().decompress
    out, at, k = np.zeros(n, "<u4"), 20 + 4 * size, 0
    for start in range(0, n, block):
        part = out[start : start + block]
        planes = lengths[k]
        for p in range(planes):
            raw = np.frombuffer(decompress(payload[at : at + lengths[k + 1 + p]]), np.uint8)
            values = np.unpackbits(raw, count=len(part), bitorder="little") if bits == 1 else raw
            part |= values.astype(np.uint32) << np.uint32(p * bits)
            at += lengths[k + 1 + p]
        k += planes + 1
    return out


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and whole text, range-partitioned and sorted by doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text").cast("string")).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")


def write_ids(docs: DataFrame, path: str, *, vocabulary: str, end_id: int, chunk_ids: int = 1 << 20, block: int = 1 << 16, bits: int = 1) -> None:
    """Encodes docs in ascending doc_id order, with end_id after each, into the table at path."""
    ship(docs.sparkSession)

    def run(batches):
        shard, start = TaskContext.get().partitionId(), 0
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["shard", "chunk", "start_in_shard", "n_ids", "doc_ids", "lengths", "payload"]
        for chunk, (doc_ids, ids, lengths) in enumerate(runs(batches, encoder(vocabulary), end_id, chunk_ids)):
            row = [[shard], [chunk], [start], [len(ids)], [doc_ids], [lengths.tolist()], [pack_ids(ids, block, bits)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names)
            start += len(ids)

    in_order(docs).mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids (binary, little-endian unsigned 32-bit
    integers) unless only their checksum is wanted."""
    ship(spark)
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_ids(row["payload"]).tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - np.array(row["lengths"])
                raw = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                out = [
                    pa.array([row["shard"]] * len(raw), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["start_in_shard"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ]
                names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    docs = chunks.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    # One row a shard, and there are as many shards as the writer had partitions: small by construction.
    docs = docs.join(F.broadcast(shards), "shard")
    return docs.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, vocabulary=default_vocabulary(), end_id=2)
    return read_ids(spark, path, with_ids=False)
