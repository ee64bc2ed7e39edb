"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` documents; a slot of the mixture takes one block. With the exact weight w of
a source (its part of the sum), block i (from 1) is released at slot floor((i - 1) / w) and due by ceil(i / w). The earliest
deadline among released blocks goes first; at every slot each source then deviates from its weight by less than one block.
Weights are fractions, never rounded: their common denominator is the period after which the schedule repeats. One period
is scheduled, or all blocks if they are fewer, and a document's slot follows from its rank in its source by arithmetic. When a
source has no more blocks its slots stay empty or go to others whose blocks are released; every block keeps between its
release and its deadline. No row is dropped and every source, however many there are, has its own weight.

DataFrame functions only. The driver schedules: it holds a row a source and as many numbers as the shorter of the period and
all blocks (weights of few decimals, and the default ones, have short periods). A hot source is dealt over buckets of about
``bucket_rows`` rows by a hash of doc_id; a rank is the rows in earlier buckets plus the place within the bucket, so no task
sees a whole source.

Defined cases: a null source is a source; rows that repeat a doc_id keep a place each, in the order of hashes of whole rows
(equal rows are interchangeable); rows without a doc_id are dealt and ordered by those hashes; an empty table gives none; other
columns are kept in ``row``. Very long texts are only hashed.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: A schedule of up to so many numbers is broadcast (8 MB); a larger one is joined.
MAX_BROADCAST = 1_000_000


def exact_shares(weights: list[float | int | Fraction]) -> list[int]:
    """Whole numbers in exactly the proportion of positive weights; a float is the decimal number that it is written as."""
    exact = [Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("weights are positive")
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    divisor = math.gcd(*whole)
    return [a // divisor for a in whole]


def schedule(shares: list[int], blocks: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks, by earliest deadline among the released ones: of one period, or of all blocks
    if they are fewer."""
    total = sum(shares)
    count = shares if total <= sum(blocks) else blocks
    slots: list[list[int]] = [[] for _ in shares]
    waiting = [(0, k) for k in range(len(shares))]  # release of the next block, source
    ready: list[tuple[int, int]] = []  # deadline, source
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * total // shares[k]), k))
        deadline, k = heapq.heappop(ready)
        assert slot < deadline
        slots[k].append(slot)
        if len(slots[k]) < count[k]:
            heapq.heappush(waiting, (len(slots[k]) * total // shares[k], k))
        slot += 1
    return slots


def mix(docs: DataFrame, *, weights: dict[str | None, float] | None = None, block_rows: int = 16, bucket_rows: int = 4096) -> DataFrame:
    """row (the row of docs), doc_id, mixed_as (its source), block, slot, mix_position (long, ascending in the mixture). Without
    weights a source weighs the whole square root of its rows; a source that weights lack weighs as much as the least."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    sizes = rows.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("source")).collect()
    least = min(weights.values(), default=1) if weights else 1
    shares = exact_shares([weights.get(r["source"], least) if weights else math.isqrt(r["n"]) for r in sizes]) if sizes else []
    slots = schedule(shares, [-(-r["n"] // block_rows) for r in sizes])
    session = docs.sparkSession
    plan = [(r["source"], k, max(1, -(-r["n"] // bucket_rows)), len(x)) for k, (r, x) in enumerate(zip(sizes, slots))]
    plans = session.createDataFrame(plan, "mixed_as string, own int, buckets int, n_slots long")
    taken = session.createDataFrame([(k, i, slot) for k, x in enumerate(slots) for i, slot in enumerate(x)], "own int, turn long, at long")
    if sum(map(len, slots)) <= MAX_BROADCAST:
        plans, taken = F.broadcast(plans), F.broadcast(taken)
    # a row carries its source's number, never its slots; all that follows is dealt by (source, bucket), so rows move once
    rows = rows.join(plans, F.col("source").eqNullSafe(F.col("mixed_as")))
    key = ["own", "bucket"]
    rows = rows.withColumn("tie", F.xxhash64(*(F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind)))
    rows = rows.withColumn("hash", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.col("tie")))
    rows = rows.withColumn("bucket", F.pmod("hash", F.col("buckets")).cast("int"))
    before = Window.partitionBy("own").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("hash", "doc_id", "tie"))
    ranked = rows.withColumn("place", place).join(counts, key).withColumn("rank", F.col("first") + F.col("place") - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows)).withColumn("turn", F.col("block") % F.col("n_slots"))
    period = sum(shares) if shares and len(slots[0]) == shares[0] else 0  # all blocks are scheduled: none comes round again
    slot = F.floor(F.col("block") / F.col("n_slots")) * F.lit(period) + F.col("at")
    placed = ranked.join(taken, ["own", "turn"])
    return placed.select("row", "doc_id", "mixed_as", "block", slot.cast("long").alias("slot"), (slot * block_rows + F.col("rank") % block_rows).cast("long").alias("mix_position"))


def in_mixed_order(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs in the order of the mixture: partitions follow each other, rows are sorted within them."""
    return mix(docs, **how).select("mix_position", "row").repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", F.col("mixed_as").alias("source"), "block", "slot", "mix_position")
