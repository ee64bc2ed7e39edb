"""Hard negatives for contrastive training, by slots of scores.

Vectors become integers, floor(scale * x); a row's score is its integer inner product with the anchor. An anchor's positives are
its first ``positives`` other rows of the same label. A negative of a positive of score p is a row of another label with
low * p <= 100 * score <= high * p; the first ``negatives`` of them are returned. Higher scores come first, ties by smaller vec_id.

Slots: the different upper limits of an anchor's positives, in order, split the scores into slots, and each window of an
anchor is a run of slots cut at its lower limit. Tiles of anchors meet tiles of rows; each pair of tiles gives the first
``negatives`` rows of each slot, and Spark's window group limit combines them before and after the one shuffle by (anchor,
slot). Merging the slots from the lowest up gives the first rows at or under every upper limit, so overlapping windows share all
the work. A window takes those of its highest slot that reach its lower limit.

At scale: rows are range-partitioned by label and cut into tiles of ``TILE`` rows; anchors likewise. The tiles of rows are dealt
in turn over groups, and each group gets every tile of anchors once, so that a hot label is spread like any other and no
task holds more than two tiles. Pairs of tiles without a common label are left out for positives, those of one label for
negatives. What leaves a pair of tiles is at most slots * negatives rows an anchor. Work grows with rows times anchors, which
the task states.

Defined cases: a row with a null label, a null or empty vector, or any null or non-finite component takes no part, neither does
one whose integers have a squared length of 2^62 or more, as its scores may not fit a long. Vectors of different lengths have no
score. Rows that repeat a vec_id are rows of their own (ties by their order after that); a null vec_id comes last among
ties. Anchors without positives or negatives give no rows. Empty tables give none. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import materialise, table

#: Rows and anchors a tile; tiles of rows a group.
TILE, ANCHORS, GROUP = 4096, 1024, 8
#: Below this squared length, products of doubles are exact.
EXACT = 2.0**53
_LAST = np.iinfo(np.int64).max


def _integers(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, label, anchor, dim, size (squared length), q (64-bit integers as bytes): the rows that take part."""

    def run(batches):
        for batch in batches:
            kept, dims, sizes, qs = [], [], [], []
            for i, v in enumerate(batch.column("v").to_pylist()):
                if not v or None in v:
                    continue
                q = np.floor(scale * np.array(v, np.float64))
                size = float(np.square(q).sum())
                if size < 2.0**62:  # false for what isn't a number
                    kept.append(i), dims.append(len(v)), sizes.append(size), qs.append(q.astype(np.int64).tobytes())
            rows = batch.select(["vec_id", "label", "anchor"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(dims, pa.int32()), pa.array(sizes, pa.float64()), pa.array(qs, pa.binary())], [*rows.schema.names, "dim", "size", "q"])

    return vectors.mapInArrow(run, "vec_id long, label string, anchor boolean, dim int, size double, q binary")


def _packed(q: list[bytes], largest: float) -> bytes:
    """Integers in as few bytes as their squared length needs."""
    return np.frombuffer(b"".join(q), np.int64).astype(f"i{2 if largest < 2.0**30 else 4 if largest < 2.0**62 / 4 else 8}").tobytes()


def _unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (rows * dim)}").reshape(rows, dim)


def _tiles(rows: DataFrame, size: int) -> DataFrame:
    """tile, dim, least, most (of labels), largest, ats, vec_ids, labels, limits (lists a row), lows, q: rows in the order of labels."""
    schema = "tile long, dim int, least string, most string, largest double, ats array<long>, vec_ids array<long>, labels array<string>, limits array<array<long>>, lows array<long>, q binary"
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), *(pa.list_(x) for x in (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64())), pa.binary()]

    def run(batches):
        first, made, held = TaskContext.get().partitionId() << 32, 0, []

        def tile():
            ats, vec_ids, labels, limits, lows, dims, sizes, qs = map(list, zip(*held))
            row = [first + made, dims[0], min(labels), max(labels), max(sizes), ats, vec_ids, labels, limits, lows, _packed(qs, max(sizes))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        names = "tile dim least most largest ats vec_ids labels limits lows q".split()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("at", "vec_id", "label", "limits", "low", "dim", "size", "q"))):
                if held and (len(held) == size or held[0][5] != row[5]):
                    yield tile()
                    made, held = made + 1, []
                held.append(row)
        if held:
            yield tile()

    ordered = rows.withColumn("deal", F.xxhash64("at"))
    return ordered.repartitionByRange("dim", "label", "deal").sortWithinPartitions("dim", "label", "deal").mapInArrow(run, schema)


def _best(scores: np.ndarray, places: np.ndarray, ids: np.ndarray, ats: np.ndarray, k: int) -> np.ndarray:
    """The first k of places: by score downwards, then id, then row."""
    if len(places) > k:
        s = scores[places]
        places = places[s >= np.partition(s, -k)[-k]]
    return places[np.lexsort((ats[places], ids[places], -scores[places]))[:k]]


def _first(tiles: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor, slot, row, vec_id, score: the first k rows of each slot of an anchor; without limits all scores are one slot."""
    n = tiles.count()
    groups = max(1, -(-n // GROUP), min(n, tiles.sparkSession.sparkContext.defaultParallelism))
    a = tiles.withColumn("deal", F.pmod(F.xxhash64("tile"), F.lit(groups)))
    b = anchors.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    b = b.select("dim", "deal", *(F.col(c).alias(f"a_{c}") for c in ("least", "most", "largest", "ats", "labels", "limits", "lows", "q")))
    meet = (F.col("least") <= F.col("a_most")) & (F.col("a_least") <= F.col("most"))
    pairs = a.join(b, ["dim", "deal"]).where(meet if same else ~((F.col("least") == F.col("most")) & (F.col("a_least") == F.col("a_most")) & (F.col("least") == F.col("a_least"))))

    def run(batches):
        for batch in batches:
            for p in batch.to_pylist():
                ats, labels, dim = np.array(p["ats"]), np.array(p["labels"], object), p["dim"]
                ids = np.array([_LAST if x is None else x for x in p["vec_ids"]])
                exact = p["largest"] * p["a_largest"] < EXACT * EXACT
                x, y = (_unpacked(q, n, dim).astype(np.float64 if exact else np.int64) for q, n in ((p["q"], len(ats)), (p["a_q"], len(p["a_ats"]))))
                scores = (y @ x.T).astype(np.int64)
                out = []
                for i, (at, label, limits, low) in enumerate(zip(p["a_ats"], p["a_labels"], p["a_limits"], p["a_lows"])):
                    s = scores[i]
                    if same:
                        slots = [np.flatnonzero((labels == label) & (ats != at))]
                    else:
                        open_ = np.flatnonzero((s >= low) & (s <= limits[0]) & (labels != label))
                        ends = [*limits[1:], low - 1]
                        slots = [open_[(s[open_] <= top) & (s[open_] > end)] for top, end in zip(limits, ends)] if len(open_) else []
                    for slot, places in enumerate(slots):
                        out += [(at, slot, int(ats[j]), None if ids[j] == _LAST else int(ids[j]), int(s[j])) for j in _best(s, places, ids, ats, k)]
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["anchor", "slot", "row", "vec_id", "score"])

    names = ["dim", "ats", "vec_ids", "labels", "largest", "q", *(f"a_{c}" for c in ("largest", "ats", "labels", "limits", "lows", "q"))]
    found = pairs.select(*names).mapInArrow(run, "anchor long, slot int, row long, vec_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "row"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, *, scale: float = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors says which rows of vectors
    (columns vec_id, label, embedding) are anchors."""
    ship(vectors.sparkSession)
    rows = vectors.where("label IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("v")
    )
    rows = materialise(_integers(rows, scale).withColumn("at", F.monotonically_increasing_id()))
    free = {"limits": F.lit(None).cast("array<long>"), "low": F.lit(None).cast("long")}
    tiles = materialise(_tiles(rows.withColumns(free), TILE))
    asked = rows.where("anchor")
    near = materialise(_first(tiles, _tiles(asked.withColumns(free), ANCHORS), positives, True))

    windows = near.select("anchor", "row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hundredths = lambda p: F.col("positive_score").cast("decimal(19,0)") * p / 100
    windows = windows.withColumns({"top": F.floor(hundredths(high)).cast("long"), "bottom": F.ceil(hundredths(low)).cast("long")}).where("bottom <= top")
    limits = windows.groupBy(F.col("anchor").alias("at")).agg(F.sort_array(F.collect_set("top"), asc=False).alias("limits"), F.min("bottom").alias("low"))
    limited = materialise(asked.join(limits, "at"))
    first = _first(tiles, _tiles(limited, ANCHORS), negatives, False)

    # from the lowest slot up: what comes first at or under each slot's upper limit
    held = first.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("rows"))
    held = held.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "rows")), asc=False).alias("slots"))
    none = F.array().cast("array<struct<slot:int,best:array<struct<rank:int,vec_id:bigint,score:bigint>>>>")
    below = lambda acc: F.when(F.size(acc) > 0, F.element_at(acc, -1)["best"]).otherwise(F.array().cast("array<struct<rank:int,vec_id:bigint,score:bigint>>"))
    merged = F.aggregate("slots", none, lambda acc, x: F.concat(acc, F.array(F.struct(x["slot"].alias("slot"), F.slice(F.concat(x["rows"], below(acc)), 1, negatives).alias("best")))))
    held = held.select("anchor", merged.alias("merged"))

    named = limited.select(F.col("at").alias("anchor"), F.col("vec_id").alias("anchor_id"), "limits")
    out = windows.join(named, "anchor").join(held, "anchor")
    slot = F.array_position("limits", F.col("top")) - 1
    # slots without rows are missing: the highest at or under the window's upper limit tells
    reach = F.filter("merged", lambda m: m["slot"] >= slot)
    best = F.filter(F.element_at(reach, -1)["best"], lambda r: r["score"] >= F.col("bottom"))
    out = out.where(F.size(reach) > 0).select("anchor_id", "positive_id", "positive_score", F.posexplode(best).alias("k", "negative"))
    return out.select(
        "anchor_id", "positive_id", (F.col("k") + 1).alias("rank"), F.col("negative.vec_id").alias("negative_id"), "positive_score", F.col("negative.score").alias("negative_score")
    )


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
