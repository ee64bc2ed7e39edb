"""Near-duplicate vectors: exact links by cosine, from Int8 tile products with error bounds.

Vectors link when their labels are equal and not null and their cosine in double precision is at least ``threshold``.
A vector that is null, zero, or holds null or non-finite components links with nothing; so do vectors of other lengths.

Each vector is scaled to length 1 and quantised to Int8 with a scale of its own; the length e of what quantisation leaves
out is measured. Tiles of up to ``TILE`` vectors of one label are multiplied; as |x| = 1 and |y'| <= 1 + e_y, the true
cosine lies within e_y + (1 + e_y) e_x of the quantised one, so only pairs whose upper bound reaches the threshold are
computed again in double precision. Products of Int8 are exact in 32-bit floats up to 1,024 components; longer vectors are
multiplied in slices.

At scale: rows are range-partitioned and sorted by label and by a space-filling code of eight projections, so that a hot
label is spread over many tiles and a tile's vectors lie close together. Tiles are paired inside their label only, and a
pair of tiles goes when their boxes of projections are further apart than linked vectors can be. A pair of tiles gives
counts and a spanning forest of its links: at most four rows a vector, however many links there are.

Rows that repeat a vec_id are vectors of their own; a null vec_id takes part and never names a class of others. A pair whose cosine in
double precision equals the threshold links. An empty table gives no rows; columns beside vec_id, embedding and label are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import materialise, table
from .components import components

#: Vectors a tile, and projections of which a tile keeps its box.
TILE_BITS, AXES = 10, 8
TILE = 1 << TILE_BITS
#: More than what rounding in double precision can add to a bound.
SLACK = 1e-9


def axes(dim: int) -> np.ndarray:
    """AXES orthonormal directions (fewer for short vectors), the same on every executor."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, min(AXES, dim))))[0]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of length 1: Int8 rows, their scales, and the lengths of what is left out."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1) + SLACK


def possible_pairs(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which pairs of two quantised tiles may reach the threshold."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    dot = np.zeros((len(qa), len(qb)))
    for k in range(0, qa.shape[1], 1024):
        dot += qa[:, k : k + 1024].astype(np.float32) @ qb[:, k : k + 1024].astype(np.float32).T
    dot *= sa[:, None] * sb[None, :]
    return dot + eb[None, :] + ea[:, None] * (1 + eb[None, :]) >= threshold - SLACK


def links_of_tiles(x: np.ndarray, y: np.ndarray | None, threshold: float) -> np.ndarray:
    """Links between rows of x and y (of x and x, once each, if y is None) as a boolean matrix."""
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    ux = unit(x)
    uy = ux if y is None else unit(y)
    qx = quantise(ux)
    links = possible_pairs(qx, qx if y is None else quantise(uy), threshold)
    if y is None:
        links = np.triu(links, 1)
        y = x
    i, j = np.nonzero(links)
    for k in range(0, len(i), 1 << 16):
        a, b = x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]]
        cosine = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
        links[i[k : k + (1 << 16)], j[k : k + (1 << 16)]] = cosine >= threshold
    return links


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places (of a square matrix) that connect what its links connect."""
    links = links | links.T
    todo, out = links.any(axis=1), []
    while todo.any():
        root = int(np.argmax(todo))
        seen = np.zeros(len(links), bool)
        seen[root] = True
        edge = seen
        while edge.any():
            new = links[edge].any(axis=0) & ~seen
            seen |= new
            edge = new
        out += [(root, k) for k in np.flatnonzero(seen).tolist() if k != root]
        todo &= ~seen
    return out


def _prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, code, x (doubles as bytes; null if it links with nothing)."""

    def run(batches):
        for batch in batches:
            dims, codes, xs = [], [], []
            for v, label in zip(batch.column("v").to_pylist(), batch.column("label").to_pylist()):
                x = np.array(v, np.float64) if v and label is not None and None not in v else np.zeros(0)
                scale = np.abs(x).max(initial=0)
                if not scale or not np.isfinite(scale):
                    dims.append(None), codes.append(None), xs.append(None)
                    continue
                x = np.ldexp(x, -int(np.frexp(scale)[1]))  # the square of a length stays in range, and no bit is lost
                p = (x @ axes(len(x))) / np.linalg.norm(x)
                level = np.clip((p * np.sqrt(len(x)) * 0.35 + 0.5) * 16, 0, 15).astype(int)
                code = 0
                for bit in (3, 2, 1, 0):
                    for v_ in level:
                        code = code << 1 | int(v_) >> bit & 1
                dims.append(len(x)), codes.append(code), xs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(codes, pa.int64()), pa.array(xs, pa.binary())],
                ["vec_id", "label", "dim", "code", "x"],
            )

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, label string, dim int, code long, x binary")


def _tiles(rows: DataFrame) -> DataFrame:
    """tile, label, dim, vec_ids, x, low, high: whole tiles in the order of the code."""

    def run(batches):
        first, made, key, ids, xs = TaskContext.get().partitionId() << 22, 0, None, [], []

        def tile():
            x = np.frombuffer(b"".join(xs), np.float64).reshape(len(xs), -1)
            p = (x / np.linalg.norm(x, axis=1)[:, None]) @ axes(x.shape[1])
            row = [[first + made], [key[0]], [key[1]], [ids], [b"".join(xs)], [p.min(axis=0).tolist()], [p.max(axis=0).tolist()]]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["tile", "label", "dim", "vec_ids", "x", "low", "high"])

        for batch in batches:
            for vec_id, label, dim, x in zip(*(batch.column(k).to_pylist() for k in ("vec_id", "label", "dim", "x"))):
                if ids and (len(ids) == TILE or key != (label, dim)):
                    yield tile()
                    made, ids, xs = made + 1, [], []
                key = (label, dim)
                ids.append(vec_id)
                xs.append(x)
        if ids:
            yield tile()

    ordered = rows.repartitionByRange("label", "dim", "code").sortWithinPartitions("label", "dim", "code")
    return ordered.select("vec_id", "label", "dim", "x").mapInArrow(run, "tile long, label string, dim int, vec_ids array<long>, x binary, low array<double>, high array<double>")


def link_vectors(vectors: DataFrame, *, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row a row of vectors (columns vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    rows = materialise(_prepared(vectors))
    tiles = materialise(_tiles(rows.where("x IS NOT NULL")))
    reach = 2 - 2 * threshold + SLACK
    a, b = (tiles.select("label", "dim", *(F.col(c).alias(f"{c}_{k}") for c in ("tile", "low", "high"))) for k in "ab")
    gaps = F.zip_with(
        F.zip_with("low_a", "high_b", lambda x, y: F.greatest(F.lit(0.0), x - y)), F.zip_with("low_b", "high_a", lambda x, y: F.greatest(F.lit(0.0), x - y)), lambda x, y: x * x + y * y
    )
    near = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) <= reach
    pairs = a.join(b, ["label", "dim"]).where((F.col("tile_a") <= F.col("tile_b")) & near).select("tile_a", "tile_b", "dim")
    x = lambda k: tiles.select(F.col("tile").alias(f"tile_{k}"), F.col("x").alias(f"x_{k}"))
    pairs = pairs.join(x("a"), "tile_a").join(x("b"), "tile_b").select("tile_a", "tile_b", "dim", "x_a", "x_b")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tile_a, tile_b, dim, x_a, x_b = (batch.column(c)[k].as_py() for c in range(5))
                xa = np.frombuffer(x_a, np.float64).reshape(-1, dim)
                xb = None if tile_a == tile_b else np.frombuffer(x_b, np.float64).reshape(-1, dim)
                links = links_of_tiles(xa, xb, threshold)
                at, n = [(tile_a << TILE_BITS) + i for i in range(len(xa))], len(xa)
                counts = links.sum(axis=1)
                if xb is None:
                    counts, square = counts + links.sum(axis=0), links
                else:
                    at += [(tile_b << TILE_BITS) + i for i in range(len(xb))]
                    counts = np.concatenate([counts, links.sum(axis=0)])
                    square = np.zeros((len(at), len(at)), bool)
                    square[:n, n:] = links
                some = np.flatnonzero(counts).tolist()
                pairs_ = forest(square) if some else []
                columns = [
                    [at[i] for i in some] + [at[i] for i, _ in pairs_],
                    [None] * len(some) + [at[j] for _, j in pairs_],
                    [int(counts[i]) for i in some] + [0] * len(pairs_),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    found = materialise(pairs.mapInArrow(run, "a long, b long, n long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("at")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "at")
    placed = tiles.select("tile", F.posexplode("vec_ids").alias("k", "vec_id")).select((F.shiftleft("tile", TILE_BITS) + F.col("k")).alias("at"), "vec_id")
    linked = placed.join(counts, "at").join(roots, "at").select("at", "vec_id", "n_links", "root")
    least = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = linked.join(least, "root").select("at", "n_links", "component_id")
    out = placed.join(linked, "at", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where("x IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_vectors(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
