"""SimHash near-duplicates, compared by bit planes.

Each text becomes a fingerprint of 64 or 128 bits: every shingle of ``words`` words (repeats included) is hashed with
seed 42 (XXH64, or XXH3 for 128 bits), and a bit of the fingerprint is set if it is set in over half of the hashes.
Texts link when their fingerprints differ in at most ``radius`` bits; classes are the connected components.

Finding links: equal fingerprints are one node. The bytes of a fingerprint are cut into ``bands``; each node goes to one
block for each pair of bands. With radius + 2 bands or more, two fingerprints within the radius agree on at least two
bands, so no link is lost; with fewer bands and a wide radius, a link is found with the chance that two bands agree.
Within a block the fingerprints stand vertically, one long integer for each bit plane. A member's distances to all
others are counted at once by carry-save adders on these integers, plane after plane, and the block is abandoned for
this member once all counts exceed the radius. A block gives a spanning forest of its links, never all pairs.

Skew: copies collapse into a node before anything is paired. A block of over ``max_block`` nodes is cut again by its other
bands: by pairs of single bytes for an exact radius, which leaves at most 2^16 different fingerprints of 64 bits.

Defined cases: a text of fewer words than a shingle is one shingle; a null or empty text, or one without words, has
fingerprint 0 and links like any other; repeated doc_ids keep a row each; an empty table gives no rows; a very long text is hashed
whole, in chunks of shingles; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import LOWER, UPPER, discard, in_shuffles, materialise, table
from .components import components
from .shingle_sets import similar_documents

SEED = 42
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Hashes whose bits are counted at once.
_CHUNK = 1 << 15
#: Blocks of so many members are compared many at once, larger ones alone.
SMALL = 64


def fingerprint(text: bytes, words: int = 3, bits: int = 64) -> bytes:
    """SimHash of a UTF-8 text, big-endian."""
    parts = text.translate(_TO_LOWER).split()
    if not parts:
        return bytes(bits // 8)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    counts, at = np.zeros(bits, np.int64), ends[min(words, len(parts)) - 1 :].tolist()
    for k in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK], at[k : k + _CHUNK])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fp)."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = [fingerprint(t or b"", words, bits) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def links_of_block(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among members (different fingerprints, a row of bytes each), as pairs of places."""
    size = len(members)
    full = (1 << size) - 1
    bits = np.unpackbits(members, axis=1)
    rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    planes = [p for p in (int.from_bytes(r.tobytes(), "little") for r in rows) if p and p != full]  # a plane of equal bits tells nothing
    width = radius.bit_length()
    group: list[int] = list(range(size))
    mask = {k: 1 << k for k in range(size)}
    links = []
    for q in range(size - 1):
        later = (full >> (q + 1)) << (q + 1) & ~mask[group[q]]
        if not later:
            continue
        count, over, near = [0] * width, 0, later
        for k, plane in enumerate(planes, 1):
            carry = plane ^ full if plane >> q & 1 else plane
            for b in range(width):
                count[b], carry = count[b] ^ carry, count[b] & carry
            over |= carry
            if k % 8 == 0 or k == len(planes):
                more, equal = over, full
                for b in reversed(range(width)):
                    if radius >> b & 1:
                        equal &= count[b]
                    else:
                        more |= equal & count[b]
                        equal &= ~count[b]
                near = later & ~more
                if not near:
                    break
        while near:
            other = (near & -near).bit_length() - 1
            links.append((q, other))
            a, b = group[q], group[other]
            if mask[a].bit_count() < mask[b].bit_count():
                a, b = b, a
            moved = mask.pop(b)
            mask[a] |= moved
            while moved:
                low = moved & -moved
                group[low.bit_length() - 1] = a
                moved ^= low
            near &= ~mask[a]
    return links


def within(differing: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of bytes have at most radius bits: many comparisons at once, bit planes over all of them, 32 planes a time;
    what exceeds the radius is left out of the next planes."""
    lanes, width = np.arange(len(differing)), radius.bit_length()
    count, over = np.zeros((width, -(-len(lanes) // 8)), np.uint8), np.zeros(-(-len(lanes) // 8), np.uint8)
    for k in range(0, differing.shape[1], 4):
        planes = np.packbits(np.ascontiguousarray(np.unpackbits(differing[lanes, k : k + 4], axis=1).T), axis=1)
        for carry in planes:
            for b in range(width):
                count[b], carry = count[b] ^ carry, count[b] & carry
            over |= carry
        more, equal = over.copy(), np.full_like(over, 255)
        for b in reversed(range(width)):
            if radius >> b & 1:
                equal &= count[b]
            else:
                more |= equal & count[b]
                equal &= ~count[b]
        stay = np.unpackbits(more, count=len(lanes)) == 0
        lanes = lanes[stay]
        count = np.packbits(np.unpackbits(count, axis=1, count=len(stay))[:, stay], axis=1)
        over = np.zeros(count.shape[1], np.uint8)
    out = np.zeros(len(differing), bool)
    out[lanes] = True
    return out


def links_of_blocks(members: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same for many small blocks that follow each other: members at each distance in a block meet at once."""
    block, label = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(members))

    def root(x: int) -> int:
        while label[x] != x:
            x = int(label[x])
        return x

    links = []
    for step in range(1, int(sizes.max(initial=0))):
        i = np.flatnonzero(block[:-step] == block[step:])
        i = i[label[i] != label[i + step]]
        near = i[within(members[i] ^ members[i + step], radius)]
        for a in near.tolist():
            x, y = root(a), root(a + step)
            if x != y:
                label[max(x, y)] = min(x, y)
                links.append((a, a + step))
        while len(near) and (label[label] != label).any():
            label = label[label]
    return links


def _in_blocks(nodes: DataFrame, size: int, bands: int) -> DataFrame:
    """Each node once for each pair of bands (a, b), under the key of its block."""
    width = size // bands
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(range(bands), 2)))
    part = lambda band: F.substring(F.col("fp"), F.col(band) * width + 1, F.lit(width))
    return nodes.select("fp", F.inline(pairs)).withColumn("key", F.xxhash64("a", part("a"), "b", part("b")))


def _in_finer_blocks(keyed: DataFrame, size: int, bands: int, exact: bool) -> DataFrame:
    """The same for blocks that are too large: cut again by each pair of free bytes, or by each free byte."""
    width = size // bands
    free = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda x: ~F.floor(x / width).isin(F.col("a"), F.col("b")))
    byte = lambda place: F.substring(F.col("fp"), F.col(place) + 1, F.lit(1))
    rows = keyed.select("fp", "a", "b", "key", F.explode(free).alias("x"))
    if not exact:
        return rows.select("fp", F.xxhash64("key", "x", byte("x")).alias("key"))
    rows = rows.select("*", F.explode(free).alias("y")).where("x < y")
    return rows.select("fp", F.xxhash64("key", "x", byte("x"), "y", byte("y")).alias("key"))


def near_pairs(nodes: DataFrame, *, bits: int = 64, radius: int = 2, bands: int = 4, max_block: int = 4096) -> DataFrame:
    """(a, b), written: links among the different fingerprints of nodes (column fp), enough to connect what is linked."""
    ship(nodes.sparkSession)
    size, exact = bits // 8, bands >= radius + 2
    keyed = _in_blocks(nodes, size, bands)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialise(in_shuffles(keyed).join(sizes, "key"), release=True)
    members = F.collect_list("fp").alias("members")
    blocks = keyed.where(F.col("n") <= max_block).groupBy("key").agg(members)
    fine = _in_finer_blocks(keyed.where(F.col("n") > max_block), size, bands, exact).groupBy("key").agg(members)
    blocks = blocks.union(fine.where(F.size("members") > 1)).select("members")

    def run(batches):
        for batch in batches:
            a, b, few = [], [], []
            for values in batch.column(0).to_pylist():
                if len(values) <= SMALL:
                    few.append(values)
                    continue
                for i, j in links_of_block(np.frombuffer(b"".join(values), np.uint8).reshape(-1, size), radius):
                    a.append(values[i])
                    b.append(values[j])
            every = [x for values in few for x in values]
            for i, j in links_of_blocks(np.frombuffer(b"".join(every), np.uint8).reshape(-1, size), np.array([len(x) for x in few], np.int64), radius):
                a.append(every[i])
                b.append(every[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    links = materialise(blocks.mapInArrow(run, "a binary, b binary").distinct(), release=True)
    discard(keyed)
    return links


def near_duplicates(docs: DataFrame, *, words: int = 3, bits: int = 64, radius: int = 2, bands: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex digits), component_id (the smallest doc_id of the class)."""
    prints = materialise(fingerprints(docs, words, bits))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_pairs(nodes, bits=bits, radius=radius, bands=bands)).select(F.col("node").alias("fp"), "root")
    rooted = materialise(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    discard(nodes)
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(classes, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def nodes_that_meet(nodes: DataFrame, *, radius: int = 14, bands: int = 8) -> DataFrame:
    """(a, b), written, a > b: nodes (fp, simhash) whose fingerprints are equal or lie within the radius, enough to connect them."""
    prints = materialise(nodes.groupBy("simhash").agg(F.min("fp").alias("first")))
    near = near_pairs(prints.select(F.col("simhash").alias("fp")), bits=64, radius=radius, bands=bands)
    side = lambda name: prints.select(F.col("simhash").alias(name), F.col("first").alias(f"{name}_first"))
    across = near.join(side("a"), "a").join(side("b"), "b").select(F.greatest("a_first", "b_first").alias("a"), F.least("a_first", "b_first").alias("b"))
    same = nodes.join(prints, "simhash").where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    out = materialise(across.union(same), release=True)
    discard(prints, near)
    return out


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs without those that have a near duplicate of smaller doc_id in their class: classes join texts whose
    shingles have a Jaccard similarity of at least threshold, counted and not estimated. Texts whose SimHash fingerprints are near are
    compared first; what fingerprints miss at that similarity is found by minima of shingles, so that no link is lost. A row's identity is its doc_id with its
    text: of rows that repeat both, one stays, and different texts of one doc_id are rows of their own; rows without doc_id stay."""
    found = similar_documents(docs, words=words, threshold=threshold, meet=nodes_that_meet)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id"), "part").distinct()
    row = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("part"), F.struct("*").alias("row"))
    once = F.row_number().over(Window.partitionBy("id", "part").orderBy("id"))
    known = row.where("id IS NOT NULL").join(gone, ["id", "part"], "left_anti").withColumn("once", once).where("once = 1")
    return known.select("row.*").union(row.where("id IS NULL").select("row.*"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
