"""Documents whose sets of five-word shingles have a Jaccard similarity of at least ``threshold``.

1. Each text becomes the set of its shingles' hashes (XXH64) and from that a fingerprint of the set (XXH3, 128 bits), its SimHash (a bit
   is set if it is in over half of the hashes) and ``BANDS`` keys, each of ``ROWS`` minima of hashes. Texts of equal sets are one node.
2. Nodes first meet as the caller says (``meet``: simhash.drop_near_duplicates lets those of near SimHash fingerprints meet). What
   that misses meets under a key: at a similarity of 0.8 a pair misses each other with the chance (1 - 0.8^5)^32 = 3 in a million,
   less above. How large a block is changes nothing in that.
3. First what ``meet`` gives, and each node with the least node under its keys, is compared, and what is linked joins into classes. Then all pairs
   under a key whose nodes are not of one class yet are compared, so copies of one text never make all their pairs. A
   block of over ``max_block`` nodes is dealt into parts, and every two parts meet as a group of their own.
4. Bands let pairs through far below the threshold, all those of a large family of one template among them. A pair first brings
   together a byte of each of the 160 minima: equal minima estimate the similarity, and a pair more than ``SIGMAS`` standard
   deviations below the threshold is left out, which a pair at 0.8 is with a chance of 3 in 10 million.
5. A link is a pair whose sets are counted: the two texts of each pair that is left are brought together by joins, and only true
   similarities count.

Defined cases: a text of fewer words than a shingle is one shingle; texts without words are one node; rows without doc_id
stand in no order and are neither removed nor a reason to remove.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import LOWER, UPPER, discard, in_shuffles, materialise
from .components import components

BANDS, ROWS, SIGMAS = 32, 5, 5
_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Hashes whose minima are taken at once.
_CHUNK = 512
_rng = np.random.default_rng(42)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The different hashes of a UTF-8 text's shingles, ascending."""
    parts = text.translate(_TO_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[: max(1, len(parts) - words + 1) - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[min(words, len(parts)) - 1 :].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys that a set has, one a band, and a byte of each of its minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, ((hashes[k : k + _CHUNK, None] ^ _TURNS) * _FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        key = (key ^ x) * _MIX
        key ^= key >> np.uint64(32)
    return key.view(np.int64), ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()


def fingerprint(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def majority(hashes: np.ndarray) -> bytes:
    """The SimHash of a set of hashes, big-endian: bits that are set in over half of them."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def _keyed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, part, fp, n, keys, minima, simhash); part is the hash of the text."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t or b"", words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keyed = [band_keys(s) for s in sets]
            keys = np.concatenate([k for k, _ in keyed]) if sets else np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys))
            columns = [batch.column(0), batch.column(2), pa.array(map(fingerprint, sets), pa.binary()), pa.array(map(len, sets), pa.int32()), keys, pa.array([m for _, m in keyed], pa.binary()), pa.array(map(majority, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "fp", "n", "keys", "minima", "simhash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("part")).mapInArrow(run, "doc_id long, part long, fp binary, n int, keys array<long>, minima binary, simhash binary")


def _texts(docs: DataFrame, ends: DataFrame, words: int) -> DataFrame:
    """(fp, text), written: a text for each node of ends (fp, least)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            same = [fingerprint(shingles(t or b"", words)) == fp for t, fp in zip(texts, batch.column(0).to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_()))

    found = docs.join(ends, F.col("doc_id") == F.col("least")).select("fp", "text")
    # rows that repeat a doc_id may have other texts, or the same text twice
    return materialise(found.mapInArrow(run, "fp binary, text string").groupBy("fp").agg(F.first("text").alias("text")), release=True)


def likely_pairs(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), written: those of the pairs whose minima are equal often enough for the threshold."""
    lanes = BANDS * ROWS
    least = np.ceil(lanes * threshold - SIGMAS * np.sqrt(lanes * threshold * (1 - threshold)))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, lanes) for k in (2, 3))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= least, pa.bool_())).select(["a", "b"])

    side = lambda name: nodes.select(F.col("fp").alias(name), F.col("minima").alias(f"{name}_minima"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_minima", "b_minima")
    return materialise(both.mapInArrow(run, "a binary, b binary"), release=True)


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b), written: those of the written pairs whose sets are as similar as asked."""

    def run(batches):
        for batch in batches:
            left, right = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            same = []
            for a, b in zip(left, right):
                x, y = shingles(a or b"", words), shingles(b or b"", words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                same.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield batch.filter(pa.array(same, pa.bool_())).select(["a", "b"])

    pairs = likely_pairs(pairs, nodes, threshold)
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    texts = _texts(docs, nodes.join(ends, "fp").select("fp", "least"), words)
    side = lambda name: in_shuffles(texts.select(F.col("fp").alias(name), F.col("text").alias(f"{name}_text")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    links = materialise(both.mapInArrow(run, "a binary, b binary"), release=True)
    discard(texts, pairs)
    return links


def _classes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, root), written, of all nodes."""
    roots = components(links).select(F.col("node").alias("fp"), "root")
    return materialise(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), release=True)


def _open_pairs(met: DataFrame, roots: DataFrame, done: DataFrame, threshold: float, max_block: int) -> DataFrame:
    """(a, b), written: nodes that meet under a key, of sizes that allow a link, in different classes, and not in done."""
    rooted = met.join(roots, "fp")
    blocks = rooted.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    rooted = rooted.join(blocks.select("key", F.ceil(F.col("members") / max_block).cast("int").alias("parts")), "key")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = rooted.select("key", F.col("fp").alias("a"), F.col("n").alias("a_n"), F.col("root").alias("a_root"), part.alias("i"), every.alias("j"))
    b = rooted.select("key", F.col("fp").alias("b"), F.col("n").alias("b_n"), F.col("root").alias("b_root"), every.alias("i"), part.alias("j"))
    both = in_shuffles(a).join(in_shuffles(b), ["key", "i", "j"]).where("a > b and a_root <> b_root")
    both = both.where(f"least(a_n, b_n) >= {threshold} * greatest(a_n, b_n) - 1e-9").select("a", "b").distinct()
    return materialise(both.join(done, ["a", "b"], "left_anti"), release=True)


def similar_documents(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, max_block: int = 1024, meet: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, part (the hash of its text) and component_id (the smallest doc_id of the class) of every row that has a doc_id. meet
    gives written pairs (a, b; a > b) of the nodes (fp, simhash) to be compared first."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    keyed = materialise(_keyed(docs, words))
    nodes = materialise(keyed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("simhash").alias("simhash")))
    # rows of equal sets have equal keys
    entries = keyed.join(nodes, (keyed["fp"] == nodes["fp"]) & (keyed["doc_id"] == nodes["least"])).select(keyed["fp"], keyed["n"], F.explode("keys").alias("key"))
    blocks = entries.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first <> last").select("key", "first")
    met = materialise(in_shuffles(entries).join(blocks, "key").distinct(), release=True)
    tried = met.where("fp <> first").groupBy("fp").agg(F.min("first").alias("b")).select(F.col("fp").alias("a"), "b")
    near = meet(nodes.select("fp", "simhash")) if meet else None
    tried = materialise(tried.union(near).distinct() if near else tried, release=True)
    links = _linked(tried, docs, nodes, words, threshold)
    roots = _classes(links, nodes)
    pairs = _open_pairs(met.select("fp", "n", "key"), roots, tried, threshold, max_block)
    more = _linked(pairs, docs, nodes, words, threshold)
    discard(met, tried, pairs, roots, *([near] if near else []))
    roots = _classes(links.union(more), nodes)
    classes = roots.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    out = materialise(keyed.select("doc_id", "part", "fp").join(roots, "fp").join(classes, "root").select("doc_id", "part", "component_id"), release=True)
    discard(keyed, nodes, links, more, roots)
    return out
