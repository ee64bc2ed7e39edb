"""Near copies of texts over a whole corpus: exact classes of difflib's ratio, without all pairs.

Two different texts link if difflib's ratio of them, in code-point order, is at least the threshold; classes are what links
connect. Four bounds hold for every pair, whatever blocks difflib finds; M is the number of characters in blocks and S that of both
texts, so that the ratio is 2 M / S:

- lengths: M is at most the shorter text, so the longer one has at most (2 - t) / t times its length;
- characters: M is at most the size of the common multiset of characters;
- order: blocks stand in the same order in both texts, so M is at most their longest common subsequence;
- first halves: of a text of length l at most l - t S / 2 characters are in no block, so the first p of one text meet only the first
  p + l - t S / 2 of the other. M is at most the common subsequence of these two and what follows the first p;
- pairs of characters: between two blocks at least one character is in none, so there are at most S - 2 M + 1 blocks, and the common
  multiset of character pairs has at least M minus that many members: M is at most (common pairs + S + 1) / 3;
- anchors, if both texts have 200 characters or more: there difflib leaves out the characters that the second text has more than
  length / 100 + 1 times, so each block holds one of the R others, but for one block at the start of both texts. A block of n
  characters has n - 3 runs of four: M is at most the common runs and 3 (R + 1). In prose R is small, and only near copies pass.

Characters, pairs and runs are counted by their remainders in vectors of fixed size; this can only raise what is common. The bound by
anchors is one product of matrices for a pair of tiles. Common subsequences of first halves are found for many pairs of texts at once, a
word or two of 64 bits a pair, those of whole texts with all of a tile, each text of it having its own bits of one long integer.

At scale: equal texts are one. Texts are range-partitioned by length and cut into tiles of at most ``TILE`` texts or ``BYTES``. A tile
knows its own classes. Tiles whose lengths allow a link meet by an equi-join on bands of lengths, where a band of many tiles is
dealt over as many groups as it needs, so that a length that a third of all texts have is spread. Bounds are evaluated for a whole
pair of tiles at a time; difflib sees only pairs that pass all of them and aren't in one class yet, so a family of near copies
costs about one comparison a text, not one a pair. A pair of tiles gives at most one link for each two classes that it joins.
The number of pairs of tiles within a band grows with the square of its texts.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.similarity import common_subsequence
from ..functions.tables import written
from .components import components

#: Texts (at most 1024) and bytes a tile; tiles a group; sizes of the vectors of characters and of pairs; of runs of four, for texts
#: of up to 512 characters and for longer ones.
TILE, BYTES, GROUP, CHARACTERS, PAIRS, RUNS = 1000, 1 << 22, 8, 64, 512, (2039, 8191)
#: Fixed value of difflib: from so many characters on it leaves frequent ones out.
LONG = 200
#: Common subsequences with a whole tile are found at once if its texts are no longer, it has no more different characters, and more
#: places than these are open.
LANE, KINDS, FEW = 512, 1000, 16
#: Texts whose open pairs are gathered, pairs whose first halves are compared at once, and the first characters from which they are.
ROWS, AT_ONCE, HALF = 64, 1 << 13, 8


class Tile:
    """Texts of about one length, with their vectors."""

    def __init__(self, texts: list[str]) -> None:
        points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in texts]
        self.texts, self.lengths = texts, np.array([len(p) for p in points])
        kind = np.int16 if self.lengths.max() < 1 << 15 else np.int32  # no sum of common counts is above a length
        count = lambda values, size: np.minimum(np.bincount(values % size, minlength=size), 1 << 30).astype(kind)
        self.characters = np.ascontiguousarray(np.array([count(p, CHARACTERS) for p in points]).T)
        self.pairs = np.array([count(p[:-1] * 31 + p[1:], PAIRS) for p in points])
        self._points = points

    def runs(self, size: int) -> np.ndarray:
        runs = [((p[:-3] * 31 + p[1:-2]) * 31 + p[2:-1]) * 31 + p[3:] for p in self._points]
        return np.array([np.bincount(r % size, minlength=size).astype(np.float32) for r in runs])

    @cached_property
    def anchors(self) -> np.ndarray:
        """How many characters of each text difflib doesn't leave out."""
        counts = [np.unique(p, return_counts=True)[1] for p in self._points]
        return np.array([int(c[c <= n // 100 + 1].sum()) for c, n in zip(counts, self.lengths)])

    @cached_property
    def lanes(self) -> tuple[dict[str, int], int, np.ndarray] | None:
        """The places of each character in all texts, a bit each and one free bit after each text; all places; where texts start."""
        if self.lengths.max() > LANE:
            return None
        starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        held = np.ones(starts[-1], bool)
        held[starts[1:] - 1] = False
        points = np.zeros(starts[-1], np.int64)
        points[held] = np.concatenate(self._points)
        bits = lambda places: int.from_bytes(np.packbits(places, bitorder="little").tobytes(), "little")
        kinds = np.unique(points[held])
        return ({chr(c): bits(held & (points == c)) for c in kinds.tolist()}, bits(held), starts) if len(kinds) <= KINDS else None


def common_subsequences(text: str, tile: Tile) -> np.ndarray:
    """The length of the longest common subsequence of text with each text of a tile that has lanes: steps of
    similarity.common_subsequence on all of them at once. What a step carries out of a text stays in its free bit."""
    places, full, starts = tile.lanes
    open_ = full
    for c in text:
        if met := open_ & places.get(c, 0):
            open_ = ((open_ + met) | (open_ - met)) & full
    bits = np.frombuffer(open_.to_bytes(-(-int(starts[-1]) // 8), "little"), np.uint8)
    return tile.lengths - np.add.reduceat(np.unpackbits(bits, bitorder="little", count=int(starts[-1])), starts[:-1], dtype=np.int64)


class Halves:
    """The bound by first halves for texts of a and of b. ``words``: for each word of 64 places, each character of b and each text of b, the
    places in it that hold the character."""

    def __init__(self, a: Tile, b: Tile, threshold: float) -> None:
        shortest = int(a.lengths.min())
        self.first, self.threshold, self.a, self.b = shortest // 2, threshold, a.lengths, b.lengths
        need = np.ceil(threshold / 2 * (shortest + b.lengths) - 1e-9).astype(np.int64)
        self.cuts = np.clip(self.first + b.lengths - need, 0, b.lengths)
        heads = [p[:c] for p, c in zip(b._points, self.cuts.tolist())]
        kinds, codes = np.unique(np.concatenate(heads), return_inverse=True)
        self.useful = self.first >= HALF and 0 < len(kinds) <= KINDS
        if not self.useful:
            return
        n, width = len(heads), -(-int(self.cuts.max()) // 64)
        place = np.concatenate([np.arange(c) for c in self.cuts])
        self.words = np.zeros((width, len(kinds) + 1, n), np.uint64)  # the last is for characters that b doesn't have
        np.bitwise_or.at(self.words, (place >> 6, codes, np.repeat(np.arange(n), self.cuts)), np.uint64(1) << (place & 63).astype(np.uint64))
        own = np.array([p[: self.first] for p in a._points]).T
        at = np.minimum(np.searchsorted(kinds, own), len(kinds) - 1)
        self.codes = np.where(kinds[at] == own, at, len(kinds)) * n

    def passing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of places may link: the steps of similarity.common_subsequence, a word at a time with what it carries over."""
        out = np.ones(len(i), bool)
        for k in range(0, len(i), AT_ONCE):
            x, y = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            open_ = [np.full(len(x), 0xFFFFFFFFFFFFFFFF, np.uint64) for _ in self.words]
            for codes in self.codes:
                at, over = codes[x] + y, None
                for w, places in enumerate(self.words):
                    met = open_[w] & places.reshape(-1).take(at)
                    moved = open_[w] + met
                    more = moved < met
                    if over is not None:
                        moved += over
                        more |= moved < over
                    over = more.astype(np.uint64) if w + 1 < len(self.words) else None
                    open_[w] = moved | (open_[w] ^ met)
            cuts, common = self.cuts[y], 0
            for w, left in enumerate(open_):
                held = np.clip(cuts - 64 * w, 0, 64)
                mask = np.where(held == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(held, 63).astype(np.uint64)) - np.uint64(1))
                common = common + held - np.bitwise_count(left & mask)
            out[k : k + AT_ONCE] = 2 * (common + self.a[x] - self.first) >= self.threshold * (self.a[x] + self.b[y]) - 1e-9
        return out


def anchored(a: Tile, b: Tile, threshold: float) -> np.ndarray | None:
    """Which places of a (rows) and b may link by the bound by anchors; None if it tells nothing."""
    if max(a.lengths.min(), b.lengths.min()) < LONG and min(a.lengths.max(), b.lengths.max()) < LONG:
        return None
    size = RUNS[int(max(a.lengths.max(), b.lengths.max()) > 512)]
    x, y = a.runs(size), b.runs(size)
    # so many common runs are needed; what one text has of those that the other has at all is no less than what is common
    least = threshold / 2 * (a.lengths[:, None] + b.lengths) - 3 * (np.maximum(a.anchors[:, None], b.anchors) + 1) - 1e-2
    short = np.minimum(a.lengths[:, None], b.lengths) < LONG
    open_ = short | (x @ np.minimum(y, 1).T >= least)
    i, j = np.nonzero(open_ & ~short)
    for k in range(0, len(i), 256):
        p, q = i[k : k + 256], j[k : k + 256]
        open_[p, q] = np.minimum(x[p], y[q]).sum(axis=1) >= least[p, q]
    return open_


def possible(a: Tile, i: int, b: Tile, j: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the places j of b whose bounds by counts with place i of a reach the threshold."""
    both = a.lengths[i] + b.lengths
    j = j[2 * np.minimum(a.lengths[i], b.lengths[j]) >= threshold * both[j] - 1e-9]
    every = 2 * len(j) > len(b.texts)  # then it is faster not to pick
    common = np.minimum(a.characters[:, i, None], b.characters if every else b.characters[:, j])
    common = common.sum(axis=0, dtype=common.dtype).astype(np.int64)
    j = j[2 * (common[j] if every else common) >= threshold * both[j] - 1e-9]
    common = np.minimum(a.pairs[i], b.pairs[j])
    return j[2 * (common.sum(axis=1, dtype=common.dtype).astype(np.int64) + both[j] + 1) >= 3 * threshold * both[j] - 1e-9]


def similar(x: str, y: str, threshold: float) -> bool:
    first, second = sorted((x, y))
    return SequenceMatcher(None, first, second).ratio() >= threshold


def joined(a: Tile, b: Tile | None, classes: list[int], threshold: float) -> list[tuple[int, int]]:
    """Links between places of a and b (of a alone, if b is None) that join different classes; b's places follow a's."""
    labels, out, other = np.array(classes), [], b or a
    shift = len(a.texts) if b else 0
    open_, halves = anchored(a, other, threshold), None
    for i, one in enumerate(a.texts):
        if i % ROWS == 0:
            held = []
            for k in range(i, min(i + ROWS, len(a.texts))):
                rest = np.arange(0 if b else k + 1, len(other.texts))
                if open_ is not None:
                    rest = rest[open_[k, rest]]
                held.append(possible(a, k, other, rest[labels[rest + shift] != labels[k]], threshold))
            sizes = [len(x) for x in held]
            if sum(sizes) > ROWS and max(a.lengths.max(), other.lengths.max()) <= LANE:
                halves = halves or Halves(a, other, threshold)
                if halves.useful:
                    met = halves.passing(np.repeat(np.arange(i, i + len(held)), sizes), np.concatenate(held))
                    held = [x[y] for x, y in zip(held, np.split(met, np.cumsum(sizes)[:-1]))]
        rest = held[i % ROWS]
        rest = rest[labels[rest + shift] != labels[i]]
        if len(rest) > FEW and other.lanes:
            both = len(one) + other.lengths[rest]
            rest = rest[2 * common_subsequences(one, other)[rest] >= threshold * both - 1e-9]
        while len(rest):
            j, rest = int(rest[0]), rest[1:]
            text = other.texts[j]
            if 2 * common_subsequence(one, text) >= threshold * (len(one) + len(text)) - 1e-9 and similar(one, text, threshold):
                out.append((i, j + shift))
                x, y = sorted((labels[i], labels[j + shift]))
                labels[labels == y] = x
                rest = rest[labels[rest + shift] != labels[i]]
    return out


def _tiles(texts: DataFrame, threshold: float) -> DataFrame:
    """tile, band, short, long (lengths), texts, classes (the place of each text's class within the tile)."""
    schema = "tile long, band int, short int, long int, texts array<string>, classes array<int>"

    def run(batches):
        first, made, band, held, size = TaskContext.get().partitionId() << 32, 0, None, [], 0

        def tile():
            own, classes = Tile(held), list(range(len(held)))
            for i, j in joined(own, None, classes, threshold):
                i, j = sorted((classes[i], classes[j]))
                classes = [i if c == j else c for c in classes]
            row = [first + made, band, int(own.lengths.min()), int(own.lengths.max()), held, classes]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds)], schema=kinds)

        kinds = pa.schema([("tile", pa.int64()), ("band", pa.int32()), ("short", pa.int32()), ("long", pa.int32()), ("texts", pa.list_(pa.string())), ("classes", pa.list_(pa.int32()))])
        for batch in batches:
            for text, own in zip(batch.column("text").to_pylist(), batch.column("band").to_pylist()):
                if held and (len(held) == TILE or size > BYTES or own != band):
                    yield tile()
                    made, held, size = made + 1, [], 0
                band, size = own, size + len(text)
                held.append(text)
        if held:
            yield tile()

    # a little wider than the bound, so that rounding can't part a pair by two bands
    step = float(np.log((2 - threshold) / threshold * (1 + 1e-9)))
    band = F.floor(F.log(F.length("text").cast("double")) / step).cast("int") if step > 1e-6 else F.length("text")
    rows = texts.select("text", F.length("text").alias("length"), band.alias("band"))
    ordered = rows.repartitionByRange("length", F.xxhash64("text")).sortWithinPartitions("length", "text")
    return ordered.select("text", "band").mapInArrow(run, schema)


def _links(tiles: DataFrame, threshold: float) -> DataFrame:
    """a, b: places (tile and place in it) of texts that link, enough to connect every class."""
    sizes = tiles.groupBy("band").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    a = tiles.join(sizes, "band").withColumn("deal", F.pmod(F.xxhash64("tile"), "groups").cast("int"))
    # a tile meets those of its band, and those of the band below
    b = tiles.select(F.col("tile").alias("other"), F.col("short").alias("other_short"), F.col("texts").alias("other_texts"), F.col("classes").alias("other_classes"), F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("band").alias("own"))
    b = b.join(sizes, "band").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    reach = F.col("other_short") * threshold <= F.col("long") * (2 - threshold) + 1e-6
    pairs = a.join(b, ["band", "deal"]).where(((F.col("own") > F.col("band")) | (F.col("tile") < F.col("other"))) & reach)

    def run(batches):
        for batch in batches:
            for p in batch.to_pylist():
                n = len(p["texts"])
                found = joined(Tile(p["texts"]), Tile(p["other_texts"]), p["classes"] + [n + c for c in p["other_classes"]], threshold)
                at = lambda k: (p["tile"] << 10) + k if k < n else (p["other"] << 10) + k - n  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([at(i) for i, _ in found], pa.int64()), pa.array([at(j) for _, j in found], pa.int64())], ["a", "b"])

    # a pair of tiles takes far more time than its few bytes suggest: a fixed number of partitions isn't coalesced by their size
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select("tile", "texts", "classes", "other", "other_texts", "other_classes").repartition(parts, "tile", "other")
    across = pairs.mapInArrow(run, "a long, b long")
    within = tiles.select("tile", F.posexplode("classes").alias("k", "c")).where("k <> c")
    at = lambda k: F.shiftleft("tile", 10) + F.col(k)
    return across.union(within.select(at("k"), at("c")))


def near_classes(texts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """text, copies, class_text (the smallest text of its class), class_size (different texts): one row a different text of texts
    (column text); null and empty ones are left out."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold is above a half, and at most 1")
    ship(texts.sparkSession)
    counted = written(texts.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")))
    tiles = written(_tiles(counted, threshold))
    roots = components(_links(tiles, threshold)).withColumnRenamed("node", "at")
    placed = tiles.select("tile", F.posexplode("texts").alias("k", "text")).select((F.shiftleft("tile", 10) + F.col("k")).alias("at"), "text")
    linked = placed.join(roots, "at")
    least = linked.groupBy("root").agg(F.min("text").alias("class_text"), F.count("*").alias("class_size"))
    classes = linked.join(least, "root").select("text", "class_text", "class_size")
    return counted.join(classes, "text", "left").select("text", "copies", F.coalesce("class_text", "text").alias("class_text"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))
