"""Line dedup: exact set-similarity join of lines, later matches removed.

A line is the set of its words in lower case; a line goes when any earlier line (by document, then place in the text) has a
Jaccard similarity of at least ``threshold`` with it. Lines without words stay.

1. Documents are sorted by place and cut into lines, which are numbered in that order and written. A task writes the words of
   equal lines once and marks the later ones as repeated; those that are equal in several tasks meet by 128 bits of their set.
2. Words are counted over these lines in ``BUCKETS`` counters by hash. Tokens are ordered by their counter, then by hash:
   rare words first. Those over ``rare`` (and over twice the mean counter, which rises with the corpus) are frequent. The cut
   trades rows under a key for keys a line: few tokens of a prefix are over it, so a line has about as many keys as its prefix
   has tokens, however large the corpus.
3. Similar lines of sizes over 1 share at least two tokens in their prefixes of size - ceil(t size) + 2 tokens. A line is put
   under each rare token of its prefix and each pair of frequent ones, so similar lines meet under a key. Lines of over
   ``LONG`` tokens are put under each token of the ordinary prefix instead (lines near that size under both).
4. Lines under a key are sorted by class of size (a step of 1 / t) and compared with those of their own and the next classes, by length, by position in the order, and by a parity bitmap of 64 bits (128 or
   256 for lines of over ``SHORT`` or ``MIDDLE`` tokens) whose difference can't exceed that of the sets. Each line is verified, by words, against the
   earliest line that passes. Lines that it doesn't remove and that met more get the next 16 that pass, then the next 128,
   and so on until each has been removed or held against all that pass. So large groups of similar lines make about one
   pair a line, never all pairs, and no line is left out.

Keys travel as compressed blocks of numbers, dealt by key (so many deals that each has about ``DEAL`` rows), and are written: for further
rounds only the rows under keys of open lines are taken from them (by a bitmap of fixed size, which lets some others through).
No text is shuffled for the comparison.

Defined cases: a null text has no lines and stays null, an empty one has one line without words; a document is a doc_id with a
text, so rows that repeat both keep the same lines; documents are in the order of doc_id, null first, and those that share a
doc_id or have none in that of their texts' hashes. Texts are read in slices of lines, however long they are. An empty table
gives none; other columns are kept in ``row`` and not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.tables import with_once
from .common import discard, in_shuffles, let, materialise, slices, table

#: Counters, and the pieces in which a task hands them on.
BUCKETS, PIECES = 1 << 20, 16
SHORT, MIDDLE, LONG = 64, 160, 400
#: Bytes of text that are cut at once, rows of keys that travel in a block, and rows of a deal.
SLICE, BLOCK, DEAL = 1 << 19, 1 << 19, 1 << 18
#: Bits of the bitmaps of keys that open lines ask for and of lines that are in pairs.
KEY_BITS = 25
#: Words of 64 bits in a row of a broadcast bitmap.
WORDS = 512
#: Lines that a task remembers to find equal ones.
REMEMBERED = 1 << 21
#: Bytes of words that are hashed together.
WIDE = 256
ROW = np.dtype([("key", "<u8"), ("id", "<i8"), ("size", "<u4"), ("pos", "<u4"), *((f"b{k}", "<u8") for k in range(4))])
BY_BYTES = {"key", "id", "size", "pos"}
MIX = np.uint64(0x9E3779B97F4A7C15)

DOCUMENT = ["doc", "part"]
LINES = "id long, doc long, part long, line int, words string, print binary, piece int, counts binary"


def document() -> list[Column]:
    """What a document is: its doc_id and the hash of its text."""
    return [F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("part")]


def _held(strings: pa.Array) -> tuple[pa.Buffer | None, np.ndarray]:
    """The bytes of strings, and where in them each begins and the last ends."""
    _, offsets, data = strings.buffers()
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    ends = np.frombuffer(offsets, kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    return data, ends


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word: eight bytes at a time are mixed in, one to one. Very long words are hashed one by one."""
    data, ends = _held(words)
    starts, size = ends[:-1], np.diff(ends)
    out = size.astype(np.uint64) * MIX
    if data is None:
        return out
    raw = np.frombuffer(data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() + bytes(8), np.uint8)
    starts = starts - ends[0]
    eight = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (len(raw) - 7,), (1,), writeable=False)
    live, at = np.flatnonzero((size > 0) & (size <= WIDE)), 0
    while len(live):
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        h = out[live] ^ (eight[starts[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[live] = h ^ (h >> np.uint64(31))
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > WIDE).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + size[k]].tobytes())
    return out


class Tokens:
    """The different tokens of lines: ``line`` (ascending) and ``hashes`` of each, and ``sizes`` of the lines' sets. ``lines``
    has white space that isn't one space between words taken out. With ``order``, the place of each counter, the tokens of a line
    are in that order, then by hash: different words are sorted once, not where they stand."""

    def __init__(self, lines: pa.Array, order: np.ndarray | None = None):
        data, ends = _held(lines)
        held = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data else b""
        for sign in "\t\r\x0b\x0c":
            if sign.encode() in held:
                lines = pc.replace_substring(lines, sign, " ")
        parted = pc.split_pattern(lines, " ")
        coded = parted.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        line = np.repeat(np.arange(len(lines)), pc.list_value_length(parted).to_numpy(zero_copy_only=False))
        none = pc.index(words, "").as_py()
        if none >= 0:
            blank = codes == none
            odd = np.unique(line[blank])
            mask = np.zeros(len(lines), bool)
            mask[odd] = True
            single = [" ".join(filter(None, x.split(" "))) for x in lines.take(pa.array(odd)).to_pylist()]
            lines = pc.replace_with_mask(lines, pa.array(mask), pa.array(single, pa.string()))
            line, codes = line[~blank], codes[~blank]
        hashes = _hashes(words)
        if order is not None:
            rank = order[hashes & np.uint64(BUCKETS - 1)].astype(np.uint64)
            both = rank << np.uint64(56) | hashes >> np.uint64(8)
            by = np.argsort(both)
            if (np.diff(both[by]) == 0).any():
                by = np.lexsort((hashes, rank))
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            codes, hashes = place[codes], hashes[by]
        pairs = np.sort(line << 32 | codes)
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        self.lines, self.line = lines, pairs >> 32
        self.hashes = hashes[pairs & 0xFFFFFFFF]
        self.sizes = np.bincount(self.line, minlength=len(lines))

    def prints(self) -> list[bytes]:
        """128 bits of each line's set."""
        out = np.zeros((len(self.sizes), 2), np.uint64)
        some = np.flatnonzero(self.sizes)
        if len(some):
            starts = (np.cumsum(self.sizes) - self.sizes)[some]
            mixed = (self.hashes ^ (self.hashes >> np.uint64(29))) * MIX
            out[some, 0] = np.add.reduceat(self.hashes, starts)
            out[some, 1] = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
        raw = out.tobytes()
        return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def _numbered_lines(docs: DataFrame) -> DataFrame:
    """LINES: all lines that have words, ids ascending by place, words and print null where an earlier line of the task has equal
    ones; and the task's counters, in pieces."""

    def run(batches):
        names = [x.split()[0] for x in LINES.split(", ")]
        next_id, seen, counts, last = TaskContext.get().partitionId() << 40, set(), np.zeros(BUCKETS, np.int64), None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh = [k != j for k, j in zip(keys, [last, *keys])]
            last = keys[-1] if keys else last
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            texts = batch.column(2)
            for a, b in slices(texts, SLICE):
                parted = pc.split_pattern(pc.utf8_lower(texts.slice(a, b - a)), "\n")
                n = pc.list_value_length(parted).to_numpy(zero_copy_only=False).astype(np.int64)
                lines = parted.flatten()
                row = np.repeat(np.arange(a, b), n)
                place = np.arange(len(lines)) - np.repeat(np.cumsum(n) - n, n)
                for i, j in slices(lines, SLICE):
                    tokens = Tokens(lines.slice(i, j - i))
                    prints = tokens.prints()
                    known = [x in seen or seen.add(x) for x in prints]
                    new = np.array([x is None for x in known]) & (tokens.sizes > 0)
                    np.add.at(counts, (tokens.hashes[new[tokens.line]] & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                    some = pa.array(np.flatnonzero(tokens.sizes))
                    of = pa.array(row[i:j]).take(some)
                    words = pc.if_else(pa.array(new), tokens.lines, pa.scalar(None, pa.string())).take(some)
                    ids = pa.array(next_id + np.arange(i, j)).take(some)
                    no_counts = [pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())]
                    columns = [ids, batch.column(0).take(of), batch.column(1).take(of), pa.array(place[i:j], pa.int32()).take(some), words, pa.array(prints, pa.binary(), mask=~new).take(some)]
                    yield pa.RecordBatch.from_arrays([*columns, *no_counts], names)
                    if len(seen) > REMEMBERED:
                        seen.clear()
                next_id += len(lines)
        if counts.any():
            compress = zstandard.ZstdCompressor(level=1).compress
            pieces = [compress(x.tobytes()) for x in np.split(counts, PIECES)]
            nothing = [pa.nulls(PIECES, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(range(PIECES), pa.int32()), pa.array(pieces, pa.binary())], names)

    rows = docs.select(*document(), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.repartitionByRange(*DOCUMENT).sortWithinPartitions(*DOCUMENT).mapInArrow(run, LINES)


def _counters(lines: DataFrame) -> np.ndarray:
    """The counters of all tasks, summed piece by piece where the pieces meet: BUCKETS numbers come to the driver."""

    def run(batches):
        piece, total = None, None
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)
                if k != piece and piece is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()])], ["piece", "counts"])
                total = counts if k != piece else total + counts
                piece = k
        if piece is not None:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()])], ["piece", "counts"])

    rows = lines.where("piece IS NOT NULL").select("piece", "counts").repartition("piece").sortWithinPartitions("piece")
    out = np.zeros((PIECES, BUCKETS // PIECES), np.int64)
    for r in rows.mapInArrow(run, "piece int, counts binary").collect():
        out[r.piece] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def ranks(counters: np.ndarray, rare: int) -> tuple[np.ndarray, int]:
    """For each counter its place in the order, in steps of an eighth of an octave, and the first place of frequent tokens."""
    step = lambda n: np.minimum(255, np.ceil(8 * np.log2(np.maximum(n, 1)))).astype(np.uint8)
    return step(counters), int(step(np.array([max(rare, 2 * counters.mean())]))[0]) + 1


def prefix_keys(ids: np.ndarray, tokens: Tokens, order: np.ndarray, frequent_from: int, threshold: float) -> np.ndarray:
    """ROWs of lines, whose tokens are in order, by their ids. Keys have 48 bits, so that their differences are short when sorted; those that fall together only
    cost comparisons. ``pos`` counts the tokens before that have no partner if what the key is made of is the first that two lines share."""
    line, sizes, hashes = tokens.line, tokens.sizes, tokens.hashes
    some = np.flatnonzero(sizes)
    starts = np.cumsum(sizes) - sizes
    bit, part = np.uint64(1) << (hashes & np.uint64(63)), (hashes >> np.uint64(6)) & np.uint64(3)
    part &= np.where(sizes[line] <= SHORT, 0, np.where(sizes[line] <= MIDDLE, 1, 3)).astype(np.uint64)  # of longer lines folds to that of shorter ones
    bitmap = np.zeros((4, len(sizes)), np.uint64)
    for k in range(4):
        if len(some):
            bitmap[k, some] = np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), starts[some])
    rank = order[hashes & np.uint64(BUCKETS - 1)]
    often = rank >= frequent_from
    pos, size = np.arange(len(hashes)) - starts[line], sizes[line]
    need = np.ceil(threshold * size - 1e-9).astype(np.int64)
    short = (size <= LONG / threshold) & ((pos < size - need + 2) | (size == 1))
    rare = np.flatnonzero(short & ((~often & (pos < size - need + 1)) | (size == 1)))  # of two rare tokens that lines share they meet under the first
    long = np.flatnonzero((size > LONG) & (pos < size - need + 1))
    frequent = np.flatnonzero(short & often & (size > 1))
    keys, rows, before = [hashes[rare], hashes[long] * MIX], [rare, long], [pos[rare], pos[long]]
    step = 1
    while True:
        a, b = frequent[: len(frequent) - step], frequent[step:]
        same = line[a] == line[b]
        if step >= len(frequent) or not same.any():
            break
        keys.append((hashes[a[same]] * MIX) ^ hashes[b[same]])
        rows.append(a[same])
        before.append(pos[b[same]] - 1)
        step += 1
    where = np.concatenate(rows)
    out = np.empty(len(where), ROW)
    out["key"], out["id"], out["size"], out["pos"] = np.concatenate(keys) >> np.uint64(16), ids[line[where]], size[where], np.concatenate(before)
    for k in range(4):
        out[f"b{k}"] = bitmap[k][line[where]]
    return out


def _picked(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """rows[places], each row as one piece of bytes: far faster than field by field."""
    return rows.view(f"V{rows.dtype.itemsize}")[places].view(rows.dtype)


def passing(rows: np.ndarray, threshold: float, limit: int, open_ids: np.ndarray | None = None, after: np.ndarray | None = None):
    """Pairs (later, earlier, more) that pass the filters under a key: for each later row the ``limit`` earliest, more being
    whether it passes with others beyond this one. With open_ids (ascending) only these are later rows, and only ids above
    their ``after`` are earlier ones. A row is held against rows of its own and the two next classes of size alone, as similar
    lines are at most one class apart."""
    rank = np.unique(rows["id"], return_inverse=True)
    ids_up, rank = rank[0], rank[1].astype(np.int64)
    group = np.floor(np.log(np.maximum(rows["size"], 1)) / (-np.log(threshold) * (1 + 1e-9))).astype(np.int64) if threshold < 1 else rows["size"].astype(np.int64)
    by = np.lexsort((rank, group, rows["key"]))
    rows, rank, group = _picked(rows, by), rank[by], group[by]
    ids, size, pos = rows["id"], rows["size"].astype(np.int64), rows["pos"].astype(np.int64)
    # runs of a key and a class; places of rows ascend by run, then id
    new = np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (group[1:] != group[:-1])])[: len(rows)]
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    next_to = np.append((rows["key"][first[1:]] == rows["key"][first[:-1]]) & (group[first[1:]] == group[first[:-1]] + 1), False)[: len(first)]
    places = run * (len(ids_up) + 1) + rank
    itself = np.maximum.accumulate(np.where(np.append(True, places[1:] != places[:-1])[: len(rows)], np.arange(len(rows)), 0))  # a key can have a line twice
    mine = np.arange(len(rows))
    floor = np.zeros(len(rows), np.int64)  # rank from which others are looked at
    if open_ids is not None:
        at = np.minimum(np.searchsorted(open_ids, ids), len(open_ids) - 1)
        mine = mine[open_ids[at] == ids]
        floor = np.searchsorted(ids_up, after[at], "right")
    todo, starts, stops = [], [], []
    for apart in (-1, 0, 1):
        of = run[mine] + apart
        there = np.ones(len(mine), bool) if apart == 0 else next_to[run[mine]] if apart > 0 else (of >= 0) & next_to[of]
        own, of = mine[there], of[there]
        todo.append(own)
        starts.append(first[of] if open_ids is None else np.searchsorted(places, of * (len(ids_up) + 1) + floor[own]))
        stops.append(np.searchsorted(places, of * (len(ids_up) + 1) + rank[own]) if apart else itself[own])
    todo, other, stop = map(np.concatenate, (todo, starts, stops))  # earliest first
    bitmap = [np.ascontiguousarray(rows[f"b{k}"]) for k in range(4)]
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)
    seen = np.zeros(len(todo), np.int64)
    later, earlier = [], []
    while True:
        live = (other < stop) & (seen <= limit)
        if not live.all():
            todo, other, stop, seen = todo[live], other[live], stop[live], seen[live]
        if not len(todo):
            break
        # by length
        some = np.flatnonzero((size[other] >= least[todo]) & (size[todo] >= least[other]))
        a, b = todo[some], other[some]
        # by position in the order: similar lines pass under the first that they share, so under others they needn't
        both = size[a] + size[b]
        need = np.ceil(threshold / (1 + threshold) * both - 1e-9).astype(np.int64)
        ok = np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need
        a, b, some, gap = a[ok], b[ok], some[ok], (both - 2 * need)[ok]
        # by bitmap, folded to as many bits as the shorter line has
        d = [x[a] ^ x[b] for x in bitmap]
        bits = lambda *words: sum(np.bitwise_count(x).astype(np.int64) for x in words)
        shorter = np.minimum(size[a], size[b])
        ok = bits(d[0] ^ d[1] ^ d[2] ^ d[3]) <= gap
        ok &= (shorter <= SHORT) | (bits(d[0] ^ d[2], d[1] ^ d[3]) <= gap)
        ok &= (shorter <= MIDDLE) | (bits(*d) <= gap)
        seen[some[ok]] += 1
        later.append(ids[a[ok]])
        earlier.append(ids[b[ok]])
        other = other + 1
    pairs = np.stack([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (later, earlier)])
    pairs = np.unique(pairs, axis=1) if pairs.shape[1] else pairs  # by later, then earlier
    new = np.concatenate([[True], pairs[0][1:] != pairs[0][:-1]]) if pairs.shape[1] else np.zeros(0, bool)
    rank = np.arange(pairs.shape[1]) - np.maximum.accumulate(np.where(new, np.arange(pairs.shape[1]), 0))
    more = np.append(rank[1:] == limit, False)[: len(rank)]  # the one after it is beyond the limit
    stay = rank < limit
    return pairs[0][stay], pairs[1][stay], more[stay]


def _turned(matrix: np.ndarray) -> np.ndarray:
    """The transpose of a matrix of bytes, a few of them a row or a column, copied along its long side."""
    out = np.empty(matrix.shape[::-1], np.uint8)
    if len(matrix) < matrix.shape[1]:
        for k, row in enumerate(matrix):
            out[:, k] = row
    else:
        for k, row in enumerate(out):
            row[:] = matrix[:, k]
    return out


def _sealed(rows: np.ndarray) -> bytes:
    """ROWs, ascending by key, field by field: keys as differences, all but the bitmaps byte by byte, so that equal bytes come
    together, compressed."""
    parts = []
    for name in ROW.names:
        values = np.diff(rows[name], prepend=np.uint64(0)) if name == "key" else np.ascontiguousarray(rows[name])
        parts.append((_turned(values.view(np.uint8).reshape(len(rows), -1)) if name in BY_BYTES else values).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _opened(blob: bytes, wanted: np.ndarray | None = None) -> np.ndarray:
    """The ROWs of a block; with wanted, a bitmap, those whose keys have their bit set in it."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, some = len(raw) // ROW.itemsize, 0, slice(None)
    for name in ROW.names:
        size = ROW[name].itemsize
        part = raw[at : at + size * n]
        if name in BY_BYTES:
            part = _turned(part.reshape(size, -1)[:, some]).reshape(-1)
        values = part.view(ROW[name])
        if name == "key":
            values = np.cumsum(values, dtype=np.uint64)
            if wanted is not None:
                bits = _bits(values)
                some = np.flatnonzero(wanted[bits >> 3] >> (bits & 7) & 1)
                values = values[some]
            out = np.empty(len(values), ROW)
        out[name] = values if name in BY_BYTES else values[some]
        at += size * n
    return out


def _bits(keys: np.ndarray) -> np.ndarray:
    return (keys * MIX >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _blocks(lines: DataFrame, order, frequent_from: int, threshold: float, dealt: int) -> DataFrame:
    """(dealt, rows, after): compressed ROWs of many lines (id, words, after), by what their keys are dealt to, and the after
    of each row."""

    def run(batches):
        def made(rows, after):
            to = (rows["key"] >> np.uint64(8)) % np.uint64(dealt)
            by = np.argsort(to << np.uint64(48) | rows["key"]) if dealt < 1 << 16 else np.lexsort((rows["key"], to))
            rows, to, after = _picked(rows, by), to[by], after[by]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist()
            cuts = list(zip(cuts, [*cuts[1:], len(rows)]))
            blobs, floors = [_sealed(rows[a:b]) for a, b in cuts], [after[a:b].tobytes() if after[a] >= 0 else None for a, b in cuts]
            columns = [pa.array([int(to[a]) for a, _ in cuts], pa.int32()), pa.array(blobs, pa.binary()), pa.array(floors, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["dealt", "rows", "after"])

        waiting, size = [], 0
        for batch in batches:
            ids, after = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b in slices(batch.column(1), SLICE):
                rows = prefix_keys(np.arange(a, b), Tokens(batch.column(1).slice(a, b - a), order.value), order.value, frequent_from, threshold)
                place = rows["id"].copy()
                rows["id"] = ids[place]
                waiting.append((rows, after[place]))
                size += len(rows)
                if size >= BLOCK:
                    yield made(*map(np.concatenate, zip(*waiting)))
                    waiting, size = [], 0
        if size:
            yield made(*map(np.concatenate, zip(*waiting)))

    return lines.select("id", "words", "after").mapInArrow(run, "dealt int, rows binary, after binary")


def _asked_for(blocks: DataFrame, wanted) -> DataFrame:
    """The rows of blocks whose keys have their bit set in the bitmap wanted."""

    def run(batches):
        for batch in batches:
            dealt, blobs = [], []
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _opened(blob.as_py(), wanted.value)
                if len(rows):
                    dealt.append(k)
                    blobs.append(_sealed(rows))
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(dealt), pa.binary())], ["dealt", "rows", "after"])

    return blocks.mapInArrow(run, "dealt int, rows binary, after binary")


def _wanted(asking: DataFrame) -> np.ndarray:
    """The bitmap of the keys of blocks: 2^KEY_BITS bits come to the driver, however many keys there are."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                bits = np.unique(_bits(_opened(blob.as_py())["key"]))
                yield pa.RecordBatch.from_arrays([pa.array(bits + 1)], ["bit"])

    return _collected(asking.select("rows").mapInArrow(run, "bit long"))


def _collected(bits: DataFrame) -> np.ndarray:
    """The bitmap of the bits (from 1) in ``bit``."""
    pieces = bits.groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << (KEY_BITS - 3), np.uint8)
    for r in pieces.collect():
        at = (r.piece - 1) * len(r.bits)
        out[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _candidates(blocks: DataFrame, threshold: float, limit: int, dealt: int, open_blocks: DataFrame | None = None) -> DataFrame:
    """(later, earlier, more), written: at most ``limit`` rows for a line in a deal."""
    asking = open_blocks is not None

    def run(batches):
        now, rows, asked = None, [], []

        def made():
            every = np.concatenate(rows) if rows else np.empty(0, ROW)
            if not asking:
                found = passing(every, threshold, limit)
            else:
                mine = np.concatenate([x for x, _ in asked]) if asked else np.empty(0, ROW)
                every = every[np.isin(every["key"], mine["key"])]
                ids, first = np.unique(mine["id"], return_index=True)
                after = np.concatenate([x for _, x in asked])[first] if asked else np.zeros(0, np.int64)
                found = passing(every, threshold, limit, ids, after) if len(every) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
            kinds = [pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds)], ["later", "earlier", "more"])

        for batch in batches:
            for k, blob, after in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if now is not None and k != now:
                    yield made()
                    rows, asked = [], []
                now = k
                if after is None:
                    rows.append(_opened(blob.as_py()))
                else:
                    asked.append((_opened(blob.as_py()), np.frombuffer(after, np.int64)))
        if now is not None:
            yield made()

    every = blocks.union(open_blocks) if asking else blocks
    found = every.repartition(dealt, "dealt").sortWithinPartitions("dealt").mapInArrow(run, "later long, earlier long, more boolean")
    return materialise(found, release=True)


def _flagged(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, words, met) of lines: met where a bitmap of fixed size doesn't rule out that the id is among ids. No words are shuffled
    for it, nor do they leave the JVM, so that only those of lines that are met go into joins."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << KEY_BITS))
    bits = _collected(ids.select((bit + 1).alias("bit"))).view("<i8")
    n = len(bits) // WORDS
    parts = pa.table([pa.array(range(n), pa.int64()), pa.ListArray.from_arrays(pa.array(range(0, len(bits) + 1, WORDS), pa.int32()), pa.array(bits))], ["part", "bits"])
    parts = F.broadcast(lines.sparkSession.createDataFrame(parts))
    placed = lines.select("id", "words", bit.alias("bit")).join(parts, F.expr(f"bit div {64 * WORDS} = part"))
    return placed.select("id", "words", F.expr(f"shiftright(get(bits, int(bit div 64 % {WORDS})), int(bit % 64)) & 1 = 1").alias("met"))


def _lines_of(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of ids, written, and some others."""
    return materialise(_flagged(lines, ids).where("met").select("id", "words"), release=True)


def alike(later: Column, earlier: Column) -> Column:
    """struct<common, every>: the different words that two lines share, and those of both."""
    return F.struct(F.size(F.array_intersect(later, earlier)).alias("common"), F.size(F.array_union(later, earlier)).alias("every"))


def _verified(found: DataFrame, lines: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id), written: the later lines of pairs whose words are as similar as asked; and the lines of all pairs, written."""
    some = _lines_of(found.select(F.explode(F.array("later", "earlier")).alias("id")), lines.where("words IS NOT NULL"))
    side = lambda name: in_shuffles(some.select(F.col("id").alias(name), F.col("words").alias(f"{name}_words")))
    both = found.select("later", "earlier").distinct().join(side("later"), "later").join(side("earlier"), "earlier")
    parted = both.select("later", F.split("later_words", " ").alias("a"), F.split("earlier_words", " ").alias("b"))
    sized = with_once(parted, "n", alike(F.col("a"), F.col("b")))
    good = sized.where(f"n.common >= {threshold} * n.every - 1e-9")
    return materialise(good.select(F.col("later").alias("id")).distinct(), release=True), some


def repeated_lines(docs: DataFrame, *, threshold: float = 0.8, rare: int = 1024, next_limit: int = 16) -> tuple[DataFrame, DataFrame]:
    """All lines that have words as (id, DOCUMENT, line, equal), written, and the ids of those that have an earlier similar line but
    for those that are ``equal`` to one of the same task."""
    spark = docs.sparkSession
    ship(spark)
    written = materialise(_numbered_lines(docs), release=True, level=1)
    # of lines with equal words in several tasks only the first goes on
    some = written.where("print IS NOT NULL")
    first = F.min("id").over(Window.partitionBy("print"))  # a task writes a print once, or as often as it forgets
    equal = materialise(some.select("id", first.alias("first")).where("id <> first").select("id"), release=True)
    flagged, met = _flagged(some, equal), _lines_of(equal, some)
    others = materialise(met.join(equal, "id", "left_anti"), release=True)
    discard(met)
    lines = flagged.where("NOT met").select("id", "words").union(others)
    order, frequent_from = ranks(_counters(written), rare)
    places = written.where("id IS NOT NULL").select("id", *DOCUMENT, "line", F.col("print").isNull().alias("equal"))
    order = spark.sparkContext.broadcast(order)  # a byte a counter
    # about eight keys a line
    dealt = max(spark.sparkContext.defaultParallelism, -(-8 * some.count() // DEAL))
    every = lines.withColumn("after", F.lit(-1).cast("long"))
    blocks, all_keys = materialise(_blocks(every, order, frequent_from, threshold, dealt), level=1), True
    found = _candidates(blocks, threshold, 1, dealt)
    (gone, pairs), limit = _verified(found, written, threshold), next_limit
    while True:
        # a deal that had more has looked at all up to the last that it gave
        still = found.where("more").groupBy(F.col("later").alias("id")).agg(F.min("earlier").alias("after"))
        still = materialise(still.join(gone, "id", "left_anti"), release=True)
        discard(found)
        if still.isEmpty():
            break
        asking = materialise(_blocks(pairs.join(still, "id"), order, frequent_from, threshold, dealt), release=True)  # still are among the later lines of pairs
        discard(pairs)
        if all_keys:  # rows of the keys of lines that are open after the first round serve all others
            wanted = spark.sparkContext.broadcast(_wanted(asking))
            blocks, old, all_keys = materialise(_asked_for(blocks, wanted)), blocks, False
            discard(old)
        found = _candidates(blocks, threshold, limit, dealt, asking)
        more, pairs = _verified(found, written, threshold)
        gone, old = materialise(gone.union(more)), gone
        discard(old, more, still, asking)
        limit *= 8
    discard(still, pairs, others, blocks)
    gone, old = materialise(gone.union(equal)), gone
    discard(old, equal)
    places.written_at = written.written_at
    return places, gone


def _without(text: Column, removed: Column) -> Column:
    """struct<text, n>: a text without lines (ascending places), and how many lines it had."""

    def rest(parts: Column) -> Column:
        edges = F.arrays_zip(F.concat(F.array(F.lit(-1)), removed).alias("a"), F.concat(removed, F.array(F.size(parts))).alias("b"))
        kept = F.flatten(F.transform(edges, lambda z: F.slice(parts, z["a"] + 2, z["b"] - z["a"] - 1)))
        return F.struct(F.array_join(kept, "\n").alias("text"), F.size(parts).alias("n"))

    return let(F.split(text, "\n", -1), rest)


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """row (the row of docs), doc_id, text (of the lines that stay), n_lines, n_removed."""
    places, gone = repeated_lines(docs, **how)
    gone_places = places.where("NOT equal").join(gone, "id", "left_semi").union(places.where("equal"))
    removed = gone_places.groupBy(*(F.col(k).alias(f"of_{k}") for k in DOCUMENT)).agg(F.array_sort(F.collect_list("line")).alias("removed"))
    removed = materialise(removed, release=True)
    discard(places, gone)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.col("text").cast("string").alias("text"), *document())
    rows = rows.join(in_shuffles(removed), [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in DOCUMENT], "left")
    rows = rows.withColumn("left", F.when(F.col("removed").isNotNull(), _without(F.col("text"), F.col("removed"))))
    n_lines = F.coalesce(F.col("left.n"), F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0))
    return rows.select(
        "row",
        "doc_id",
        F.when(F.col("left").isNotNull(), F.col("left.text")).otherwise(F.col("text")).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")
