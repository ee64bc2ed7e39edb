"""LM scoring by deleted interpolation.

The model is P(w | u) = a c(uw)/c(u) + b c(w)/N + d 1/(V+1), u being the token before (at a document's start the end of
another). The weights a, b, d depend on the bucket of c(u) (0, then powers of two). They are learned by expectation-
maximisation on held-out counts: each training token is deleted from the counts that predict it (c - 1 everywhere). The
counts, and the statistics of the weights, come from all training documents.

At scale: documents are read in blocks of about ``block_tokens`` tokens, in which words are numbered; a block's distinct words
and pairs go, as sorted 64-bit hashes with their counts in the block, to the tasks that they are dealt to; these sum them
and answer each block in the order asked. So a frequent word costs a task one number a block, whatever its count. The
weights need a histogram of at most some ten thousand cells (bucket and quantised odds) in the driver, however large the corpus.

Defined cases: a null text is empty and has its end alone; a null doc_id counts as the text ""; rows that repeat a doc_id
are scored row by row; without training tokens all known counts are 0 and the uniform part is all there is; a text of more tokens
than a block is in one block, whole; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import LOWER, UPPER, discard, materialise, table

_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
END = b"\n"  # no word holds white space
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Buckets of c(u), and steps an octave of the odds in the histogram.
BUCKETS, STEPS = 40, 4
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").translate(_TO_LOWER).split(), END]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def _packed(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    size = values.dtype.itemsize
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    size = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{size}")


def _sealed(*arrays: np.ndarray) -> bytes:
    parts = [_packed(np.ascontiguousarray(a)) for a in arrays]
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def _opened(raw: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", raw)
    out, at = [], 4 + 4 * n
    for size in struct.unpack_from(f"<{n}I", raw, 4):
        out.append(_unpacked(raw[at : at + size]))
        at += size
    return out


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """block, doc_ids, body: tokens a document, whether it is held out, tokens by number, hashes of the numbers' words."""

    def run(batches):
        part, made = TaskContext.get().partitionId() << 24, 0
        fresh = lambda: ([], [], [], defaultdict(count().__next__))
        doc_ids, lengths, numbers, known = fresh()
        size = 0

        def block():
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
            held = np.array([held_out(k) for k in doc_ids], np.uint8)
            body = _sealed(np.array(lengths, np.uint32), held, np.concatenate(numbers), hashes)
            return pa.RecordBatch.from_arrays([pa.array([part + made]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([body], pa.binary())], ["block", "doc_ids", "body"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                words = tokens_of(text.as_py())
                doc_ids.append(doc_id)
                lengths.append(len(words))
                numbers.append(np.array(list(map(known.__getitem__, words)), np.uint32))
                size += len(words)
                if size >= block_tokens:
                    yield block()
                    made, size = made + 1, 0
                    doc_ids, lengths, numbers, known = fresh()
        if doc_ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, doc_ids array<long>, body binary")


def _pairs(lengths: np.ndarray, numbers: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the key of its pair, and the number of the token before it (at a start, of an end)."""
    starts = np.cumsum(lengths) - lengths
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[starts] = numbers[starts + lengths - 1]
    return (hashes[before] * MIX) ^ (hashes[numbers] >> np.uint64(1)) ^ np.uint64(1), before


def _dealt(keys: np.ndarray, dealt: int) -> np.ndarray:
    """Where sorted keys begin that are dealt to each of the tasks."""
    to = ((keys >> np.uint64(32)) * np.uint64(dealt)) >> np.uint64(32)
    return np.searchsorted(to, np.arange(dealt + 1, dtype=np.uint64))


def _requests(blocks: DataFrame, dealt: int) -> DataFrame:
    """dealt, block, kind (0: words, 1: pairs), body: sorted keys (as differences) and their training counts."""

    def run(batches):
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                lengths, held, numbers, hashes = _opened(raw.as_py())
                trained = np.repeat(held == 0, lengths)
                pairs, _ = _pairs(lengths.astype(np.int64), numbers, hashes)
                for kind, keys, used in ((0, hashes, hashes[numbers[trained]]), (1, pairs, pairs[trained])):
                    every = np.unique(keys)
                    counts = np.zeros(len(every), np.uint32)
                    some, n = np.unique(used, return_counts=True)
                    counts[np.searchsorted(every, some)] = n
                    cuts = _dealt(every, dealt).tolist()
                    to = [k for k in range(dealt) if cuts[k] < cuts[k + 1]]
                    bodies = [_sealed(np.diff(every[cuts[k] : cuts[k + 1]], prepend=np.uint64(0)), counts[cuts[k] : cuts[k + 1]]) for k in to]
                    columns = [pa.array(to, pa.int32()), pa.array([block] * len(to), pa.int64()), pa.array([kind] * len(to), pa.int32()), pa.array(bodies, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["dealt", "block", "kind", "body"])

    return blocks.select("block", "body").mapInArrow(run, "dealt int, block long, kind int, body binary")


def _answers(requests: DataFrame, dealt: int) -> DataFrame:
    """block, kind, dealt, body (counts over all blocks in the order asked); tokens and words: of this task, on one row."""

    def run(batches):
        now, asked = None, []

        def summed():
            keys = [np.cumsum(_opened(body)[0]) for _, body in asked]
            own = [_opened(body)[1] for _, body in asked]
            _, where = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(where, np.concatenate(own)).astype(np.int64)
            every, at = totals[where], np.cumsum([0, *map(len, keys)]).tolist()
            # few bytes if counts are small
            small = lambda x: x.astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64)
            bodies = [_sealed(small(every[a:b])) for a, b in zip(at, at[1:])]
            n, kind = len(asked), now[1]
            tokens, words = (int(totals.sum()), int((totals > 0).sum())) if kind == 0 else (0, 0)
            rest = [0] * (n - 1)
            columns = [[b for b, _ in asked], [kind] * n, [now[0]] * n, bodies, [tokens, *rest], [words, *rest]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "kind", "dealt", "body", "tokens", "words"])

        for batch in batches:
            for to, block, kind, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if asked and now != (to, kind):
                    yield summed()
                    asked = []
                now = (to, kind)
                asked.append((block, body))
        if asked:
            yield summed()

    rows = requests.repartition(dealt, "dealt").sortWithinPartitions("dealt", "kind", "block")
    return rows.mapInArrow(run, "block long, kind int, dealt int, body binary, tokens long, words long")


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _counted(blocks: DataFrame, answers: DataFrame, tokens: int, words: int) -> DataFrame:
    """block, doc_ids, body (tokens a document, held out, tokens by number, counts of the numbers' words, of each token's
    pair), cells and n: the histogram of the block's training tokens, each deleted from the counts."""

    def run(batches):
        for batch in batches:
            for block, doc_ids, raw, replies in zip(*(batch.column(k).to_pylist() for k in range(4))):
                lengths, held, numbers, hashes = _opened(raw)
                answer = lambda kind: np.concatenate([_opened(r["body"])[0] for r in replies if r["kind"] == kind]).astype(np.int64)  # noqa: B023, E731
                word = np.empty(len(hashes), np.int64)
                word[np.argsort(hashes, kind="stable")] = answer(0)
                pairs, before = _pairs(lengths.astype(np.int64), numbers, hashes)
                pair = answer(1)[np.unique(pairs, return_inverse=True)[1]]
                trained = np.repeat(held == 0, lengths)
                c, u, w = pair[trained] - 1, word[before[trained]] - 1, word[numbers[trained]] - 1
                odds = lambda p: np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p, 1e-300) * (words + 1))) + 512, 0).astype(np.int64)
                x, y = odds(np.where(u > 0, c / np.maximum(u, 1), 0.0)), odds(w / max(1, tokens - 1))
                cells, n = np.unique((_bucket(u) << 24) + (x << 12) + y, return_counts=True)
                small = lambda v: v.astype(np.uint32 if v.max(initial=0) < 1 << 32 else np.uint64)
                body = _sealed(lengths, held, numbers, small(word), small(pair))
                columns = [pa.array([block], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([body], pa.binary())]
                columns += [pa.array([cells.tolist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "body", "cells", "n"])

    replies = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("kind", "dealt", "body"))).alias("replies"))
    rows = blocks.join(replies, "block").select("block", "doc_ids", "body", "replies")
    return rows.mapInArrow(run, "block long, doc_ids array<long>, body binary, cells array<long>, n array<long>")


def learn_weights(cells: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (a, b, d) of each bucket by expectation-maximisation over the histogram; a bucket without tokens takes those of
    all. In bucket 0 nothing follows u, and a is 0."""
    bucket = cells >> 24
    odds = lambda q: np.where(q > 0, np.exp2((q - 512) / STEPS), 0.0)
    parts = np.stack([odds(cells >> 12 & 4095), odds(cells & 4095), np.ones(len(cells))])

    def learned(some: np.ndarray) -> np.ndarray:
        w = np.array([0.4, 0.4, 0.2])
        for _ in range(rounds):
            share = w[:, None] * parts[:, some]
            w = (share / share.sum(axis=0) * n[some]).sum(axis=1) / n[some].sum()
            w = np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()
        return w

    every = learned(np.ones(len(cells), bool)) if len(cells) else np.array([0.0, 0.0, 1.0])
    out = np.stack([learned(bucket == b) if (bucket == b).any() else every for b in range(BUCKETS)])
    out[0] = np.array([0.0, *out[0][1:]]) / out[0][1:].sum()
    return out


def _scores(counted: DataFrame, weights: np.ndarray, tokens: int, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for doc_ids, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                lengths, held, numbers, word, pair = _opened(raw.as_py())
                lengths, word = lengths.astype(np.int64), word.astype(np.float64)
                starts = np.cumsum(lengths) - lengths
                _, before = _pairs(lengths, numbers, np.zeros(len(word), np.uint64))
                u, w = word[before], word[numbers]
                part = weights[_bucket(u)]
                p = part[:, 0] * pair / np.maximum(u, 1) + part[:, 1] * w / max(1, tokens) + part[:, 2] / (words + 1)
                total = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                base = total(np.log10(w + 1)) - lengths * np.log10(tokens + words + 1)
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(held == 1),
                    pa.array(lengths),
                    pa.array(total((w > 0).astype(np.int64))),
                    pa.array(np.full(len(lengths), tokens, np.int64)),
                    pa.array(base),
                    pa.array(total(np.log10(p))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return counted.select("doc_ids", "body").mapInArrow(run, SCORES)


def score(docs: DataFrame, *, block_tokens: int = 1 << 21) -> DataFrame:
    """A row (SCORES) for each row of docs (columns doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    dealt = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = materialise(_blocks(docs, block_tokens))
    answers = materialise(_answers(_requests(blocks, dealt), dealt), release=True)
    tokens, words = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("words")).first())
    counted = materialise(_counted(blocks, answers, tokens, words), release=True)
    discard(blocks, answers)
    cells = counted.select(F.explode(F.arrays_zip("cells", "n")).alias("z")).groupBy("z.cells").agg(F.sum("z.n").alias("n")).toArrow()
    weights = learn_weights(cells["cells"].to_numpy(), cells["n"].to_numpy())
    return _scores(counted, weights, tokens, words)


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
