"""Packing: token ids of documents into windows, cut by order-preserving dynamic programming.

The ids of all documents, each with its end id, follow each other. Cuts may lie at the end of a document (free), at the end
of a sentence (``sentence_penalty``) or, where a sentence is longer than a window, every ``window`` ids (``hard_penalty``).
A window costs its padding (none if its length is a power of two) plus its cut's penalty plus ``window_cost``. With c the
places and f the least cost up to a place, f(j) = min over i with c_j - c_i <= window of (f(i) + c_i) + window - c_j, so the
minimum slides: a monotone queue gives it in constant time a place; windows of a power of two are looked up besides.

At scale each partition packs its documents as a stream, in runs of about ``run_ids`` ids: memory doesn't grow with the
partition, and a run wastes less than one window. A sequence_id holds the partition and a running number.

Defined cases: a null text is empty and has the end id alone; a document longer than a run is a run; rows that repeat a
doc_id are packed row by row; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import table, whole_text
from .token_files import in_order
from .tokens import default_vocabulary, encoder, runs

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_sentence_ends: dict[str, np.ndarray] = {}


def sentence_ends(vocabulary: str) -> np.ndarray:
    """Whether an id's text ends a sentence or holds a line feed."""
    if vocabulary not in _sentence_ends:
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(vocabulary).get_vocab()
        ends = np.zeros(max(words.values()) + 1, bool)
        for text, k in words.items():
            ends[k] = text.endswith((".", "!", "?")) or "Ċ" in text  # the vocabulary's sign for a line feed
        _sentence_ends[vocabulary] = ends
    return _sentence_ends[vocabulary]


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int, window_cost: float) -> list[int]:
    """The cheapest windows over ascending places (first 0; gaps of at most window): the chosen places after 0."""
    c, pen = places.tolist(), penalties.tolist()
    same: list[list[int]] = [[] for _ in c]
    for k in range(window.bit_length()):
        if 1 << k < window:
            at = np.searchsorted(places, places - (1 << k))
            for j in np.flatnonzero(places[at] == places - (1 << k)).tolist():
                same[j].append(int(at[j]))
    cost, came = [0.0] * len(c), [0] * len(c)
    queue: deque[int] = deque([0])
    for j in range(1, len(c)):
        here = c[j]
        while here - c[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        least = cost[i] + window - (here - c[i])
        for k in same[j]:
            if cost[k] < least:
                least, i = cost[k], k
        cost[j], came[j] = least + pen[j] + window_cost, i
        key = cost[j] + here
        while queue and cost[queue[-1]] + c[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(c) - 1
    while j:
        cuts.append(c[j])
        j = came[j]
    return cuts[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, window: int, sentence_penalty: float, hard_penalty: float):
    """Ascending places with their penalties, no two further apart than a window."""
    ends = np.flatnonzero(ends_sentence[ids]) + 1
    places = np.unique(np.concatenate([[0], ends[ends < len(ids)], doc_ends]))
    gaps = np.diff(places)
    long = np.flatnonzero(gaps > window)
    more = [np.arange(places[k] + window, places[k + 1], window) for k in long]
    hard = np.concatenate(more) if more else np.zeros(0, np.int64)
    penalties = np.full(len(places), float(sentence_penalty))
    penalties[np.searchsorted(places, doc_ends)] = 0
    merged = np.concatenate([places, hard])
    order = np.argsort(merged, kind="stable")
    return merged[order], np.concatenate([penalties, np.full(len(hard), float(hard_penalty))])[order]


def pieces_of(lengths: np.ndarray, cuts: list[int]):
    """For documents of these lengths and windows ending at cuts: document, start in it, length, window, offset in it."""
    doc_ends, cut_ends = np.cumsum(lengths), np.array(cuts, np.int64)
    ends = np.unique(np.concatenate([doc_ends, cut_ends]))
    starts = np.concatenate([[0], ends[:-1]])
    doc, sequence = np.searchsorted(doc_ends, ends), np.searchsorted(cut_ends, ends)
    offset = starts - np.concatenate([[0], cut_ends])[sequence]
    return doc, starts - (doc_ends - lengths)[doc], ends - starts, sequence, offset, starts


def pack(
    docs: DataFrame,
    *,
    vocabulary: str,
    end_id: int = 0,
    window: int = 1024,
    by_doc_id: bool = True,
    sentence_penalty: float = 4,
    hard_penalty: float = 32,
    window_cost: float = 1,
    run_ids: int = 1 << 20,
) -> DataFrame:
    """One row a piece (PIECES). Documents are taken in ascending doc_id order, or as they come."""
    ship(docs.sparkSession)
    rows = in_order(docs) if by_doc_id else docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text").cast("string")).alias("text"))

    def run(batches):
        ends_sentence, done = sentence_ends(vocabulary), 0
        first = TaskContext.get().partitionId() << 32
        for doc_ids, ids, lengths in runs(batches, encoder(vocabulary), end_id, run_ids):
            places, penalties = cut_places(ids, np.cumsum(lengths), ends_sentence, window, sentence_penalty, hard_penalty)
            cuts = best_cuts(places, penalties, window, window_cost)
            doc, start, length, sequence, offset, at = pieces_of(lengths, cuts)
            raw = ids.data.cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            names = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
            columns = [names, start, length, sums, lengths[doc], sequence + first + done, offset]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in PIECES.split(", ")])
            done += len(cuts)

    return rows.mapInArrow(run, PIECES)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary=default_vocabulary())
