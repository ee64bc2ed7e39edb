"""Token ids of whole texts by a byte-level BPE vocabulary, fast enough for a corpus.

The library encodes each different word (with the space or line feed before it) once and its ids are kept. This gives the
ids of the whole text: the vocabulary's pre-tokeniser never joins what stands on both sides of a single space or line
feed, leaves a space with the word after it, and makes a line feed an id of its own. A text that has white space of any
kind next to a space or line feed, or at an end, or that holds the string of a special token, goes to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

#: Words whose ids are kept in a worker; beyond that they are forgotten and kept anew. Longer words are never kept.
MAX_KEPT, MAX_LENGTH = 900_000, 100
#: Bytes of text whose words are looked up together.
SLICE = 1 << 21
_encoders: dict[str, Encoder] = {}


def beside_space(word: str) -> bool:
    """Whether nothing, or white space, follows the space or line feed before a word, or white space ends it."""
    rest = word[1:] if word[:1] == "\n" else word
    return not rest or rest[0].isspace() or rest[-1].isspace()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.encode = lambda text: np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.line_feed = self.encode("\n")
        assert len(self.line_feed) == 1
        #: ids by word: of " word" under "word", of "\nword" with its line feed under "\nword"; none for a word beside white space
        self.kept: dict[str, bytes] = {}
        self.beside_space: set[str] = set()
        self.signs = {x: self.encode(x).tobytes() for x in ",.;:!?"}

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of words. One call encodes all, a line each: a line feed is an id that no word has."""
        lines = [w if w[0] == "\n" else "\n " + w for w in words]
        ids = self.encode("".join(lines))
        starts = [*(4 * np.flatnonzero(ids == self.line_feed[0])).tolist(), 4 * len(ids)]
        if len(starts) != len(words) + 1:
            found = [self.encode(x).tobytes() for x in lines]
        else:
            raw = ids.tobytes()
            found = [raw[a:b] for a, b in zip(starts, starts[1:])]
        return [x if w[0] == "\n" else x[4:] for w, x in zip(words, found)]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        kept = self.kept
        found = list(map(kept.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if len(kept) + len(missing) > MAX_KEPT:
            kept.clear()
            self.beside_space.clear()
            missing = list(range(len(words)))
        beside = [k for k in missing if beside_space(words[k])]
        self.beside_space.update(words[k] for k in beside)
        skip, stems = set(beside), {}
        for k in missing:
            w = words[k]
            if k not in skip and w[-1] in self.signs and w[-2:-1].isalpha() and w.isascii():
                stems[k] = w[:-1]  # a letter and a sign are never joined
        new = [words[k] for k in missing if k not in skip and k not in stems]
        new += set(stems.values()).difference(new, kept)
        known = dict(zip(new, self._learn(new)))
        for k in missing:
            if k in stems:
                found[k] = (known.get(stems[k]) or kept[stems[k]]) + self.signs[words[k][-1]]
            else:
                found[k] = known.get(words[k], b"")
        kept.update((w, ids) for w, ids in known.items() if len(w) <= MAX_LENGTH)
        kept.update((words[k], found[k]) for k in missing if len(words[k]) <= MAX_LENGTH)
        return found

    def __call__(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of texts (strings without nulls): the place of the first text, the ids of all with end_id after each,
        and how many each text has."""
        for a, b in slices(texts, SLICE):
            yield a, *self._slice(texts.slice(a, b - a), end_id)

    def _slice(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        parted = pc.split_pattern(marked, " ")
        coded = parted.flatten().dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(parted).to_numpy(zero_copy_only=False))])[:-1]
        found = self._ids_of(words)
        table = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = (np.cumsum(n) - n)[which]
        n = n[which]
        starts[first] += 1  # the line feed before a text
        n[first] -= 1
        # as many words after a text as it takes: the end id
        table = np.append(table, np.array([end_id], "<u4"))
        last = np.append(first[1:], len(which))
        starts, n = np.insert(starts, last, len(table) - 1), np.insert(n, last, 1)
        first = first + np.arange(len(first))
        n = np.maximum(n, 0)
        ids = table[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        lengths = np.add.reduceat(n, first)
        whole = np.zeros(len(texts), bool)
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not self.beside_space.isdisjoint(words):
            odd = np.array([w in self.beside_space for w in words])[which]
            whole |= np.logical_or.reduceat(odd, first - np.arange(len(first)))
        if whole.any():
            ends = np.cumsum(lengths)
            parts = np.split(ids, ends[:-1])
            for k in np.flatnonzero(whole).tolist():
                parts[k] = np.append(self.encode(texts[k].as_py()), np.array([end_id], "<u4"))
            ids, lengths = np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
        return ids, lengths


def runs(batches: Iterator[pa.RecordBatch], encode: Encoder, end_id: int, limit: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Whole documents (doc_id, text) by runs of ``limit`` ids or a little more: doc_ids, ids, lengths."""
    names, parts, sizes, size = [], [], [], 0
    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for first, ids, lengths in encode(batch.column(1), end_id):
            ends = np.cumsum(lengths)
            at = begin = 0
            while at < len(lengths):
                to = min(len(lengths), int(np.searchsorted(ends, begin + limit - size)) + 1)
                end = int(ends[to - 1])
                names += doc_ids[first + at : first + to]
                parts.append(ids[begin:end])
                sizes.append(lengths[at:to])
                size, at, begin = size + end - begin, to, end
                if size >= limit:
                    yield names, np.concatenate(parts), np.concatenate(sizes)
                    names, parts, sizes, size = [], [], [], 0
    if names:
        yield names, np.concatenate(parts), np.concatenate(sizes)


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
