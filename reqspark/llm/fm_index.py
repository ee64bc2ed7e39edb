"""A bidirectional FM-index over a block of words, and the search for words at edit distance one. Batches of numpy, no Spark.

The words stand between delimiters in one text. The index holds the Burrows-Wheeler transforms of the text and of the reversed
text as wavelet matrices; a pattern is a pair of suffix-rank intervals of equal size that are kept in step, so it can be extended
by a symbol at either end.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Symbols below those of words: the end of the text, and the delimiter.
END, DELIMITER, FIRST = 0, 1, 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of text in the order of the suffixes from there, by prefix doubling."""
    n, rank, width = len(text), text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class Wavelet:
    """A sequence of small integers with ranks of a symbol, and counts of smaller ones, in any interval."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.n, self.levels = len(sequence), max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bits = (sequence >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        every = np.arange(symbols)
        self.start = np.zeros(symbols, np.int64)
        self.start = self.ranks(every, np.zeros(symbols, np.int64), np.zeros(symbols, np.int64))[0]

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often symbol occurs before low and before high, and how many smaller symbols lie between."""
        smaller = np.zeros(len(low), np.int64)
        for k in range(self.levels):
            ones, zeros, bit = self.ones[k], self.zeros[k], (symbol >> (self.levels - 1 - k)) & 1 == 1
            one_low, one_high = ones[low], ones[high]
            smaller += np.where(bit, (high - one_high) - (low - one_low), 0)
            low, high = np.where(bit, zeros + one_low, low - one_low), np.where(bit, zeros + one_high, high - one_high)
        return low - self.start[symbol], high - self.start[symbol], smaller

    def symbols(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each interval and each symbol that occurs in it: the interval's number, the symbol, and its ranks."""
        at, symbol, smaller = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            one_low, one_high = ones[low], ones[high]
            zero_low, zero_high = low - one_low, high - one_high
            left, right = zero_high > zero_low, one_high > one_low
            at, symbol = np.concatenate([at[left], at[right]]), np.concatenate([symbol[left] * 2, symbol[right] * 2 + 1])
            smaller = np.concatenate([smaller[left], (smaller + zero_high - zero_low)[right]])
            low, high = np.concatenate([zero_low[left], (zeros + one_low)[right]]), np.concatenate([zero_high[left], (zeros + one_high)[right]])
        return at, symbol, low - self.start[symbol], high - self.start[symbol], smaller


class Found(NamedTuple):
    """Patterns: the query each belongs to, their intervals in the text and in the reversed text, and their number of occurrences."""

    query: np.ndarray
    low: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def where(self, keep: np.ndarray) -> Found:
        return Found(*(x[keep] for x in self))

    def plus(self, *others: Found) -> Found:
        return Found(*(np.concatenate(x) for x in zip(self, *others)))


class FMIndex:
    def __init__(self, words: list[str]) -> None:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        text = np.full(len(points) + len(words) + 2, DELIMITER, np.int64)
        text[np.arange(len(points)) + np.repeat(np.arange(len(words)), lengths) + 1] = FIRST + np.searchsorted(self.alphabet, points)
        text[-1] = END
        symbols = FIRST + len(self.alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.order = suffix_array(text)
        self.forward = Wavelet(text[self.order - 1], symbols)
        reverse = np.concatenate([text[-2::-1], [END]])
        self.backward = Wavelet(reverse[suffix_array(reverse) - 1], symbols)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those in no word of the block."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, FIRST + at, -1)

    def everything(self, queries: int) -> Found:
        zero = np.zeros(queries, np.int64)
        return Found(np.arange(queries), zero, zero, zero + self.forward.n)

    def left(self, found: Found, symbol: np.ndarray) -> Found:
        """Patterns with a symbol before them; those that occur."""
        found, symbol = found.where(symbol >= 0), symbol[symbol >= 0]
        low, high, smaller = self.forward.ranks(symbol, found.low, found.low + found.size)
        return Found(found.query, self.before[symbol] + low, found.back + smaller, high - low).where(high > low)

    def right(self, found: Found, symbol: np.ndarray) -> Found:
        """Patterns with a symbol after them; those that occur."""
        found, symbol = found.where(symbol >= 0), symbol[symbol >= 0]
        low, high, smaller = self.backward.ranks(symbol, found.back, found.back + found.size)
        return Found(found.query, found.low + smaller, self.before[symbol] + low, high - low).where(high > low)

    def any_right(self, found: Found) -> tuple[Found, np.ndarray]:
        """Patterns with each letter that occurs after them, and that letter."""
        at, symbol, low, high, smaller = self.backward.symbols(found.back, found.back + found.size)
        out = Found(found.query[at], found.low[at] + smaller, self.before[symbol] + low, high - low)
        letters = symbol >= FIRST
        return out.where(letters), symbol[letters]


def near_words(index: FMIndex, queries: list[str], exact: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query's place and a word's that share the query's first ``exact`` code points and differ by exactly one code
    point after them. The queries are of one length."""
    n, length = len(queries), len(queries[0])
    codes = index.codes(np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32).reshape(n, length))
    same = index.everything(n)
    for i in reversed(range(exact)):  # from the middle to the left end
        same = index.left(same, codes[same.query, i])
    same = index.left(same, np.full(len(same.query), DELIMITER))
    # then to the right: same has no error yet, changed has one
    changed = same.where(np.zeros(len(same.query), bool))
    for i in range(exact, length + 1):
        more, letter = index.any_right(same)
        if i == length:
            changed = changed.plus(more)
            break
        own = codes[more.query, i]
        # a letter before an equal one is the same as after it
        inserted = more.where(letter != own)
        again = codes[same.query, i] == codes[same.query, i - 1] if i > exact else np.zeros(len(same.query), bool)
        changed = changed.plus(inserted)
        changed = index.right(changed, codes[changed.query, i]).plus(inserted, same.where(~again))
        same = index.right(same, codes[same.query, i])
    ended = index.right(changed, np.full(len(changed.query), DELIMITER))
    at = index.order[np.repeat(ended.low, ended.size) + np.arange(ended.size.sum()) - np.repeat(np.cumsum(ended.size) - ended.size, ended.size)]
    pairs = np.unique(np.stack([np.repeat(ended.query, ended.size), np.searchsorted(index.starts, at)]), axis=1)
    return pairs[0], pairs[1]
