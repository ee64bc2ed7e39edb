"""String similarity (stdlib difflib) over pairs of columns, behind an exact bound in plain columns."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: Column, b: Column) -> Column:
    """difflib's ratio; the order of the two matters."""

    @F.pandas_udf(DoubleType())
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return each(a, b)


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence: a bit for each character of a, all of which one step moves at once."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = open_ = (1 << len(a)) - 1
    for c in b:
        met = open_ & places.get(c, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
    return len(a) - open_.bit_count()


@lru_cache(1 << 18)
def _at_most(a: str, b: str) -> float:
    """No ratio is above it: difflib's blocks stand in the same order in both texts."""
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b))


@lru_cache(1 << 18)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


#: Texts of so many characters or more go to difflib one by one: from there on it leaves frequent characters out.
SHORT = 200


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a row each, filled up with zeros, and their lengths."""
    lengths = np.array([len(t) for t in texts])
    width = int(lengths.max(initial=1))
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), width), lengths


def matched(xs: list[str], ys: list[str]) -> np.ndarray:
    """How many characters are in difflib's blocks, for many pairs of short texts at once: the longest common block of each pair, of
    equal ones the first in x, then in y; then those of what is left and right of it."""
    (a, a_lengths), (b, b_lengths) = _codes(xs), _codes(ys)
    total, pair = np.zeros(len(xs), np.int64), np.flatnonzero((a_lengths > 0) & (b_lengths > 0))
    part = np.stack([pair * 0, a_lengths[pair], pair * 0, b_lengths[pair]])
    while len(pair):
        a_from, a_to, b_from, b_to = part
        steps, width = int((a_to - a_from).max()), np.arange(int((b_to - b_from).max()))[:, None]
        own = np.where(width < b_to - b_from, b[pair, np.minimum(b_from + width, b.shape[1] - 1)], np.uint32(0xFFFFFFFF))
        run, best, end = np.zeros((len(width) + 1, len(pair)), np.uint8), np.zeros(len(pair), np.uint16), np.zeros(len(pair), np.int64)
        place = (255 - width).astype(np.uint16)
        for k in range(steps):
            inside = k < a_to - a_from
            same = own == np.where(inside, a[pair, np.minimum(a_from + k, a.shape[1] - 1)], np.uint32(0xFFFFFFFE))
            run[1:] = (run[:-1] + np.uint8(1)) * same
            most = (run[1:].astype(np.uint16) << 8 | place).max(axis=0)
            longer = most >> 8 > best >> 8
            best, end = np.where(longer, most, best), np.where(longer, k + 1, end)
        size = (best >> 8).astype(np.int64)
        a_end, b_end = a_from + end, b_from + 256 - (best & 255)
        total += np.bincount(pair, size, len(xs)).astype(np.int64)
        part = np.concatenate([np.stack([a_from, a_end - size, b_from, b_end - size]), np.stack([a_end, a_to, b_end, b_to])], axis=1)
        left = np.tile(size > 0, 2) & (part[1] > part[0]) & (part[3] > part[2])
        pair, part = np.tile(pair, 2)[left], part[:, left]
    return total


def ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """difflib's ratio of many pairs of texts; pairs that repeat are compared once, short ones many at a time, of about one length."""
    places: dict[tuple[str, str], int] = {}
    at = np.array([places.setdefault(p, len(places)) for p in zip(xs, ys)], np.int64)
    pairs, out = list(places), np.zeros(len(places))
    short = sorted((k for k, (x, y) in enumerate(pairs) if len(x) < SHORT and len(y) < SHORT), key=lambda k: len(pairs[k][0]))
    for k in range(0, len(short), 2048):
        x, y = zip(*(pairs[i] for i in short[k : k + 2048]))
        both = np.array([len(p) + len(q) for p, q in zip(x, y)])
        out[short[k : k + 2048]] = np.where(both > 0, 2.0 * matched(x, y) / np.maximum(both, 1), 1.0)
    for k, (x, y) in enumerate(pairs):
        if len(x) >= SHORT or len(y) >= SHORT:
            out[k] = _ratio(x, y)
    return out[at]


def mean_similarity(pairs: list[tuple[Column, Column]], least: float) -> Column:
    """The mean over pairs of fields: 1 if both are equal, 0 if one is empty, else difflib's ratio. Null if it is below least, which
    lengths, and for long texts common subsequences, tell of many pairs before they are compared."""

    @F.pandas_udf(DoubleType())
    def each(*fields: pd.Series) -> pd.Series:
        n, rows = len(fields) // 2, len(fields[0])
        ends, scores, open_ = [], np.zeros((n, rows)), np.zeros((n, rows), bool)
        for k in range(n):
            x, y = fields[2 * k].to_numpy(object), fields[2 * k + 1].to_numpy(object)
            a, b = (np.array([len(t) for t in v], np.int64) for v in (x, y))
            equal = np.array([p == q for p, q in zip(x, y)], bool)
            open_[k] = ~equal & (a > 0) & (b > 0)
            scores[k] = np.where(equal, 1.0, np.where(open_[k], 2.0 * np.minimum(a, b) / np.maximum(a + b, 1), 0.0))
            ends.append((x, y, open_[k] & ((a >= SHORT) | (b >= SHORT))))
        able = lambda: sum(scores) >= least * n - 1e-9
        for k, (x, y, long) in enumerate(ends):
            for i in np.flatnonzero(long & able()):
                scores[k, i] = _at_most(x[i], y[i])
        for k, (x, y, _) in enumerate(ends):
            rest = np.flatnonzero(open_[k] & able())
            if len(rest):
                scores[k, rest] = ratios(x[rest].tolist(), y[rest].tolist())
        mean = sum(scores) / n
        return pd.Series([m if m >= least else None for m in mean.tolist()], dtype="float64")

    return each(*(c for pair in pairs for c in pair))


def bound(a: Column, b: Column) -> Column:
    """No ratio is above 2 min(l1, l2) / (l1 + l2)."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / both)


def normal(field: Column) -> Column:
    return F.trim(F.lower(F.coalesce(field, F.lit(""))))


def field_bound(a: Column, b: Column) -> Column:
    """No similarity of two fields is above it."""
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(bound(a, b))
