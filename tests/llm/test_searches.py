"""Spelling variants, benchmark passages and hard negatives against brute force, with nulls, ties, repeats and odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqspark.llm import decontaminate, hard_negatives, spelling
from reqspark.llm.fm_index import FMIndex, near_words, suffix_array

DOCS = "doc_id long, text string, h string, words string, at long, n long"
ITEMS = "item_id long, text string, window string, at long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(texts):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[a-zA-ZÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, form = {}, {}
    for w, n in counts.items():
        close = sorted((-counts[x], x) for x in counts if near(w, x))
        form[w] = close[0][1] if close and -close[0][0] >= 2 * n else None
        out[w] = (n, len(close))
    rows = set()
    for w, (n, n_near) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, n_near, counts[form[w]] if form[w] else None))
    return rows


def spelt(seed):
    """Texts whose words are often one code point apart, in chains of falling counts."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéÿÀo") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    texts = []
    for doc_id in range(60):
        words = []
        for _ in range(120):
            w = base[min(rng.randrange(60), rng.randrange(60))]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1 :]]) or "x"
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((doc_id if doc_id else None, rng.choice([" ", ", ", "-1×"]).join(words)))
    return [*texts, texts[3], (901, None), (902, ""), (903, "123 \n"), (904, "abcdefgh" * 4000 + " " + "tiny " * 9)]


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_spelling(spark, monkeypatch, block):
    """Also where deals are split into many parts."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    texts = spelt(5)
    docs = spark.createDataFrame([(i, t, "h", "w", 1, 2) for i, t in texts], DOCS).repartition(3)
    got = spelling.spelling_variants(spelling.count_words(docs, damage=97)).collect()
    want = variants(texts)
    assert len(got) == len(want) > 100 and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert sum(1 for r in want if r[1] and r[2] != r[1]) > 0  # roots beyond forms


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(spelling.count_words(spark.createDataFrame([], DOCS))).count() == 0
    docs = spark.createDataFrame([(1, "alone alone alone"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in spelling.spelling_variants(spelling.count_words(docs)).collect()] == [("alone", None, "alone", 3, 0, None)]


def test_ties_go_to_the_smallest(spark):
    words = spark.createDataFrame([("house", 3), ("mouse", 9), ("louse", 9), ("housé", 9), ("ÿouse", 9)], "word string, n long")
    assert {r.word: (r.form, r.n_near) for r in spelling.spelling_variants(words).collect()}["house"] == ("housé", 4)


def test_index():
    text = np.array([3, 2, 3, 3, 2, 3, 1, 0])
    assert suffix_array(text).tolist() == sorted(range(8), key=lambda i: text[i:].tolist())
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(4, 8))) for _ in range(200)})
    index = FMIndex(words)
    for length, same in groupby(sorted([*words, "zzzz", "abzb"], key=len), len):
        same = list(same)
        for exact in (1, length // 2, length):
            i, j = near_words(index, same, exact)
            got = list(zip((same[x] for x in i), (words[x] for x in j)))
            assert len(set(got)) == len(got)
            # an error within the first part may also read as one after it
            assert set(got) == {(a, b) for a in same for b in words if near(a, b) and a[:exact] == b[:exact] and near(a[exact:], b[exact:])}


# benchmark passages


def words_in(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def passages(docs, items, window=10):
    windows = {}
    for item_id, text in items:
        w = words_in(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, held = words_in(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    held |= windows[tuple(w[i : i + m])]
        out.append((doc_id, len(w), len(hit), tuple(sorted(str(x) for x in held if x is not None)), bool(hit)))
    return sorted(out, key=repr)


def test_passages(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice("the of and in house River Stone light é 東京 n7 seven".split() + [f"w{rng.randrange(60)}"] * 20)
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(8, 40))) for i in range(25)]
    items += [(30, "of"), (31, "seven house"), (32, None), (33, "..!"), (34, items[0][1]), (0, prose(20)), (None, items[1][1]), (35, "the " * 30)]
    docs = []
    for i in range(60):
        parts = [prose(rng.randint(0, 60))]
        if i % 3 == 0:
            w = rng.choice(items[:25])[1].split()
            a = rng.randrange(max(1, len(w) - 9))
            parts += [rng.choice([" ", "\n", "; "]).join(w[a : a + rng.randint(9, 40)]).upper(), prose(20)]
        docs.append((i if i % 7 else None, " ".join(parts)))
    docs += [docs[3], (90, None), (91, ""), (92, "?"), (93, "the " * 5000 + "of"), (94, items[5][1])]
    rows = spark.createDataFrame([(i, t, "h", "w", 1, 2) for i, t in docs], DOCS).repartition(3)
    tests = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    for kept, some in ((items, tests), ([x for x in items if len(words_in(x[1])) >= 4], tests.where(F.size(decontaminate.words_in(decontaminate.whole_text())) >= 4))):
        got = decontaminate.find_passages(rows, some).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=repr) == passages(docs, kept)
        for r in got:
            assert len({x for h in r.hits for x in range(h.start, h.end)}) == r.n_hit
    monkeypatch.setattr(decontaminate, "BROADCAST", 64)  # remainders instead of hashes
    got = decontaminate.find_passages(rows, tests, shingle=3).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=repr) == passages(docs, items)


def test_passages_of_nothing(spark):
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    items, docs = spark.createDataFrame([(1, "one two", "", 1)], ITEMS), spark.createDataFrame([(1, "one two three", "", "", 1, 1)], DOCS)
    assert decontaminate.find_passages(no_docs, items).count() == 0
    assert [tuple(r)[:3] + (r.contaminated,) for r in decontaminate.find_passages(docs, no_items).collect()] == [(1, 3, 0, False)]
    assert [tuple(r)[:3] + (r.contaminated,) for r in decontaminate.find_passages(docs, items).collect()] == [(1, 3, 2, True)]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


# hard negatives


def negatives(rows, k=5):
    rows = [(i, v, lab, [int(np.floor(256 * np.float64(x))) for x in e]) for i, (v, e, lab) in enumerate(rows) if lab is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for i, v, lab, q in rows:
        if v is None or v % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, p)), w, j, other == lab) for j, w, other, p in rows if j != i and len(p) == len(q)]
        for s, positive, _, _ in sorted((x for x in scored if x[3]), key=order)[:k]:
            fit = sorted((x for x in scored if not x[3] and 80 * s <= 100 * x[0] <= 100 * s), key=order)[:k]
            out += [(v, positive, n + 1, x[1], s, x[0]) for n, x in enumerate(fit)]
    return Counter(out)


def vectors(seed, n, dim=6, high=9):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-3, high, dim) / 8], int(rng.integers(0, 3)) if rng.random() < 0.6 else 1) for i in range(n)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, at long, score long, deal long"


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(v, e, lab, 1, 2, 3) for v, e, lab in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in hard_negatives.mine_hard_negatives(frame, F.col("vec_id") % 100 == 0, **options).collect())


@pytest.mark.parametrize("tile", [4096, 16])
def test_hard_negatives(spark, monkeypatch, tile):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2 if tile == 16 else 1024)
    rows = vectors(1, 600)
    rows += [(v + 10_000, e, lab) for v, e, lab in rows[:40]]  # ties
    rows += [(700, None, 1), (800, [], 1), (900, [1.0, None], 2), (1000, [float("nan")] * 6, 1), (1100, rows[5][1], None), (None, rows[6][1], 2), (1200, [1.0, 2.0], 1), (1201, [1.0, 2.0], 1), (1202, [1.0, 1.9], 2)]
    got = mined(spark, rows)
    assert sum(got.values()) > 100 and got == negatives(rows)


def test_hard_negatives_of_large_components_and_negative_scores(spark):
    rows = [(v, [x * 1e4 for x in e], lab) for v, e, lab in vectors(2, 300)] + [(1300, [1e30] * 6, 1)]
    got = mined(spark, rows)
    assert got == negatives(rows[:-1]) and got
    rows = [(v, [-x if v % 100 == 0 else x for x in e], lab) for v, e, lab in vectors(3, 300, high=20)]
    assert mined(spark, rows) == negatives(rows)


def test_repeated_anchors_and_nothing(spark):
    rows = vectors(4, 150)
    rows.append(rows[100])
    got = mined(spark, rows)
    assert got == negatives(rows) and got
    assert not mined(spark, []) and not mined(spark, [(0, [1.0], 1)]) and not mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])
