"""Language-model scores and the randomness battery against plain loops over their definitions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from reqspark.llm import lm_scoring, pii, secret_scan, shingle_sets

WORDS = "the of and to in a house river stone light number seven open water green mountain paper signal letter winter".split()


def bucket(c):
    return 0 if c <= 0 else math.floor(math.log2(c)) + 1


def step(p, v):
    """The odds of p to the uniform part, to a quarter of an octave."""
    return 2 ** (round(4 * math.log2(p * (v + 1))) / 4) if p > 0 else 0.0


def learned(cells):
    w, total = [0.4, 0.4, 0.2], sum(cells.values())
    for _ in range(60):
        new = [0.0, 0.0, 0.0]
        for (x, y), n in cells.items():
            parts = [w[0] * x, w[1] * y, w[2]]
            for j in range(3):
                new[j] += n * parts[j] / sum(parts)
        w = [max(x / total, 1e-9) for x in new]
        w = [x / sum(w) for x in w]
    return w


def test_scores_are_those_of_deleted_interpolation(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(WORDS[: 2 + k % 18], 5 + 7 * (k % 31))) for k in range(90)]
    texts += ["", None, "Alpha beta ALPHA beta gamma", "unseen words only here", " \t\n "]
    data = list(enumerate(texts))
    data += [data[4], (None, texts[5])]
    seqs = [(k, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "\n"]) for k, t in data]
    train = [ws for k, ws in seqs if not lm_scoring.held_out(k)]
    one, two = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip(["\n", *ws], ws))
    n, v, cells = sum(one.values()), len(one), defaultdict(Counter)
    for ws in train:
        for u, w in zip(["\n", *ws], ws):
            cu = one[u] - 1
            cells[bucket(cu)][step((two[u, w] - 1) / cu if cu else 0, v), step((one[w] - 1) / (n - 1), v)] += 1
    every = learned(sum(cells.values(), Counter()))
    weights = {b: learned(c) for b, c in cells.items()}
    a, b, d = weights.get(0, every)
    weights[0] = [0.0, b / (b + d), d / (b + d)]
    want = defaultdict(list)
    for k, ws in seqs:
        total = 0.0
        for u, w in zip(["\n", *ws], ws):
            a, b, d = weights.get(bucket(one[u]), every)
            total += math.log10(a * two[u, w] / max(1, one[u]) + b * one[w] / n + d / (v + 1))
        want[k].append(total)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = lm_scoring.score(docs, block_tokens=700).collect()
    assert len(got) == len(data)
    for r in got:
        assert any(abs(r.score - x) < 1e-6 * max(1, abs(x)) for x in want[r.doc_id])


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = [DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_"]


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def p_value(token, alphabet):
    codes, size, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    cells = max(2, min(size, n // 5, 16))
    places = Counter(x * cells // size for x in range(size))
    seen = Counter(x * cells // size for x in codes)
    x2 = sum((seen[k] - n * m / size) ** 2 / (n * m / size) for k, m in places.items())
    df = cells - 1
    chi = tail(((x2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    bits = [2 * x >= size for x in codes]
    ones, runs = sum(bits), 1 + sum(x != y for x, y in zip(bits, bits[1:]))
    mean = 2 * ones * (n - ones) / n + 1
    run = 2 * tail(abs(runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))) if ones not in (0, n) and mean > 2 else 0.0
    off = [x - sum(codes) / n for x in codes]
    square = sum(x * x for x in off)
    serial = 2 * tail(abs(sum(x * y for x, y in zip(off, off[1:])) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    return min(1.0, 3 * min(chi, run, serial))


def test_battery(spark):
    rng = np.random.default_rng(2)
    tokens = ["".join(rng.choice(list(a), n)) for a in ALPHABETS for n in (20, 33, 64, 200)]
    tokens += ["a" * 30, "ab" * 20, "abcdefghijklmnopqrstuvwxyz" * 2, "0" * 20 + "1", "internationalization", "x" + "9" * 40, "QUJD" * 9 + "=="]
    model = {x + y: -1.5 - 0.1 * "^Ulds".index(x) - 0.7 * "Ulds".index(y) for x in "^Ulds" for y in "Ulds"}
    frame = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secret_scan.battery(F.col("t"), model).alias("b"))
    kind = lambda c: "U" if c in UPPER else "l" if c in LOWER else "d" if c in DIGITS else "s"
    got = {r.t: r.b for r in frame.collect()}
    assert len(got) == len(tokens)
    for t in tokens:
        plain = t.rstrip("=")
        alphabet = next((a for a in ALPHABETS if set(plain) <= set(a)), UPPER + LOWER + DIGITS + "+/_=-")
        assert abs(got[t].p - p_value(plain, alphabet)) < 0.003, t
        text = sum(model[x + y] for x, y in zip("^" + "".join(map(kind, plain)), map(kind, plain)))
        assert abs(got[t].log_e - (-len(plain) * math.log(len(alphabet)) - text)) < 1e-6
    assert sum(got[t].p >= 0.01 for t in tokens[:28]) >= 26 and all(got[t].p < 0.01 for t in tokens[28:30])


def test_pii_context_of_another_kind_tells_nothing(spark):
    """At the default precision: numbers after words of other kinds, and dates after the right words, aren't added; phones without a plus
    sign after the right words are."""
    rng, texts = np.random.default_rng(8), {}
    number = lambda: "".join(map(str, rng.integers(1, 10, 10)))
    for k in range(1200):
        n = number()
        texts[k] = f"write to mail joe{n}@example.org or call phone +49 {n[:3]} {n[3:]} now"
    order, mobile, date = range(2000, 2600), range(3000, 3100), range(4000, 4100)
    for k in order:
        n = number()
        texts[k] = f"please write down order 49 {n[:3]} {n[3:]} and go on"
    for k in mobile:
        n = number()
        texts[k] = f"my mobile 49 {n[:3]} {n[3:]} is on"
    for k in date:
        texts[k] = f"call me on {10 + k % 18}/{10 + k % 3}/20{10 + k % 15}, please"
    added = {r.doc_id: r.added for r in pii.find_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    right = sum([(s.kind, texts[k][s.start : s.end]) for s in added[k]] == [("phone", texts[k][10 : texts[k].index(" is")])] for k in mobile)
    assert right >= 95 and not any(added[k] for k in [*order, *date])


def test_a_templated_family_verifies_few_pairs(spark, monkeypatch):
    """Texts of one template that are no near duplicates meet under many keys, but few of their pairs bring texts together."""
    rng, frame = np.random.default_rng(9), [f"t{k}" for k in range(230)]
    texts = [" ".join(w if rng.random() > 0.06 else f"x{rng.integers(10**6)}" for w in frame) for _ in range(400)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(226)} for t in texts]
    most = max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(400) for j in range(i))
    pairs, real = [], shingle_sets.likely_pairs
    monkeypatch.setattr(shingle_sets, "likely_pairs", lambda *a: pairs.append(real(*a)) or pairs[-1])
    monkeypatch.setattr(shingle_sets, "discard", lambda *a: None)
    got = shingle_sets.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert most < 0.8 and len(got) == 400 and all(r.doc_id == r.component_id for r in got)
    assert sum(p.count() for p in pairs) < 2000
