"""Near copies over a corpus against all pairs, and the bounds that leave pairs out."""

import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import cache
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from reqspark.functions.similarity import common_subsequence
from reqspark.operators import corpus_dedup, dedup
from reqspark.operators.components import components
from reqspark.plans import registry

SF = "/root/testdata/sf0.001"


def ratio(x, y):
    return SequenceMatcher(None, *sorted((x, y))).ratio()


@cache
def at_least(x, y, threshold):
    """difflib's own bounds first: they are quick."""
    m = SequenceMatcher(None, *sorted((x, y)))
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


def classes(texts, threshold):
    """text: (smallest text of its class, size of the class), by all pairs."""
    root = {t: t for t in texts}

    def of(t):
        while root[t] != t:
            t = root[t]
        return t

    for x, y in combinations(sorted(texts), 2):
        if at_least(x, y, threshold):
            a, b = sorted((of(x), of(y)))
            root[b] = a
    out = defaultdict(set)
    for t in texts:
        out[of(t)].add(t)
    return {t: (min(group), len(group)) for group in out.values() for t in group}


def corpus(seed, n):
    """Texts of 1 to 400 characters (beyond 200 difflib leaves out frequent characters), with edited copies, moved parts, and a family of
    one template whose members aren't all near."""
    rng = random.Random(seed)
    words = ["Spannung", "wert", "é", "signal", "=", "12", "set", "Ausgang", "prüfen", "voltage", "東京", "off", "a", "b"]
    out = set()
    while len(out) < n:
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 20, 60])))
        out.add(text)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(text) + 1)
            text = rng.choice([text[:k] + "x" + text[k:], text[:k] + text[k + 1 :], text[k:] + text[:k], text + " " + rng.choice(words)])
            out.add(text)
    out |= {f"Send {a} signal with value {v} | {a}={v} | flag" for a in ("FRANCE", "GERMANY", "IRAN", "IRAQ") for v in range(8)}
    return sorted(x for x in out if x)


@pytest.mark.parametrize(("threshold", "tile"), [(0.85, 512), (0.85, 16), (0.6, 40), (1.0, 64)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, threshold, tile):
    monkeypatch.setattr(corpus_dedup, "TILE", tile)
    texts = corpus(1, 260)
    assert len(texts) > 280
    rows = [(t,) for t in [*texts, texts[0], texts[0], None, ""]]
    got = corpus_dedup.near_classes(spark.createDataFrame(rows, "text string").repartition(3), threshold).collect()
    assert {r.text: (r.class_text, r.class_size) for r in got} == classes(texts, threshold) and len(got) == len(texts)
    assert {r.text for r in got if r.copies != 1} == {texts[0]}


def test_bounds_hold():
    rng = random.Random(2)
    texts = corpus(3, 150)
    pairs = [tuple(sorted(rng.sample(texts, 2))) for _ in range(3000)]
    for threshold in (0.6, 0.85):
        for x, y in pairs:
            if ratio(x, y) >= threshold:
                a, b = corpus_dedup.Tile([x]), corpus_dedup.Tile([y])
                assert len(corpus_dedup.possible(a, 0, b, np.arange(1), threshold)) == 1
                assert 2 * common_subsequence(x, y) >= threshold * (len(x) + len(y))
    assert common_subsequence("abcbdab", "bdcaba") == 4 and common_subsequence("abcbdab", "xyz") == common_subsequence("", "a") == 0


def test_common_subsequences_with_a_whole_tile():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé東") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    tile = corpus_dedup.Tile(texts)
    for one in texts[:40]:
        assert corpus_dedup.common_subsequences(one, tile).tolist() == [common_subsequence(one, t) for t in texts]
    assert corpus_dedup.Tile(["a" * 600]).lanes is None


def test_long_texts_of_one_vocabulary_stay_out_of_subsequences(monkeypatch):
    """Prose of 200 characters or more differs by the runs that difflib's anchors can hold together; near copies stay in, with a block
    without an anchor at the start, and across the length of 200."""
    rng = random.Random(8)
    words = ["".join(rng.choice("eeeettaaooiinnsshrrdlu") for _ in range(rng.randint(3, 9))) for _ in range(2_000)]
    prose = [" ".join(rng.choice(words) for _ in range(n)) for n in (50, 60, 70) for _ in range(60)]
    calls, real = Counter(), corpus_dedup.common_subsequence
    monkeypatch.setattr(corpus_dedup, "common_subsequence", lambda *a: calls.update(n=1) or real(*a))
    tile = corpus_dedup.Tile(prose)
    assert tile.lengths.min() >= 200 and corpus_dedup.joined(tile, None, list(range(180)), 0.85) == [] and calls["n"] < 20
    for _ in range(300):
        x = "".join(rng.choice("aaaaeeeebcdxyzqé"[: rng.randint(2, 16)]) for _ in range(rng.randint(190, 260)))
        k, m = rng.randrange(len(x)), rng.randrange(len(x))
        y = rng.choice([x[:k] + "#" + x[k:], x[:k] + x[k + 9 :], x[k:] + x[:k], x[: max(k, 150)] + x[:k][::-1], x[:m] + "".join(rng.choice("ab") for _ in range(20)) + x[m:]])
        if x != y and ratio(x, y) >= 0.85:
            calls["near"] += 1
            assert corpus_dedup.joined(corpus_dedup.Tile([x]), corpus_dedup.Tile([y]), [0, 1], 0.85) == [(0, 1)]
    assert calls["near"] > 50


def test_first_halves_rule_out_texts_of_one_vocabulary(monkeypatch):
    """Short prose of the same words is told by first halves, many pairs at once; whatever links passes them."""
    rng = random.Random(9)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    prose = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(30))[:160] for _ in range(300)]
    calls, real = Counter(), corpus_dedup.common_subsequences
    monkeypatch.setattr(corpus_dedup, "common_subsequences", lambda *a: calls.update(n=1) or real(*a))
    assert corpus_dedup.joined(corpus_dedup.Tile(prose), None, list(range(300)), 0.85) == [] and calls["n"] < 10
    for threshold in (0.6, 0.85, 1.0):
        for alphabet in ("ab", "abcdefgh é€", "".join(map(chr, range(97, 140)))):
            xs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(16, 400))) for _ in range(12)]
            ys = [x[: max(0, k - 4)] + rng.choice(alphabet) * rng.randint(0, 30) + x[k:] for x in xs for k in (0, len(x) // 3, len(x))] + xs + ["", "q"]
            halves = corpus_dedup.Halves(corpus_dedup.Tile(xs), corpus_dedup.Tile(ys), threshold)
            i, j = (np.array(v) for v in zip(*((i, j) for i in range(len(xs)) for j in range(len(ys)))))
            for x, y, passes in zip(i, j, halves.passing(i, j) if halves.useful else i < 0):
                x, y = xs[x], ys[y]
                if halves.useful and 2 * common_subsequence(x, y) >= threshold * (len(x) + len(y)):
                    calls["same"] += 1
                    assert passes
                elif halves.useful:
                    head, cut = x[: halves.first], halves.cuts[ys.index(y)]
                    assert passes == (2 * (common_subsequence(head, y[:cut]) + len(x) - len(head)) >= threshold * (len(x) + len(y)) - 1e-9)
    assert calls["same"] > 200


def test_a_family_costs_few_comparisons(monkeypatch):
    """A thousand near copies are told by about one comparison each, and templated texts that differ by their words by few."""
    calls = Counter()
    real = corpus_dedup.similar
    monkeypatch.setattr(corpus_dedup, "similar", lambda *a: calls.update(n=1) or real(*a))
    near = [f"the controller shall switch output {k:03d} off within ten milliseconds after a fault" for k in range(300)]
    links = corpus_dedup.joined(corpus_dedup.Tile(near), None, list(range(300)), 0.85)
    assert len(links) == 299 and calls["n"] < 400
    calls.clear()
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    family = [f"set {word()} of {word()} to {word()} and check {word()}" for _ in range(300)]
    assert not corpus_dedup.joined(corpus_dedup.Tile(family), None, list(range(300)), 0.85) and calls["n"] < 0.02 * 300 * 299 / 2


def test_nothing(spark):
    assert corpus_dedup.near_classes(spark.createDataFrame([], "text string")).count() == 0
    assert [tuple(r) for r in corpus_dedup.near_classes(spark.createDataFrame([("a",)], "text string")).collect()] == [("a", 1, "a", 1)]
    with pytest.raises(ValueError):
        corpus_dedup.near_classes(spark.createDataFrame([], "text string"), 0.4)


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 200), (200, 300), (7, 7)] + [(500, k) for k in range(501, 700)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100, 300: 100} | {k: 500 for k in range(500, 700)}


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(k + 1, k) for k in range(40)], "a long, b long").mapInArrow(run, "a long, b long")
    assert components(edges).count() == 41 and made.value == 40


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["g6_corpus_near_dups", "g6_turn_near_dups"])
def test_queries(spark, name):
    """All rows of the query, by all pairs of its texts."""
    got = {r.text: (r.class_text, r.class_size) for r in registry.QUERIES[name](spark, SF).collect()}
    some = sorted({c for c, n in got.values()})[:40] if name == "g6_corpus_near_dups" else sorted({c for c, _ in got.values()})
    if len(got) < 500:
        assert got == classes(sorted(got), 0.85)
    for x, y in combinations(some, 2):
        assert ratio(x, y) < 0.85
    sizes = Counter(c for c, _ in got.values())
    assert got and all(sizes[c] == n for c, n in got.values())


def test_best_of_a_group(spark):
    rows = [(1, 1, "a", "b", "c", False), (1, 2, "a", "b", "c", True), (1, 3, "a", "bb", "c", True), (1, 4, "a", "bb", "c", True)]
    cases = spark.createDataFrame(rows, "requirement_id long, idx int, action string, data string, expected_result string, valid boolean")
    groups = spark.createDataFrame([(1, k, 1) for k in range(1, 5)], "requirement_id long, idx int, anchor int")
    for keep, idx in (("best", 3), ("first", 1), ("last", 4), ("odd", 1)):
        assert [r.idx for r in dedup.kept_cases(cases, groups, keep).collect()] == [idx]
