"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import difflib
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from reqspark.operators import dedup
from reqspark.plans import registry
from reqspark.sources import adapters

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert got and got == want


def test_no_query_without_a_test():
    """What has no SQL is tested against brute force below."""
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"f3_data_signals", "f4_suggest_signal", "f6_case_verdict", "f7_validation_report", "g2_duplicate_groups", "g5_similar_pairs", "g6_corpus_near_dups", "g6_turn_near_dups"}


@pytest.fixture(scope="module")
def cases(spark):
    return sorted(adapters.cases(spark, SF).collect(), key=lambda r: (r.requirement_id, r.idx))


@pytest.fixture(scope="module")
def names(spark):
    out = {}
    for r in adapters.interfaces(spark, SF).collect():
        out.setdefault(r.scope, set()).add(re.search(r"-\s+([A-Za-z_][A-Za-z0-9_]*)", r.text)[1])
    return out


def closest(signal, known):
    """difflib's choice, of equals the larger."""
    found = difflib.get_close_matches(signal, known, n=1, cutoff=0.8)
    return found[0] if found else None


def odd_signals(case, known, column):
    pattern = r"([A-Za-z_][A-Za-z0-9_]+)\s*=" if column == "data" else r"\b([A-Z]{3,}[A-Z0-9_]*|[A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"
    return [x for x in re.findall(pattern, case[column]) if x not in known]


def test_signals_and_suggestions(spark, cases, names):
    want = Counter((c.requirement_id, c.idx, c.scope, x, closest(x, names[c.scope])) for c in cases for x in odd_signals(c, names[c.scope], "data") if closest(x, names[c.scope]))
    assert Counter(map(tuple, registry.QUERIES["f3_data_signals"](spark, SF).select("requirement_id", "idx", "scope", "signal", "suggestion").collect())) == want
    want = {(c.scope, x, closest(x, names[c.scope])) for c in cases for x in odd_signals(c, names[c.scope], "action") if closest(x, names[c.scope])}
    assert {(r.scope, r.signal, r.suggestion) for r in registry.QUERIES["f4_suggest_signal"](spark, SF).collect()} == want


def issues_of(case, known):
    out = []
    for x in odd_signals(case, known, "action"):
        meant = closest(x, known)
        out.append(f"Signal '{x}' in action not found. Did you mean '{meant}'?" if meant else f"Signal '{x}' in action not in interface dictionary. Valid signals: {', '.join(sorted(known))}")
    out += [f"Signal '{x}' in data/test_steps not found. Did you mean '{closest(x, known)}'?" for x in odd_signals(case, known, "data") if closest(x, known)]
    if not case["data"].strip():
        return [*out, "Data field is empty"]
    return out + [f"Data part '{p.strip()}' missing '=' assignment" for p in case["data"].split(",") if "=" in case["data"] and "=" not in p]


def test_verdicts_and_report(spark, cases, names):
    got = {(r.requirement_id, r.idx): (r.issues, r.valid) for r in registry.QUERIES["f6_case_verdict"](spark, SF).collect()}
    want = {(c.requirement_id, c.idx): issues_of(c, names[c.scope]) for c in cases}
    assert got == {k: (v, not v) for k, v in want.items()} and any(want.values()) and not all(want.values())
    by = {}
    for c in cases:
        by.setdefault(c.requirement_id, []).append(c)
    reports = {r.requirement_id: r for r in registry.QUERIES["f7_validation_report"](spark, SF).collect()}
    assert set(reports) == set(by)
    for k, mine in by.items():
        own = [(c.idx, c.summary, want[k, c.idx]) for c in mine if want[k, c.idx]]
        rows, plus, minus = k % 4, sum(c.test_type == "positive" for c in mine), sum(c.test_type == "negative" for c in mine)
        table = []
        if rows and plus < rows:
            table.append((-1, "Table Coverage Deficiency", [f"Generated {plus} positive test cases but table has {rows} rows. Required: at least one positive test per table row."]))
        if rows and minus < 3:
            table.append((-1, "Negative Test Deficiency", [f"Generated {minus} negative test cases but minimum 3 required for table-based requirements."]))
        if rows and len(mine) < rows + 3:
            table.append((-1, "Total Test Case Count", [f"Generated {len(mine)} test cases. Expected minimum: {rows + 3} ({rows} positive + 3 negative). Expected maximum: {rows + 8}."]))
        r = reports[k]
        assert (r.total, r.valid, r.invalid) == (len(mine), len(mine) - len(own), len(own) + len(table))
        assert [tuple(x) for x in r.issues] == own + table and abs(r.rate - (len(mine) - len(own)) / len(mine)) < 1e-6


def similarity(a, b):
    total = 0.0
    for f in ("action", "data", "expected_result"):
        x, y = a[f].lower().strip(), b[f].lower().strip()
        total += 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    return total / 3


def test_groups_and_pairs(spark, cases):
    by, anchors, pairs = {}, {}, {}
    for c in cases:
        by.setdefault(c.requirement_id, []).append(c)
    for k, mine in by.items():
        taken = {}
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                s = similarity(a, b)
                if s >= 0.7:
                    pairs[k, a.idx, b.idx] = (round(s, 12), a.summary, b.summary)
                if a.idx not in taken and b.idx not in taken and s >= 0.85:
                    taken[b.idx] = a.idx
        anchors |= {(k, c.idx): taken.get(c.idx, c.idx) for c in mine}
    assert {(r.requirement_id, r.idx): r.anchor for r in registry.QUERIES["g2_duplicate_groups"](spark, SF).collect()} == anchors
    got = registry.QUERIES["g5_similar_pairs"](spark, SF).collect()
    assert {(r.requirement_id, r.a, r.b): (round(r.similarity, 12), r.summary_a, r.summary_b) for r in got} == pairs and len(got) == len(pairs) > 0
    assert [r.similarity for r in got] == sorted((r.similarity for r in got), reverse=True)
