"""Single operators on small rows."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reqspark.functions import responses as R
from reqspark.functions.text import clean_text, is_blank, map_type
from reqspark.operators import context, dedup, formatting, graph, prompts, quality, validate
from reqspark.streaming import jobs


def artifacts(spark):
    rows = [
        ("f", 1, "H1", "Heading", "<p>Section 1</p>"), ("f", 2, "INFO_001", "Information", "Info for REQ_001"), ("f", 3, "REQ_001", "System Requirement", "First requirement"),
        ("f", 4, "INFO_002", "Information", "Info for REQ_002"), ("f", 5, "REQ_000", "System Requirement", "<p> </p>"), ("f", 6, "REQ_002", "System Requirement", "Second requirement"),
        ("f", 7, "IF", "System Interface", "CANSignal - ACCSP"), ("g", 1, "REQ_003", "System Requirement", "Alone"), ("f", 8, "H2", "Heading", ""), ("f", 9, "REQ_004", "System Requirement", "Last"),
    ]
    return spark.createDataFrame(rows, "source_file string, seq long, id string, type string, text string")


def test_context_is_the_same_for_every_chunk_size(spark):
    for chunk in (1, 2, 3, 100):
        rows = {r.id: r for r in context.augment_requirements(artifacts(spark), chunk).collect()}
        assert {k: (r.heading, [i.id for i in r.info], r.n_interfaces) for k, r in rows.items()} == {
            "REQ_001": ("Section 1", ["INFO_001"], 1), "REQ_002": ("Section 1", ["INFO_002"], 1), "REQ_003": ("No Heading", [], 0), "REQ_004": ("No Heading", [], 1),
        }


def test_blank_is_what_cleaning_leaves_empty(spark):
    texts = [None, "", " \n", "<p> </p>", "<p>x</p>", "<", "<>", "<a <b>", "<a", "< >\t<br/>", "<p>\u00a0</p>", "a", "<p></p>." , "<!-- x -->", "<a\n>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_blank(F.col("t")).alias("b"), (clean_text(F.col("t")) == "").alias("c")).collect()
    assert [r.b for r in rows] == [r.c for r in rows] and any(r.b for r in rows) and not all(r.b for r in rows)


def test_interfaces_of_the_file(spark):
    rows = {r.id: [(i.id, i.text) for i in r.interfaces] for r in context.augment_requirements(artifacts(spark)).collect()}
    assert rows == {"REQ_001": [("IF", "CANSignal - ACCSP")], "REQ_002": [("IF", "CANSignal - ACCSP")], "REQ_003": [], "REQ_004": [("IF", "CANSignal - ACCSP")]}


def test_types_and_texts(spark):
    row = spark.range(1).select(
        map_type(F.lit("Design Information")).alias("a"), map_type(F.lit("Design Information"), strict=True).alias("b"), map_type(F.lit(None).cast("string")).alias("c"),
        clean_text(F.lit(" <a>x</a>\t\n y ")).alias("d"), clean_text(F.lit(None).cast("string")).alias("e"),
    ).first()
    assert tuple(row) == ("Information", "Design Information", "Unknown", "x y", "")


def test_levels_of_a_chain_and_a_cycle(spark):
    rows = [("f", c, p) for c, p in (("B", "A"), ("C", "B"), ("D", "C"), ("X", "Y"), ("Y", "Z"), ("Z", "X"))]
    levels = {r.id: r.level for r in graph.hierarchy_levels(spark.createDataFrame(rows, "source_file string, id string, parent_id string")).collect()}
    assert levels == {"B": 1, "C": 2, "D": 3, "X": 10, "Y": 10, "Z": 10}


def test_parse_response(spark):
    cases = [
        ('{"test_cases": [{"a": 1}]}', '{"test_cases": [{"a": 1}]}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ("no { json", None), ("  ", None),
        ('some {"b": {"c": 2}} text', '{"b": {"c": 2}}'), ("[1, 2]", "[1, 2]"), ('"test_cases": [1]', '{"test_cases": [1]}'),
    ]
    rows = spark.createDataFrame([(a,) for a, _ in cases], "r string").select(R.parse_response(F.col("r")).alias("p")).collect()
    assert [r.p for r in rows] == [b for _, b in cases]


def case_rows(spark, texts):
    return spark.createDataFrame([(1, i + 1, t, t, "") for i, t in enumerate(texts)], "requirement_id long, idx int, action string, data string, expected_result string")


def greedy(texts, threshold):
    anchors, out = [], {}
    for i, t in enumerate(texts):
        if i in out:
            continue
        out[i] = i
        for j in range(i + 1, len(texts)):
            if j not in out:
                ratio = 1.0 if t == texts[j] else SequenceMatcher(None, t, texts[j]).ratio()
                if (2 * ratio + 1) / 3 >= threshold:
                    out[j] = i
        anchors.append(i)
    return [out[i] + 1 for i in range(len(texts))]


def test_duplicate_groups_match_brute_force(spark):
    texts = ["send speed value one", "send speed value two", "send speed value tw", "other thing", "Other Thing ", "send speed valve one", "zzz"]
    plain = [t.strip().lower() for t in texts]
    for threshold in (0.85, 0.95, 1.0):
        got = {r.idx: r.anchor for r in dedup.duplicate_groups(case_rows(spark, texts), threshold).collect()}
        assert [got[i + 1] for i in range(len(texts))] == greedy(plain, threshold)


def test_dedup_report(spark):
    groups = dedup.duplicate_groups(case_rows(spark, ["a", "a", "A", "a ", "b"]))
    row = dedup.dedup_report(groups).first()
    assert (row.original, row.kept, row.removed, row.rate) == (5, 2, 3, 0.6)


def test_suggestions(spark):
    names = spark.createDataFrame([("s", "ACCSP"), ("s", "IgnMode")], "scope string, signal string")
    unknown = spark.createDataFrame([("s", "ACCSP1"), ("s", "NOTHING")], "scope string, signal string")
    assert [tuple(r) for r in validate.suggestions(unknown, names).collect()] == [("s", "ACCSP1", "ACCSP")]


def test_formats(spark):
    row = spark.range(1).select(formatting.format_steps(F.lit("1) a, 2) b")).alias("a"), formatting.issue_id(F.lit("R1"), F.lit(None).cast("string"), F.lit(7)).alias("b")).first()
    assert tuple(row) == ("1) a\n\n2) b", "R1_TC_007")
    assert spark.range(1).select(prompts.image_context(F.array(F.lit("png"), F.lit(None), F.lit("PNG"))).alias("t")).first().t.startswith("3 diagram(s) attached (PNG, UNKNOWN). \n\nWhen analyzing the diagrams:\n1. DESCRIBE")


@pytest.mark.parametrize("n", [1, 20, 21, 50, 51, 120, 1005])
def test_table_texts(spark, n):
    rows = [("t", k, f"v{k}", k if k % 3 else None) for k in range(n)]
    frame = spark.createDataFrame(rows, "name string, k int, a string, b int")
    text = prompts.table_texts(frame, "name", "k", {"a": F.col("a"), "b": F.col("b")}).first().text
    lines = [f"{a} | {'' if b is None else b}" for _, _, a, b in rows]
    numbered = [f"R{i:02d}: {x}" for i, x in enumerate(lines, 1)]
    body = [f"{x} | Row {i}" for i, x in enumerate(lines, 1)] if n <= 20 else numbered if n <= 50 else [*numbered[:10], f"... (showing first 10 and last 10 of {n} total rows) ...", *numbered[-10:]]
    assert text == "Table Data:\na | b\n-----\n" + "\n".join(body) + f"\n\nTable contains {n} rows total."


@pytest.mark.parametrize(
    ("response", "want"),
    [
        ('{"a":1} and {"b":2}', '{"a":1}'),
        ("[1] x [2]", None),
        ('{"a":1}, {"b":2}', '{"a":1}'),
        ('{"a":1}, "b": {"c":2}', '{"a":1}'),
        ("[1]], [[2]", None),
        ('{"a":1}} {"b":2}', '{"a":1}'),
        (' [1, 2]\n', "[1, 2]"),
        ("12", "12"),
        ('x ```json\n{"a": {"b": 1}}\n``` y', '{"a": {"b": 1}}'),
        ("```\n[1]\n```", None),
        ('text {"bad": } {"a": {"b": 2}} end', '{"a": {"b": 2}}'),
        ('"TEST_CASES": [1, 2', None),
        ('say "test_cases" : [1, 2] and "test_cases": [3]', '{"test_cases": [1, 2]}'),
        ("  ", None),
        ("no json", None),
        (None, None),
    ],
)
def test_parse_response(spark, response, want):
    row = spark.createDataFrame([(response,)], "t string").select(R.parse_response(F.col("t")).alias("p")).first()
    assert row.p == want


def test_paths_of_any_depth(spark):
    edges = [(k, f"n{k}", f"n{k + 1}") for k in range(25)] + [(50, "n3", "n1"), (51, "n25", "n25")]
    relations = spark.createDataFrame([("f", k, f"r{k}", a, b, "is parent of") for k, a, b in edges], "source_file string, seq long, id string, source_id string, target_id string, relation_type_name string")
    nodes = graph.nodes_of(relations).withColumn("text", F.repeat("id", 100))
    got = graph.requirement_paths(nodes, relations).collect()
    assert sorted((r.depth, r.id, "/".join(r.path), r.text) for r in got) == sorted((k, f"n{k}", "/".join(f"n{i}" for i in range(k + 1)), (f"n{k}" * 100)[:100]) for k in range(26))


def test_steps_as_a_list_and_no_dictionary(spark):
    cases = spark.createDataFrame([(1, 1, "s", "a", "Set ABCDEF", ["ABCDEG = 1", "x"]), (1, 2, "t", "b", "Set ABCD", [""])], "requirement_id long, idx int, scope string, summary string, action string, test_steps array<string>")
    names = spark.createDataFrame([("s", "ABCDEF")], "scope string, signal string")
    got = {r.idx: (r.issues, r.valid) for r in validate.verdicts(cases, names).collect()}
    assert got[1] == (["Signal 'ABCDEG' in data/test_steps not found. Did you mean 'ABCDEF'?"], False)
    assert got[2] == ([], True)


def test_upper_median_and_places(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 10, 101):
        values = [rng.choice([0.1, 0.25, 0.2501, 0.7, rng.random()]) for _ in range(n)]
        frame = spark.createDataFrame([(k, v, 0.0, 1.0) for k, v in enumerate(values)], "example_id long, overall double, complexity double, diversity double")
        assert quality.upper_median(frame) == sorted(values)[n // 2]
        places = {r.example_id: r.place for r in quality.curriculum_phases(frame).collect()}
        assert places == {k: i for i, (_, k) in enumerate(sorted((-v, k) for k, v in enumerate(values)), 1)}
    assert quality.upper_median(frame.limit(0)) is None


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    from datetime import datetime

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    for k, rows in enumerate([[(at(1), "a"), (at(2), "a")], [(at(9), "a")], [(at(9, 1), "a")], [(at(1, 30), "a"), (at(9, 5), "a")]]):
        spark.createDataFrame(rows, "ts timestamp, event_type string").coalesce(1).write.parquet(f"{tmp_path}/{k}")
        time.sleep(1.1)  # files are read in the order of their times
    schema = spark.read.parquet(f"{tmp_path}/0").schema
    got = {r.window_start.hour: r.n for r in jobs.session_windows(spark, f"{tmp_path}/*", schema, files=1).collect()}
    assert got == {1: 1, 2: 1, 9: 3}  # late rows are those before the watermark of the batch before
