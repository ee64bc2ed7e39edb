"""Semantic validation of test cases against the signal dictionary of their scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import bound, ratio

#: How signals are written.
SIGNAL = r"\b([A-Z]{3,}[A-Z0-9_]*|[A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"
DATA_SIGNAL = r"([A-Za-z_][A-Za-z0-9_]+)\s*="


def signal_dictionary(interfaces: DataFrame) -> DataFrame:
    """scope, signal: names after a dash, else the first name of three characters or more."""
    after = F.regexp_extract("text", r"-\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    plain = F.regexp_extract("text", r"\b([A-Za-z_][A-Za-z0-9_]{2,})\b", 1)
    return interfaces.select("scope", F.coalesce(F.nullif(after, F.lit("")), F.nullif(plain, F.lit(""))).alias("signal")).where("signal IS NOT NULL").distinct()


def data_text(cases: DataFrame) -> Column:
    """The data of cases, else their test_steps; a list of steps counts as lines."""
    names = [c for c in ("data", "test_steps") if c in cases.columns]
    is_list = {c: dict(cases.dtypes)[c].startswith("array") for c in names}
    return F.coalesce(*(F.array_join(c, "\n") if is_list[c] else F.col(c).cast("string") for c in names))


def used_signals(cases: DataFrame, column: str, pattern: str) -> DataFrame:
    """requirement_id, idx, scope, place, signal: every occurrence."""
    if column == "data":
        cases = cases.withColumn("data", data_text(cases))
    return cases.select("requirement_id", "idx", "scope", F.posexplode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("place", "signal"))


def unknown_signals(cases: DataFrame, dictionary: DataFrame, column: str, pattern: str) -> DataFrame:
    """Occurrences that the dictionary of the scope lacks; scopes without a dictionary are not checked."""
    checked = cases.join(dictionary.select("scope").distinct(), "scope", "left_semi")
    return used_signals(checked, column, pattern).join(dictionary, ["scope", "signal"], "left_anti")


def suggestions(unknown: DataFrame, dictionary: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """scope, signal, suggestion: the most similar name of at least cutoff (of equals the larger). Each different unknown name
    is compared once, with names whose length allows the cutoff."""
    names = unknown.select("scope", "signal").distinct()
    known = dictionary.select("scope", F.col("signal").alias("name"))
    pairs = names.join(known, "scope").where(bound(F.col("name"), F.col("signal")) >= cutoff)
    scored = pairs.withColumn("score", ratio(F.col("name"), F.col("signal"))).where(F.col("score") >= cutoff)
    return scored.groupBy("scope", "signal").agg(F.max(F.struct("score", "name"))["name"].alias("suggestion"))


def data_format_issues(cases: DataFrame) -> DataFrame:
    """requirement_id, idx, place, issue: blank data, and parts without an assignment. Data may be a list of steps."""
    cases = cases.withColumn("data", data_text(cases))
    blank = F.trim(F.coalesce("data", F.lit(""))) == ""
    parts = F.filter(F.split("data", ","), lambda p: ~F.contains(p, F.lit("=")))
    missing = F.transform(parts, lambda p: F.concat(F.lit("Data part '"), F.trim(p), F.lit("' missing '=' assignment")))
    issues = F.when(blank, F.array(F.lit("Data field is empty"))).when(F.contains("data", F.lit("=")), missing).otherwise(F.array().cast("array<string>"))
    return cases.select("requirement_id", "idx", F.posexplode(issues).alias("place", "issue"))


def verdicts(cases: DataFrame, dictionary: DataFrame) -> DataFrame:
    """requirement_id, idx, issues (texts: signals of the action, of the data, form of the data), valid; all cases of a scope without
    a dictionary are valid."""
    checked = cases.join(dictionary.select("scope").distinct(), "scope", "left_semi")
    action, data = unknown_signals(cases, dictionary, "action", SIGNAL), unknown_signals(cases, dictionary, "data", DATA_SIGNAL)
    close = suggestions(action.select("scope", "signal").union(data.select("scope", "signal")), dictionary)
    every = dictionary.groupBy("scope").agg(F.array_join(F.sort_array(F.collect_set("signal")), ", ").alias("names"))
    signal, meant = F.col("signal"), F.col("suggestion")
    meant_text = lambda where: F.concat(F.lit("Signal '"), signal, F.lit(f"' in {where} not found. Did you mean '"), meant, F.lit("'?"))
    foreign = F.concat(F.lit("Signal '"), signal, F.lit("' in action not in interface dictionary. Valid signals: "), F.col("names"))
    texts = lambda rows, kind, text: rows.select("requirement_id", "idx", F.struct(F.lit(kind).alias("kind"), F.col("place"), text.alias("text")).alias("issue"))
    issues = (
        texts(action.join(close, ["scope", "signal"], "left").join(every, "scope"), 0, F.coalesce(meant_text("action"), foreign))
        .union(texts(data.join(close, ["scope", "signal"]), 1, meant_text("data/test_steps")))
        .union(texts(data_format_issues(checked), 2, F.col("issue")))
    )
    listed = issues.groupBy("requirement_id", "idx").agg(F.transform(F.sort_array(F.collect_list("issue")), lambda x: x["text"]).alias("issues"))
    rows = cases.select("requirement_id", "idx", "summary").join(listed, ["requirement_id", "idx"], "left")
    return rows.select("requirement_id", "idx", "summary", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), F.col("issues").isNull().alias("valid"))


def validation_report(verdicts_: DataFrame, coverage: DataFrame) -> DataFrame:
    """requirement_id, total, valid, invalid (table issues included), rate, issues (index, summary, texts; index -1: of the table),
    from verdicts and table_coverage."""
    issue = lambda index, summary, texts: F.struct(index.alias("index"), summary.alias("summary"), texts.alias("issues"))
    listed = F.sort_array(F.collect_list(F.when(~F.col("valid"), issue(F.col("idx"), F.col("summary"), F.col("issues")))))
    sums = verdicts_.groupBy("requirement_id").agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), listed.alias("own"))
    rows = sums.join(coverage.select("requirement_id", F.col("texts").alias("tables")), "requirement_id", "left")
    tables = F.transform(F.coalesce("tables", F.array().cast("array<struct<summary:string,text:string>>")), lambda t: issue(F.lit(-1), t["summary"], F.array(t["text"])))
    return rows.select(
        "requirement_id", "total", "valid", (F.col("total") - F.col("valid") + F.size(tables)).alias("invalid"), F.round(F.col("valid") / F.col("total"), 6).alias("rate"),
        F.concat("own", tables).alias("issues"),
    )


def table_coverage(cases: DataFrame, tables: DataFrame) -> DataFrame:
    """For requirements with table rows (columns requirement_id, table_rows): coverage figures, names and texts of issues."""
    sums = cases.groupBy("requirement_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("test_type") == "positive").alias("positive"), F.count_if(F.col("test_type") == "negative").alias("negative")
    )
    rows = tables.where("table_rows > 0").join(sums, "requirement_id", "left").fillna(0, ["total", "positive", "negative"])
    n = F.col("table_rows")
    told = lambda summary, *parts: F.struct(F.lit(summary).alias("summary"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("positive") < n, told("Table Coverage Deficiency", "Generated ", F.col("positive"), " positive test cases but table has ", n, " rows. Required: at least one positive test per table row.")),
            F.when(F.col("negative") < 3, told("Negative Test Deficiency", "Generated ", F.col("negative"), " negative test cases but minimum 3 required for table-based requirements.")),
            F.when(F.col("total") < n + 3, told("Total Test Case Count", "Generated ", F.col("total"), " test cases. Expected minimum: ", n + 3, " (", n, " positive + 3 negative). Expected maximum: ", n + 8, ".")),
        )
    )
    return rows.select(
        "requirement_id", "table_rows", "total", "positive", "negative", F.transform(issues, lambda x: x["summary"]).alias("issues"), issues.alias("texts"), F.round(F.col("positive") / n * 100, 6).alias("coverage"),
        ((F.col("positive") >= n) & (F.col("negative") >= 3)).alias("adequate"), (n + 3).alias("expected_min"), (n + 8).alias("expected_max"),
    )
