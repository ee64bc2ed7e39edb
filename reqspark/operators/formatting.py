"""The 16-column test-case table, and comparison of two such tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOLTAGE = "1. Voltage= 12V\n2. Bat-ON"
#: Fixed values of the table.
STATIC = {
    "Test Type": "PROVEtech",
    "Issue Type": "Test",
    "Project Key": "TCTOIC",
    "Assignee": "ENGG",
    "Planned Execution": "Manual",
    "Test Case Type": "Feature Functional",
    "Components": "SW_DI_FV",
    "Labels": "AI Generated TCs",
}
COLUMNS = ["Issue ID", "Summary", "Test Type", "Issue Type", "Project Key", "Assignee", "Description", "Action", "Data", "Expected Result", "Planned Execution", "Test Case Type", "Feature Group", "Components", "Labels", "LinkTest"]


def _first(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def coalesced_fields(cases: DataFrame) -> DataFrame:
    """Adds the four fields of a case from what there is of their names; empty counts as missing."""
    col = lambda name: F.col(name) if name in cases.columns else F.lit(None).cast("string")
    return cases.withColumns(
        {
            "summary": F.coalesce(_first(col("summary"), col("summary_suffix"), col("feature_name")), F.lit("Generated Test")),
            "action": F.coalesce(_first(col("action"), col("preconditions")), F.lit(VOLTAGE)),
            "data": F.coalesce(F.when(F.trim(col("data")) != "", col("data")), _first(col("test_steps")), F.lit("N/A")),
            "expected_result": F.coalesce(col("expected_result"), F.lit("N/A")),
        }
    )


def format_steps(steps: Column) -> Column:
    """A line for each of the steps 2) to 5) in a text that starts with 1)."""
    lined = reduce(lambda s, k: F.replace(s, F.lit(f"{k})"), F.lit(f"\n{k})")), range(2, 6), F.replace(steps, F.lit(", "), F.lit("\n")))
    return F.when(steps.startswith("1)"), lined).otherwise(steps)


def issue_id(requirement_id: Column, test_id: Column, place: Column) -> Column:
    known = F.coalesce(test_id, F.format_string("TC_%03d", place))
    return F.when(F.contains(known, requirement_id), known).otherwise(F.concat_ws("_", requirement_id, known))


def jira_table(cases: DataFrame, static: dict[str, str] | None = None) -> DataFrame:
    """The table (COLUMNS) of cases with requirement_id, test_id, idx, confidence; static overrides the fixed values."""
    rows, fixed = coalesced_fields(cases), STATIC | (static or {})
    requirement = F.col("requirement_id").cast("string")
    values = {name: F.lit(value) for name, value in fixed.items()} | {
        "Issue ID": issue_id(requirement, F.col("test_id"), F.col("idx")),
        "Summary": F.concat(F.lit("["), "summary", F.lit("]")),
        "Description": F.coalesce(F.format_string("Confidence Score: %.2f", F.col("confidence")), F.lit("")),
        "Action": F.col("action"),
        "Data": format_steps(F.col("data")),
        "Expected Result": F.col("expected_result"),
        "Feature Group": F.col("summary"),
        "LinkTest": requirement,
    }
    values["Description"] = F.when(F.col("confidence").isNull(), "").otherwise(values["Description"])
    return rows.select(*(values[c].alias(c) for c in COLUMNS))


def long_description(parts: list[tuple[str, Column]], otherwise: str = "No description available") -> Column:
    """Labelled parts that are there, a blank line between them."""
    text = F.concat_ws("\n\n", *(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in parts))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(otherwise))


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """column, status (missing on the right, extra there, moved, or same), and how many rows of each side hold a value in it."""

    def profile(df: DataFrame, side: str) -> DataFrame:
        sums = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(df.columns)))
        return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias(f"{side}_place"), F.col(f"n{k}").alias(f"{side}_values")) for k, c in enumerate(df.columns)))))

    l, r = F.col("left_place"), F.col("right_place")
    status = F.when(r.isNull(), "missing").when(l.isNull(), "extra").when(l != r, "moved").otherwise("same")
    return profile(left, "left").join(profile(right, "right"), "column", "full").select("column", status.alias("status"), "left_values", "right_values")


def value_diff(left: DataFrame, right: DataFrame, key: str = "Issue ID") -> DataFrame:
    """column, compared, different: over all rows by key, for the columns of both."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    a = left.select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`").alias(f"l{k}") for k, c in enumerate(shared)))
    b = right.select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(shared)))
    sums = a.join(b, "key", "full").agg(F.count("*").alias("n"), *(F.count_if(~F.col(f"l{k}").eqNullSafe(F.col(f"r{k}"))).alias(f"d{k}") for k in range(len(shared))))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("compared"), F.col(f"d{k}").alias("different")) for k, c in enumerate(shared)))))
