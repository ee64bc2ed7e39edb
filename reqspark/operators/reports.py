"""Reports of runs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _ratio(a, b, digits: int, factor: float = 1.0):
    return F.when(b > 0, F.round(a / b * factor, digits)).otherwise(0.0)


def file_report(requirements: DataFrame, cases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """For each source_file of requirements (source_file, requirement_id, error_type, seconds) and their cases; artifacts
    (source_file, type, text) are counted by type, and their requirements without text as skipped."""
    tests = cases.groupBy("requirement_id").agg(F.count_if(F.col("test_type") == "positive").alias("p"), F.count_if(F.col("test_type") == "negative").alias("n"))
    rows = requirements.join(tests, "requirement_id", "left").fillna(0, ["p", "n"])
    ok = F.col("error_type") == "ok"
    sums = rows.groupBy("source_file").agg(
        F.count("*").alias("requirements"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.sum(F.when(ok, F.col("p")).otherwise(0)).alias("positive"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("negative"), F.sum("seconds").alias("seconds"),
    )
    tests_ = F.col("positive") + F.col("negative")
    blank = (F.col("type") == "System Requirement") & (F.trim(F.coalesce("text", F.lit(""))) == "")
    kinds = artifacts.groupBy("source_file", "type").agg(F.count("*").alias("n"), F.count_if(blank).alias("skipped"))
    kinds = kinds.groupBy("source_file").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("artifacts"), F.sum("n").alias("n_artifacts"), F.sum("skipped").alias("skipped"))
    sums = sums.join(kinds, "source_file", "left").fillna(0, ["n_artifacts", "skipped"])
    return sums.select(
        "source_file", "requirements", "successful", "failed", "positive", "negative", _ratio(tests_, F.col("successful"), 2).alias("tests_per_requirement"),
        _ratio(F.col("successful"), F.col("requirements"), 1, 100.0).alias("success_percent"), _ratio(F.col("requirements"), F.col("seconds"), 2).alias("per_second"),
        _ratio(F.col("seconds"), F.col("requirements"), 2).alias("mean_seconds"), F.coalesce("artifacts", F.create_map().cast("map<string,bigint>")).alias("artifacts"), "n_artifacts", "skipped",
    )


def failure_details(requirements: DataFrame) -> DataFrame:
    """source_file, requirement_id, error, at of each requirement (with error_type and at) that failed."""
    return requirements.where("error_type <> 'ok'").select("source_file", "requirement_id", F.col("error_type").alias("error"), "at")


def file_warnings(requirements: DataFrame) -> DataFrame:
    """source_file, warning, n, first: each different one of the warnings (an array a requirement) of a file once, with how many
    requirements have it and the first of them."""
    each = requirements.select("source_file", "requirement_id", F.explode(F.array_distinct("warnings")).alias("warning"))
    return each.groupBy("source_file", "warning").agg(F.count("*").alias("n"), F.min("requirement_id").alias("first"))


def write_observed(requirements: DataFrame, folder: str) -> DataFrame:
    """Writes requirements (error_type, seconds) and gives one row of totals, collected in the pass that writes: nothing is read
    again. A task that runs twice counts once."""
    ok, seen = F.col("error_type") == "ok", Observation()
    totals = [
        F.count("*").alias("requirements"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum("seconds"), F.lit(0)).cast("long").alias("seconds"),
        F.max("seconds").cast("long").alias("slowest"),
    ]
    requirements.observe(seen, *totals).write.parquet(folder)
    got = seen.get
    schema = "requirements long, successful long, failed long, seconds long, slowest long"
    rows = requirements.sparkSession.createDataFrame([[got[c.split()[0]] for c in schema.split(", ")]], schema)
    return rows.withColumn("success", F.col("successful") > 0)


def session_metrics(logs: DataFrame) -> DataFrame:
    """For each session of logs (session_id, ts, level, event_type, success, tests, uptime)."""
    done = (F.col("event_type") == "purchase") & F.col("success")
    return logs.groupBy("session_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"), F.count_if(F.col("level") == "WARNING").alias("warnings"),
        F.count_if(done).alias("files"), F.sum(F.when(done, F.col("tests")).otherwise(0)).alias("tests"), F.max_by("uptime", F.struct("ts", "event_id")).alias("last_uptime"),
    )


def final_metrics(logs: DataFrame) -> DataFrame:
    """session_id, records, keys (different ones of extra, sorted), files, tests, peak_cpu: the last final_metrics of each session of open
    logs (ts, session_id, extra, final_metrics)."""
    of = lambda path, kind: F.try_variant_get(F.col("last"), path, kind)
    names = F.json_object_keys(F.to_json("extra"))
    rows = logs.groupBy("session_id").agg(
        F.count("*").alias("records"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))).alias("keys"),
        F.max(F.when(F.col("final_metrics").isNotNull(), F.struct("ts", F.to_json("final_metrics").alias("json")))).alias("latest"),
    )
    rows = rows.withColumn("last", F.try_parse_json("latest.json"))
    return rows.select("session_id", "records", "keys", of("$.files_processed", "long").alias("files"), of("$.test_cases_generated", "long").alias("tests"), of("$.performance_stats.peak_cpu_percent", "double").alias("peak_cpu"))


def run_performance(samples: DataFrame) -> DataFrame:
    """Success share, mean and peak of the samples (success, value)."""
    return samples.agg(F.round(F.avg(F.col("success").cast("double")) * 100, 1).alias("success_percent"), F.round(F.avg("value"), 1).alias("mean"), F.round(F.max("value"), 1).alias("peak"))


def directory_result(report: DataFrame) -> DataFrame:
    return report.agg(F.bool_or(F.col("successful") > 0).alias("success"), F.count("*").alias("files"), F.sum("requirements").alias("requirements"), F.sum(F.col("positive") + F.col("negative")).alias("tests"))


def extraction_audit(artifacts: DataFrame, requirements: DataFrame) -> DataFrame:
    """source_file, artifacts, types, varied (two types or more), requirements, how many have text and tables, tables in them, infos,
    interfaces, and how many infos the requirements with context (source_file, info) have: mean and most."""
    is_ = lambda t: F.col("type") == t
    tables = F.regexp_count("text", F.lit(r"(?i)<(?:\w+:)?table\b"))
    mine = is_("System Requirement")
    sums = artifacts.groupBy("source_file").agg(
        F.count("*").alias("artifacts"), F.countDistinct("type").alias("types"), F.count_if(mine).alias("requirements"), F.count_if(mine & (F.col("text") != "")).alias("with_text"),
        F.count_if(mine & (tables > 0)).alias("with_tables"), F.coalesce(F.sum(F.when(mine, tables)), F.lit(0)).cast("long").alias("tables"),
        F.count_if(is_("Information")).alias("infos"), F.count_if(is_("System Interface")).alias("interfaces"),
    )
    context = requirements.groupBy("source_file").agg(F.round(F.avg(F.size("info")), 6).alias("infos_per_requirement"), F.max(F.size("info")).cast("long").alias("most_infos"))
    return sums.withColumn("varied", F.col("types") >= 2).join(context, "source_file", "left").fillna(0, ["infos_per_requirement", "most_infos"])
