"""Queries over responses and test cases, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses as R
from ..functions.tables import with_once
from ..operators import dedup, formatting, validate
from ..sources import adapters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


C = f"WITH {adapters.CASES}"
DICT = rf"""{C}, {adapters.INTERFACES}, dict AS (SELECT DISTINCT scope, regexp_extract(text, '-\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS signal FROM interfaces)"""


def _parsed(spark, sf_dir):
    return with_once(adapters.responses(spark, sf_dir), "parsed", R.parse_response(F.col("response")))


@query("b9_parse_response", f"""{C} SELECT requirement_id, requirement_id % 5 <> 4 AS parsed, CASE WHEN requirement_id % 5 < 3 THEN count(*) ELSE -1 END AS n_cases FROM cases GROUP BY requirement_id""")
def b9(spark, sf_dir):
    n = F.coalesce(F.size(R.cases_of(F.col("parsed"))), F.lit(-1)).cast("long")
    return _parsed(spark, sf_dir).select("requirement_id", F.col("parsed").isNotNull().alias("parsed"), n.alias("n_cases"))


@query("b10_check_structure", f"{C} SELECT DISTINCT requirement_id, requirement_id % 5 < 3 AS structured FROM cases")
def b10(spark, sf_dir):
    return _parsed(spark, sf_dir).select("requirement_id", R.has_structure(F.col("parsed")).alias("structured"))


@query("b11_explode_cases", f"{C} SELECT requirement_id, idx, summary, action, data, expected_result, test_type FROM cases WHERE requirement_id % 5 < 3")
def b11(spark, sf_dir):
    rows = _parsed(spark, sf_dir).select("requirement_id", F.posexplode(R.cases_of(F.col("parsed"))).alias("at", "case"))
    return rows.select("requirement_id", (F.col("at") + 1).alias("idx"), "case.*")


@query("b12_response_triage", f"""{C} SELECT CASE requirement_id % 5 WHEN 4 THEN 'EmptyResponse' WHEN 3 THEN 'InvalidJSONStructure' ELSE 'ok' END AS error_type, count(DISTINCT requirement_id) AS n FROM cases GROUP BY 1""")
def b12(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy(R.triage(F.col("response"), F.col("parsed")).alias("error_type")).agg(F.count("*").alias("n"))


@query("b13_confidence", f"{C} SELECT requirement_id, CASE WHEN requirement_id % 4 < 3 THEN round(exp(avg(-idx / 10.0)), 6) END AS confidence FROM cases GROUP BY 1")
def b13(spark, sf_dir):
    """Log probabilities in the three shapes that models write, or none."""
    key = F.col("requirement_id") % 4
    objects = F.transform("logprobs", lambda x: F.struct(F.lit("t").alias("token"), x.alias("logprob")))
    shape = F.when(key == 0, F.to_json("logprobs")).when(key == 1, F.to_json(objects)).when(key == 2, F.to_json(F.struct(F.col("logprobs").alias("token_logprobs")))).otherwise('{"other": []}')
    rows = adapters.responses(spark, sf_dir).select("requirement_id", R.logprobs_of(shape).alias("logprobs"))
    return rows.select("requirement_id", F.round(R.confidence(F.col("logprobs")), 6).alias("confidence"))


def _both(spark, sf_dir):
    return adapters.cases(spark, sf_dir), validate.signal_dictionary(adapters.interfaces(spark, sf_dir))


def _tables(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("requirement_id"), (F.col("o_orderkey") % 4).cast("int").alias("table_rows"))


@query("f1_signal_dictionary", f"{DICT} SELECT * FROM dict")
def f1(spark, sf_dir):
    return validate.signal_dictionary(adapters.interfaces(spark, sf_dir))


@query("f2_action_signals", f"""{DICT}, used AS (SELECT requirement_id, idx, scope, unnest(regexp_extract_all(action, '{validate.SIGNAL}', 1)) AS signal FROM cases)
SELECT * FROM used u WHERE NOT EXISTS (SELECT 1 FROM dict d WHERE d.scope = u.scope AND d.signal = u.signal)""")
def f2(spark, sf_dir):
    return validate.unknown_signals(*_both(spark, sf_dir), "action", validate.SIGNAL).select("requirement_id", "idx", "scope", "signal")


@query("f3_data_signals")
def f3(spark, sf_dir):
    cases, names = _both(spark, sf_dir)
    odd = validate.unknown_signals(cases, names, "data", validate.DATA_SIGNAL)
    return odd.join(validate.suggestions(odd, names), ["scope", "signal"]).select("requirement_id", "idx", "scope", "signal", "suggestion")


@query("f4_suggest_signal")
def f4(spark, sf_dir):
    cases, names = _both(spark, sf_dir)
    return validate.suggestions(validate.unknown_signals(cases, names, "action", validate.SIGNAL), names)


@query("f5_data_format", f"""{C} SELECT requirement_id, idx, 'Data field is empty' AS issue FROM cases WHERE trim(data) = '' UNION ALL
SELECT requirement_id, idx, 'Data part ''' || trim(p) || ''' missing ''='' assignment' FROM (SELECT requirement_id, idx, unnest(string_split(data, ',')) AS p FROM cases WHERE contains(data, '=')) WHERE NOT contains(p, '=')""")
def f5(spark, sf_dir):
    return validate.data_format_issues(adapters.cases(spark, sf_dir)).drop("place")


@query("f6_case_verdict")
def f6(spark, sf_dir):
    return validate.verdicts(*_both(spark, sf_dir))


@query("f7_validation_report")
def f7(spark, sf_dir):
    cases, names = _both(spark, sf_dir)
    return validate.validation_report(validate.verdicts(cases, names), validate.table_coverage(cases, _tables(spark, sf_dir)))


@query("f8_table_coverage", f"""{C}, s AS (SELECT requirement_id, count(*) AS total, count(*) FILTER (test_type = 'positive') AS positive, count(*) FILTER (test_type = 'negative') AS negative FROM cases GROUP BY 1),
t AS (SELECT o_orderkey AS requirement_id, (o_orderkey % 4)::INT AS n FROM orders WHERE o_orderkey % 4 > 0),
r AS (SELECT t.requirement_id, n, coalesce(total, 0) AS total, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative FROM t LEFT JOIN s USING (requirement_id))
SELECT requirement_id, n AS table_rows, total, positive, negative, concat_ws(',', CASE WHEN positive < n THEN 'Table Coverage Deficiency' END, CASE WHEN negative < 3 THEN 'Negative Test Deficiency' END,
CASE WHEN total < n + 3 THEN 'Total Test Case Count' END) AS issues, round(positive / n * 100, 6) AS coverage, positive >= n AND negative >= 3 AS adequate, n + 3 AS expected_min, n + 8 AS expected_max FROM r""")
def f8(spark, sf_dir):
    return validate.table_coverage(adapters.cases(spark, sf_dir), _tables(spark, sf_dir)).withColumn("issues", F.array_join("issues", ",")).drop("texts")


@query("g2_duplicate_groups")
def g2(spark, sf_dir):
    return dedup.duplicate_groups(adapters.cases(spark, sf_dir), parts=adapters.case_parts(spark, sf_dir))


@query("g5_similar_pairs")
def g5(spark, sf_dir):
    return dedup.described_pairs(adapters.cases(spark, sf_dir), parts=adapters.case_parts(spark, sf_dir))


@query("g6_corpus_near_dups")
def g6(spark, sf_dir):
    return dedup.corpus_near_dups(adapters.cases(spark, sf_dir))


@query("g6_turn_near_dups")
def g6_turns(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return dedup.corpus_near_dups(turns, fields=("text",))


SAME = f"""{C}, grouped AS (SELECT *, min(idx) OVER (PARTITION BY requirement_id, trim(lower(action)), trim(lower(data)), trim(lower(expected_result))) AS anchor FROM cases)"""


@query("g1_equal_groups", f"{SAME} SELECT requirement_id, idx, anchor FROM grouped")
def g1(spark, sf_dir):
    return dedup.duplicate_groups(adapters.cases(spark, sf_dir), threshold=1.0, parts=adapters.case_parts(spark, sf_dir))


@query("g3_keep_last", f"{SAME} SELECT requirement_id, max(idx) AS idx FROM grouped GROUP BY requirement_id, anchor")
def g3(spark, sf_dir):
    cases, parts = adapters.cases(spark, sf_dir), adapters.case_parts(spark, sf_dir)
    return dedup.kept_cases(cases, dedup.duplicate_groups(cases, threshold=1.0, parts=parts), keep="last", parts=parts).select("requirement_id", "idx")


@query("g4_dedup_report", f"""{SAME}, e AS (SELECT requirement_id, anchor, count(*) AS n FROM grouped GROUP BY ALL)
SELECT requirement_id, sum(n)::BIGINT AS original, count(*) AS kept, count(*) FILTER (n > 1) AS groups, (sum(n) - count(*))::BIGINT AS removed, round((sum(n) - count(*)) / sum(n), 6) AS rate FROM e GROUP BY 1""")
def g4(spark, sf_dir):
    parts = adapters.case_parts(spark, sf_dir)
    return dedup.dedup_report(dedup.duplicate_groups(adapters.cases(spark, sf_dir), threshold=1.0, parts=parts), parts)


@query("g7_number_cases", f"{C} SELECT requirement_id, idx, printf('%s_TC_%03d', requirement_id::VARCHAR, idx) AS test_id FROM cases")
def g7(spark, sf_dir):
    return dedup.number_cases(adapters.cases(spark, sf_dir)).select("requirement_id", "idx", "test_id")


def _table(spark, sf_dir, **static):
    rows = dedup.number_cases(adapters.cases(spark, sf_dir)).withColumn("confidence", F.when(F.col("idx") % 2 == 0, F.col("idx") / 10.0))
    return formatting.jira_table(rows.withColumn("test_id", F.when(F.col("idx") % 3 != 0, F.col("test_id"))), static)


FIELDS = f"""{C}, fields AS (SELECT *, printf('%s_TC_%03d', requirement_id::VARCHAR, idx) AS test_id, CASE WHEN trim(data) <> '' THEN data ELSE 'N/A' END AS data_text FROM cases)"""


@query("h1_coalesce_fields", f"{FIELDS} SELECT requirement_id, idx, summary, action, data_text AS data, expected_result FROM fields")
def h1(spark, sf_dir):
    return formatting.coalesced_fields(adapters.cases(spark, sf_dir)).select("requirement_id", "idx", "summary", "action", "data", "expected_result")


@query("h2_format_steps", f"{C} SELECT requirement_id, idx, '1) ' || action || chr(10) || chr(10) || '2) ' || data || chr(10) || chr(10) || '3) end' AS steps FROM cases")
def h2(spark, sf_dir):
    steps = F.concat(F.lit("1) "), "action", F.lit(", 2) "), "data", F.lit(", 3) end"))
    return adapters.cases(spark, sf_dir).select("requirement_id", "idx", formatting.format_steps(steps).alias("steps"))


ISSUE = "CASE WHEN idx % 3 <> 0 THEN test_id ELSE requirement_id || '_' || printf('TC_%03d', idx) END"


@query("h3_issue_id", f"{FIELDS} SELECT requirement_id, idx, CASE WHEN contains(coalesce(CASE WHEN idx % 3 <> 0 THEN test_id END, printf('TC_%03d', idx)), requirement_id::VARCHAR) THEN coalesce(CASE WHEN idx % 3 <> 0 THEN test_id END, printf('TC_%03d', idx)) ELSE {ISSUE} END AS issue_id FROM fields")
def h3(spark, sf_dir):
    rows = dedup.number_cases(adapters.cases(spark, sf_dir)).withColumn("test_id", F.when(F.col("idx") % 3 != 0, F.col("test_id")))
    return rows.select("requirement_id", "idx", formatting.issue_id(F.col("requirement_id").cast("string"), F.col("test_id"), F.col("idx")).alias("issue_id"))


STATIC = ", ".join(f"'{v}' AS \"{k}\"" for k, v in formatting.STATIC.items())


@query("h4_jira_table", f"""{FIELDS} SELECT CASE WHEN contains(coalesce(CASE WHEN idx % 3 <> 0 THEN test_id END, printf('TC_%03d', idx)), requirement_id::VARCHAR) THEN coalesce(CASE WHEN idx % 3 <> 0 THEN test_id END, printf('TC_%03d', idx)) ELSE {ISSUE} END AS "Issue ID",
'[' || summary || ']' AS "Summary", {STATIC}, CASE WHEN idx % 2 = 0 THEN printf('Confidence Score: %.2f', idx / 10.0) ELSE '' END AS "Description", action AS "Action", data_text AS "Data",
expected_result AS "Expected Result", summary AS "Feature Group", requirement_id::VARCHAR AS "LinkTest" FROM fields""")
def h4(spark, sf_dir):
    return _table(spark, sf_dir)


@query("h5_long_description", f"""{C} SELECT requirement_id, idx, 'Action: ' || action || CASE WHEN data <> '' THEN chr(10) || chr(10) || 'Data: ' || data ELSE '' END || chr(10) || chr(10) || 'Expected: ' || expected_result AS description FROM cases""")
def h5(spark, sf_dir):
    parts = [("Action", F.col("action")), ("Data", F.col("data")), ("Expected", F.col("expected_result"))]
    return adapters.cases(spark, sf_dir).select("requirement_id", "idx", formatting.long_description(parts).alias("description"))


NAMES = ", ".join(f"('{c}', {k})" for k, c in enumerate(formatting.COLUMNS))


@query("h6_schema_diff", f"""{C}, n AS (SELECT count(*) AS n FROM cases), c(name, k) AS (VALUES {NAMES}) SELECT name AS "column", CASE WHEN name = 'Labels' THEN 'missing' WHEN name = 'LinkTest' THEN 'moved' ELSE 'same' END AS status,
n AS left_values, CASE WHEN name <> 'Labels' THEN n END AS right_values FROM c, n UNION ALL SELECT 'Extra', 'extra', NULL, n FROM n""")
def h6(spark, sf_dir):
    table = _table(spark, sf_dir)
    return formatting.schema_diff(table, table.drop("Labels").withColumn("Extra", F.lit(1)))


@query("h7_value_diff", f"""{FIELDS}, n AS (SELECT count(*) AS n, count(*) FILTER (data_text <> 'N/A') AS d FROM fields), c(name, k) AS (VALUES {NAMES})
SELECT name AS "column", n AS compared, CASE name WHEN 'Assignee' THEN n WHEN 'Data' THEN d ELSE 0 END AS different FROM c, n WHERE k > 0""")
def h7(spark, sf_dir):
    left = _table(spark, sf_dir).where("`Issue ID` IS NOT NULL")
    right = _table(spark, sf_dir, Assignee="OTHER")
    left, right = left.withColumn("Issue ID", F.concat_ws("/", "LinkTest", "Issue ID")), right.withColumn("Issue ID", F.concat_ws("/", "LinkTest", "Issue ID"))
    return formatting.value_diff(left, right.withColumn("Data", F.when(F.col("Data") != "N/A", "x").otherwise(F.col("Data"))))
