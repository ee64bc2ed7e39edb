"""Columns over model responses: parsing, structure, errors, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a response may hold JSON.
FENCED = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"
BRACED = r"\{(?:[^{}]|\{[^{}]*+\})*+\}"
FRAGMENT = r"(?is)\"test_cases\"\s*:\s*\[(.*?)\]"
CASES = "array<struct<summary:string,action:string,data:string,expected_result:string,test_type:string>>"
KEYS = ["summary", "action", "data", "expected_result"]


def is_json(text: Column) -> Column:
    """Whether text is one JSON value. Parsers stop where a value ends; what follows shows when the text stands inside a list and
    inside an object: another element or member, or no JSON at all."""
    listed = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    member = F.size(F.json_object_keys(F.concat(F.lit('{"value":'), text, F.lit("}"))))
    return F.coalesce((listed == 1) & (member == 1) & F.try_parse_json(text).isNotNull(), F.lit(False))


def parse_response(response: Column) -> Column:
    """The first valid JSON of: the whole text, fenced objects, braced objects, the first "test_cases" list. Null if none is."""
    first = lambda found: F.get(F.filter(found, is_json), F.lit(0))
    whole = F.btrim(response, F.lit(" \t\r\n"))
    fragment = F.concat(F.lit('{"test_cases": ['), F.regexp_extract(response, FRAGMENT, 1), F.lit("]}"))
    return F.when(F.trim(response) == "", None).otherwise(
        F.coalesce(
            F.when(is_json(whole), whole),
            first(F.regexp_extract_all(response, F.lit(FENCED), F.lit(1))),
            first(F.regexp_extract_all(response, F.lit(BRACED), F.lit(0))),
            F.when(response.rlike(FRAGMENT) & is_json(fragment), fragment),
        )
    )


def cases_of(parsed: Column) -> Column:
    return F.from_json(F.get_json_object(parsed, "$.test_cases"), CASES)


def has_structure(parsed: Column) -> Column:
    """A non-empty list of cases whose first has the four keys."""
    first = F.get_json_object(parsed, "$.test_cases[0]")
    keys = F.coalesce(F.json_object_keys(first), F.array())
    return F.coalesce(F.size(cases_of(parsed)) > 0, F.lit(False)) & (F.size(F.array_intersect(keys, F.array(*map(F.lit, KEYS)))) == len(KEYS))


def triage(response: Column, parsed: Column) -> Column:
    """ok, or the error of a response."""
    listed = F.get_json_object(parsed, "$.test_cases")
    return (
        F.when(F.trim(F.coalesce(response, F.lit(""))) == "", "EmptyResponse")
        .when(listed.isNull(), "InvalidJSONStructure")
        .when(F.regexp_replace(listed, r"\s", "") == "[]", "EmptyTestCasesList")
        .otherwise("ok")
    )


def confidence(logprobs: Column) -> Column:
    """exp of the mean log probability; null without any."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(logprobs) > 0, F.exp(total / F.size(logprobs)))


def logprobs_of(written: Column) -> Column:
    """Log probabilities as a model wrote them in JSON: a list of numbers, a list of objects with logprob, or an object with
    token_logprobs. What is neither is left out; null if there is no such list."""
    value = F.try_parse_json(written)
    one = lambda x: F.coalesce(F.try_variant_get(x, "$.logprob", "double"), F.when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(x, "$", "double")))
    listed = F.array_compact(F.transform(F.try_variant_get(value, "$", "array<variant>"), one))
    return F.coalesce(listed, F.try_variant_get(value, "$.token_logprobs", "array<double>"))
