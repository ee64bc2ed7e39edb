"""Spans of text as columns: array<struct<start,end,value>>, in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:int,end:int,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def _sums(values: Column) -> Column:
    """0, then the running sums of a short array of integers."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running_sums(values: Column) -> Column:
    """The running sums of an array of integers that isn't empty. An array of n is summed in blocks of the root of n, so that
    no array is copied n times."""

    def of_blocks(blocks: Column) -> Column:
        starts = _sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, s: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda x: x + s)))

    def of(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return let(F.transform(F.sequence(F.lit(0), F.size(v) - 1, size), lambda i: _sums(F.slice(v, i + 1, size))), of_blocks)

    return let(values, of)


def find_all(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of pattern: the text between matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def places(m: Column) -> Column:
        steps = F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda value, gap: F.length(gap) + F.length(value))
        spans = F.zip_with(
            m, running_sums(steps), lambda value, end: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))
        )
        return F.when(F.size(m) > 0, spans).otherwise(no_spans())

    return let(found, places)


def labelled(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind and its place among the kinds."""
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    """Whether any of spans overlaps [start, end)."""
    return F.exists(spans, lambda b: (start < b["end"]) & (b["start"] < end))
