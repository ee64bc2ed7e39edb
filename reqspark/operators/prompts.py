"""Prompts: template choice, tables and lists as text, rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_template(rows: DataFrame, rules: list[tuple[str, str, str]], known: set[str], default: str) -> DataFrame:
    """Adds template: the first rule (kind heading or id, keyword, template) that applies and whose template is known."""
    out = F.when(F.lit(False), "")
    for kind in ("heading", "id"):
        for k, keyword, template in rules:
            if k == kind and template in known:
                text, word = (F.lower("heading"), keyword.lower()) if kind == "heading" else (F.upper("id"), keyword.upper())
                out = out.when(F.contains(text, F.lit(word)), template)
    return rows.withColumn("template", out.otherwise(default))


def format_table(headers: list[str], rows: Column, n: Column) -> Column:
    """A table of n rows as text, from its rows (arrays of cells, in order); of a table of over 50 rows the first and the last ten
    are enough."""
    line = lambda x: F.array_join(x, " | ", "")
    numbered = lambda x, i: F.concat(F.format_string("R%02d: ", i), line(x))
    short = F.transform(rows, lambda x, i: F.concat(line(x), F.lit(" | Row "), i + 1))
    middle = F.array(F.concat(F.lit("... (showing first 10 and last 10 of "), n, F.lit(" total rows) ...")))
    some = F.concat(
        F.transform(F.slice(rows, F.lit(1), F.lit(10)), lambda x, i: numbered(x, i + 1)),
        middle,
        F.transform(F.slice(rows, F.size(rows) - 9, F.lit(10)), lambda x, i: numbered(x, n - 9 + i)),
    )
    body = F.when(n <= 20, short).when(n <= 50, F.transform(rows, lambda x, i: numbered(x, i + 1))).otherwise(F.when(n > 50, some))
    head = " | ".join(headers)
    text = F.concat(F.lit(f"Table Data:\n{head}\n{'-' * len(head)}\n"), F.array_join(body, "\n"), F.lit("\n\nTable contains "), n, F.lit(" rows total."))
    return F.when(rows.isNull(), "No table data available").when(n == 0, "Empty table").otherwise(text)


def table_texts(rows: DataFrame, key: str, order: str, cells: dict[str, Column], parts: int = 64) -> DataFrame:
    """key and text: the rows of each key as a table (headers and cells by name) in ascending order. Keys are dealt over parts; of
    each part only the first 50 and the last ten rows go on, so that no task holds a large table."""
    rows = rows.select(key, F.col(order).alias("at"), F.array(*(c.cast("string") for c in cells.values())).alias("cells"), F.pmod(F.xxhash64(order), F.lit(parts)).alias("part"))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    within = Window.partitionBy(key, "part")
    ends = rows.withColumn("first", F.row_number().over(within.orderBy("at"))).withColumn("last", F.row_number().over(within.orderBy(F.desc("at"))))
    ends = ends.where("first <= 50 OR last <= 10").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "cells"))).alias("rows"))
    text = format_table(list(cells), F.transform("rows", lambda x: x["cells"]), F.col("n").cast("int"))
    return ends.join(counts, key).select(key, text.alias("text"))


def info_lines(texts: Column) -> Column:
    return F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("None")


def interface_lines(interfaces: Column) -> Column:
    """Of array<struct<id, text>>."""
    each = F.transform(interfaces, lambda x: F.concat(F.lit("- "), F.coalesce(x["id"], F.lit("UNKNOWN")), F.lit(": "), x["text"]))
    return F.when(F.size(interfaces) > 0, F.array_join(each, "\n")).otherwise("None")


#: What a vision model is told of attached images.
NO_IMAGES = "No diagrams or images provided."
GUIDANCE = """1. DESCRIBE what you see - identify the type of diagram (state machine, flowchart, timing diagram, architecture, UI mockup, table)
2. EXTRACT key information:
   - For state machines: List all states and transitions with conditions
   - For flowcharts: Identify decision points and branches
   - For timing diagrams: Note signal sequences and timing constraints
   - For tables: Extract parameter values and thresholds
   - For UI mockups: Describe expected user interactions
3. CROSS-REFERENCE the diagram with the requirement text to identify:
   - Test scenarios that validate the visual logic
   - Edge cases visible in the diagram but not explicit in text
   - Boundary values from any numerical data shown
4. Describe your visual analysis explicitly in the "analysis" field of the JSON output.
5. If the diagram contradicts or extends the text description, note this in your test cases."""


def image_context(formats: Column) -> Column:
    """The text for images of these formats."""
    n = F.size(formats)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(formats, lambda x: F.upper(F.coalesce(x, F.lit("unknown")))))), ", ")
    named = F.when(n == 1, "diagram").otherwise("diagrams")
    return F.when(n > 0, F.concat(n, F.lit(" diagram(s) attached ("), kinds, F.lit("). \n\nWhen analyzing the "), named, F.lit(":\n" + GUIDANCE))).otherwise(NO_IMAGES)


def render(template: str, values: dict[str, Column], required: list[str], defaults: dict[str, str], fallback: str) -> Column:
    """The template with {name} replaced; a value that is missing, empty or "none" takes its default; a required one without
    any gives the fallback template."""
    blank = lambda c: c.isNull() | F.lower(c).isin("", "none")
    full = {k: F.when(blank(c), F.lit(defaults.get(k))).otherwise(c) for k, c in values.items()}
    filled = lambda text: reduce(lambda t, k: F.replace(t, F.lit("{" + k + "}"), F.coalesce(full[k], F.lit(""))), full, F.lit(text))
    missing = reduce(lambda a, k: a | full[k].isNull(), required, F.lit(False))
    return F.when(missing, filled(fallback)).otherwise(filled(template))
