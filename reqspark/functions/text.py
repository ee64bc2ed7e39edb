"""Columns over artifact texts and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
#: Tests of a type's name, in order. "Design Information" has "information" and is Information.
TYPE_TESTS = [
    ("requirement", "System Requirement"),
    ("heading", "Heading"),
    ("information", "Information"),
    ("design", "Design Information"),
    ("parameter", "Application Parameter"),
    ("interface", "System Interface"),
]
#: Words that tell a text's type, in order.
TEXT_TESTS = [
    ("Heading", ["heading", "title", "section"]),
    ("System Requirement", ["requirement", "shall", "must", "should", "will", "required", "provides", "ensures", "controls", "manages", "performs"]),
    ("Design Information", ["design", "architecture", "diagram", "ecu"]),
    ("Application Parameter", ["parameter", "variable", "setting", "threshold", "value", "constant"]),
    ("System Interface", ["interface", "input", "output", "signal", "boolean", "command"]),
    ("Information", ["information", "note", "description"]),
]
ALL_TYPES = ["Heading", "Information", "Design Information", "Application Parameter", "System Interface", "System Requirement", "Unknown"]
#: Words in a relation type's name, in order.
RELATION_TESTS = [
    ("parent_child", ["parent", "child", "hierarchy", "contains"]),
    ("derives_from", ["derive", "derived", "from"]),
    ("depends_on", ["depend", "requires", "needs"]),
    ("refines", ["refine"]),
    ("satisfies", ["satisfy", "satisfies"]),
    ("verifies", ["verify", "verifies", "test"]),
]


def clean_text(text: Column) -> Column:
    """Without tags; white space is one space; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), WHITE, " "))


def _first_match(value: Column, tests: list, otherwise: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, words in tests:
        out = out.when(value.rlike("|".join(words)), name)
    return out.otherwise(otherwise)


def map_type(name: Column, strict: bool = False) -> Column:
    """A type name's type; strict tells Design Information from Information."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    tests = [(t, [w]) for w, t in TYPE_TESTS]
    return _first_match(lower, [("Design Information", ["design information"])] * strict + tests, F.lit("Unknown"))


def classify_text(text: Column) -> Column:
    """The type that a (cleaned) text's words tell; long texts are requirements."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return _first_match(lower, TEXT_TESTS, F.when(F.length(F.trim(text)) > 50, "System Requirement").otherwise("Unknown"))


def relation_type(name: Column) -> Column:
    return _first_match(F.lower(F.coalesce(name, F.lit(""))), RELATION_TESTS, F.lit("unknown"))


def is_blank(text: Column) -> Column:
    """Whether clean_text of it is empty; told at the first sign outside of tags, without cleaning the rest."""
    return F.coalesce(text, F.lit("")).rlike(r"^(?:<[^>]+>|[\x20\x09-\x0D])*+$")
