"""Tables in HTML, as rows of cells by header."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = "array<struct<table_idx:int,row_idx:int,cells:map<string,string>>>"


class _Tables(HTMLParser):
    """Each table as rows of (text, rowspan, colspan, is header); scripts and styles are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.cell, self.skipped = [], [], None, 0

    def handle_starttag(self, tag, attrs):
        tag = tag.rpartition(":")[2]
        if tag in ("script", "style"):
            self.skipped += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append(self.tables[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            span = lambda name: int(v) if (v := dict(attrs).get(name) or "1").isdigit() and v != "0" else 1
            self.cell = [[], span("rowspan"), span("colspan"), tag == "th"]
            self.open[-1][-1].append(self.cell)
        elif tag == "br" and self.cell:
            self.cell[0].append(" ")

    def handle_endtag(self, tag):
        tag = tag.rpartition(":")[2]
        if tag in ("script", "style"):
            self.skipped -= self.skipped > 0
        elif tag == "table" and self.open:
            self.open.pop()
            self.cell = None
        elif tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell and not self.skipped:
            self.cell[0].append(data)


def _grid(rows: list) -> list[list[str]]:
    """A row takes its header cells if it has any; spans repeat a cell's text to the right and below."""
    taken: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, right, _ in [x for x in row if x[3]] or row:
            while (r, c) in taken:
                c += 1
            value = " ".join("".join(text).split())
            for i in range(min(down, len(rows) - r)):
                for j in range(right):
                    taken.setdefault((r + i, c + j), value)
            c += right
    width = max((c for _, c in taken), default=-1) + 1
    return [[taken.get((r, c), "") for c in range(width)] for r in range(len(rows))]


def tables_of(html: str | None) -> list[dict]:
    parser = _Tables()
    parser.feed(html or "")
    out = []
    for k, rows in enumerate(parser.tables):
        grid = _grid(rows)
        if not grid:
            continue
        names: list[str] = []
        for i, name in enumerate(grid[0], 1):
            name, n = name or f"Column_{i}", 2
            full = name
            while full in names:
                full, n = f"{name}_{n}", n + 1
            names.append(full)
        kept = [r for r in grid[1:] if any(r)]
        out += [{"table_idx": k, "row_idx": i, "cells": dict(zip(names, r))} for i, r in enumerate(kept)]
    return out


def html_tables(html: Column) -> Column:
    """ROWS of all tables in order; spans are filled, the first row is the header, empty rows go."""

    @F.pandas_udf(ROWS)
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(tables_of)

    return each(html)
