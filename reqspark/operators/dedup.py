"""Near-duplicate test cases within a scope: pairs by exact bounds, then difflib, then greedy groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.similarity import field_bound, mean_similarity, normal
from ..functions.tables import written
from .corpus_dedup import near_classes

FIELDS = ("action", "data", "expected_result")


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def similar_pairs(cases: DataFrame, threshold: float = 0.7, fields: tuple[str, ...] = FIELDS, shown: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """requirement_id, a, b, similarity of pairs a < b of one requirement, at least threshold similar, and the columns shown of both.
    Pairs whose bound is lower never reach the exact comparison. parts is the number of partitions, here and below; the session's if None."""
    ship(cases.sparkSession)
    keyed = cases.select("requirement_id", "idx", *(normal(F.col(f)).alias(f) for f in fields), *(F.col(c).alias(f"shown_{c}") for c in shown))
    # comparing takes far more time than its few bytes suggest: a given number of partitions isn't coalesced by their size
    keyed = keyed.repartition(_parts(cases, parts), "requirement_id")
    names = (*fields, *(f"shown_{c}" for c in shown))
    side = lambda k: keyed.select("requirement_id", F.col("idx").alias(k), *(F.col(f).alias(f"{k}_{f}") for f in names))
    ends = [(F.col(f"a_{f}"), F.col(f"b_{f}")) for f in fields]
    most = sum((field_bound(x, y) for x, y in ends), F.lit(0.0)) / len(fields)
    pairs = side("a").join(side("b"), "requirement_id").where((F.col("a") < F.col("b")) & (most >= threshold - 1e-9))
    pairs = pairs.withColumn("similarity", mean_similarity(ends, threshold)).where("similarity IS NOT NULL")
    return pairs.select("requirement_id", "a", "b", "similarity", *(F.col(f"{k}_shown_{c}").alias(f"{c}_{k}") for c in shown for k in "ab"))


def described_pairs(cases: DataFrame, threshold: float = 0.7, parts: int | None = None) -> DataFrame:
    """Similar pairs with the summaries of both, the most similar first. They are written before they are sorted: a sort takes a
    sample of its rows first, and would compare all pairs twice."""
    return written(similar_pairs(cases, threshold, shown=("summary",), parts=parts)).orderBy(F.desc("similarity"), "requirement_id", "a", "b")


def duplicate_groups(cases: DataFrame, threshold: float = 0.85, fields: tuple[str, ...] = FIELDS, parts: int | None = None) -> DataFrame:
    """requirement_id, idx, anchor: in order, the first case that is in no group yet takes all later ones similar to it that are
    in none. Only similar pairs of a requirement meet in a task, as rows sorted by (requirement, a, b)."""
    parts = _parts(cases, parts)
    pairs = similar_pairs(cases, threshold, fields, parts=parts).select("requirement_id", "a", "b")
    ordered = pairs.repartition(parts, "requirement_id").sortWithinPartitions("requirement_id", "a", "b")

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken = None, {}
        for frame in frames:
            out = []
            for key, a, b in frame.itertuples(index=False):
                if key != now:
                    now, taken = key, {}
                if a not in taken and b not in taken or taken.get(a) == a and b not in taken:
                    taken[a] = a
                    taken[b] = a
                    out.append((key, b, a))
            yield pd.DataFrame(out, columns=["requirement_id", "idx", "anchor"])

    later = ordered.mapInPandas(greedy, "requirement_id long, idx int, anchor int")
    keys, dealt = ["requirement_id", "idx"], lambda df: df.repartition(parts, "requirement_id", "idx")
    rows = dealt(cases.select(*keys)).join(dealt(later), keys, "left")
    return rows.select("requirement_id", "idx", F.coalesce("anchor", "idx").alias("anchor"))


def kept_cases(cases: DataFrame, groups: DataFrame, keep: str = "first", fields: tuple[str, ...] = FIELDS, parts: int | None = None) -> DataFrame:
    """One case of each group: first, last, or best (valid, then longest fields, then first)."""
    length = sum((F.length(F.coalesce(F.col(f), F.lit(""))) for f in fields), F.lit(0))
    valid = F.col("valid").cast("int") if "valid" in cases.columns else F.lit(0)
    order = {"last": [F.desc("idx")], "best": [F.desc("v"), F.desc("n"), F.asc("idx")]}.get(keep, [F.asc("idx")])
    parts, keys = _parts(cases, parts), ["requirement_id", "idx"]
    rows = cases.repartition(parts, *keys).join(groups.repartition(parts, *keys), keys).withColumn("n", length).withColumn("v", valid).repartition(parts, "requirement_id")
    place = F.row_number().over(Window.partitionBy("requirement_id", "anchor").orderBy(*order))
    return rows.withColumn("place", place).where("place = 1").drop("place", "n", "v", "anchor")


def dedup_report(groups: DataFrame, parts: int | None = None) -> DataFrame:
    """requirement_id, original, kept, removed, groups (of two or more), rate."""
    each = groups.repartition(_parts(groups, parts), "requirement_id").groupBy("requirement_id", "anchor").agg(F.count("*").alias("n"))
    sums = each.groupBy("requirement_id").agg(F.sum("n").alias("original"), F.count("*").alias("kept"), F.count_if(F.col("n") > 1).alias("groups"))
    return sums.withColumn("removed", F.col("original") - F.col("kept")).withColumn("rate", F.round((F.col("original") - F.col("kept")) / F.col("original"), 6))


def number_cases(cases: DataFrame) -> DataFrame:
    """Adds test_id: the requirement and the place in order."""
    place = F.row_number().over(Window.partitionBy("requirement_id").orderBy("idx"))
    return cases.withColumn("test_id", F.format_string("%s_TC_%03d", F.col("requirement_id").cast("string"), place))


def corpus_near_dups(cases: DataFrame, threshold: float = 0.85, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """text (fields joined), copies, class_text, class_size: classes of near copies anywhere in the corpus, one row a different text."""
    return near_classes(cases.select(F.concat_ws(" | ", *(normal(F.col(f)) for f in fields)).alias("text")), threshold)
