"""The requirement relationship graph; every job is keyed by source_file, so that many specifications go at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.text import relation_type

MAX_LEVEL = 10


def typed_relations(relations: DataFrame) -> DataFrame:
    """Relations with both ends and their type."""
    return relations.where("source_id IS NOT NULL AND target_id IS NOT NULL").withColumn("relation_type", relation_type(F.col("relation_type_name")))


def _parent_edges(relations: DataFrame) -> DataFrame:
    return typed_relations(relations).where("relation_type = 'parent_child'")


def children(relations: DataFrame) -> DataFrame:
    """source_file, parent, children (ordered by relation, repeats kept)."""
    listed = F.sort_array(F.collect_list(F.struct("seq", "target_id")))
    return _parent_edges(relations).groupBy("source_file", F.col("source_id").alias("parent")).agg(F.transform(listed, lambda x: x["target_id"]).alias("children"))


def parent_of(relations: DataFrame) -> DataFrame:
    """source_file, id, parent_id: of several parents the one whose first relation comes last."""
    edges = _parent_edges(relations)
    first = edges.groupBy("source_file", "source_id").agg(F.min("seq").alias("first"))
    both = edges.join(first, ["source_file", "source_id"])
    return both.groupBy("source_file", F.col("target_id").alias("id")).agg(F.max_by("source_id", F.struct("first", "source_id")).alias("parent_id"))


def hierarchy_levels(parents: DataFrame) -> DataFrame:
    """source_file, id, level: hops up to the root, at most MAX_LEVEL (where a cycle ends). Each round doubles the hops."""
    jumps = parents.select("source_file", "id", F.col("parent_id").alias("up"), F.lit(1).alias("hops"))
    for _ in range(MAX_LEVEL.bit_length()):
        further = jumps.select("source_file", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        jumps = jumps.join(further, ["source_file", "up"], "left").select("source_file", "id", F.col("up2").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"))
    return jumps.select("source_file", "id", F.least("hops", F.lit(MAX_LEVEL)).alias("level"))


def nodes_of(relations: DataFrame) -> DataFrame:
    edges = typed_relations(relations)
    return edges.select("source_file", F.col("source_id").alias("id")).union(edges.select("source_file", F.col("target_id").alias("id"))).distinct()


def augment_graph(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """source_file, id, parent_id, child_ids, level of every node."""
    parents = parent_of(relations)
    below = children(relations).withColumnRenamed("parent", "id")
    rows = nodes.join(parents, ["source_file", "id"], "left").join(below, ["source_file", "id"], "left").join(hierarchy_levels(parents), ["source_file", "id"], "left")
    return rows.select("source_file", "id", "parent_id", F.coalesce("children", F.array().cast("array<string>")).alias("child_ids"), F.coalesce("level", F.lit(0)).alias("level"))


def dependency_graph(relations: DataFrame) -> DataFrame:
    """source_file, id, dependencies, dependents (ordered by relation)."""
    edges = typed_relations(relations).where("relation_type IN ('depends_on', 'derives_from', 'refines')")
    listed = lambda other: F.transform(F.sort_array(F.collect_list(F.struct("seq", other))), lambda x: x[other])
    out = edges.groupBy("source_file", F.col("source_id").alias("id")).agg(listed("target_id").alias("dependencies"))
    back = edges.groupBy("source_file", F.col("target_id").alias("id")).agg(listed("source_id").alias("dependents"))
    none = F.array().cast("array<string>")
    return out.join(back, ["source_file", "id"], "full").select("source_file", "id", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))


def roots_and_leaves(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """source_file, id, is_root, is_leaf of nodes that are one or both."""
    edges = _parent_edges(relations)
    roots = nodes.join(edges.select("source_file", F.col("target_id").alias("id")), ["source_file", "id"], "left_anti").withColumn("is_root", F.lit(True))
    leaves = nodes.join(edges.select("source_file", F.col("source_id").alias("id")), ["source_file", "id"], "left_anti").withColumn("is_leaf", F.lit(True))
    both = roots.join(leaves, ["source_file", "id"], "full")
    return both.select("source_file", "id", F.coalesce("is_root", F.lit(False)).alias("is_root"), F.coalesce("is_leaf", F.lit(False)).alias("is_leaf"))


def requirement_paths(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """source_file, root_id, depth, path, id: every way down from every root, however long, once for each; a node on its own path
    ends it. With a text column in nodes, text is its first 100 characters. Each level is written, and is all that the next one
    reads."""
    edges = _parent_edges(relations).select("source_file", F.col("source_id").alias("id"), F.col("target_id").alias("child")).distinct()
    edges = written(edges.join(nodes.select("source_file", F.col("id").alias("child")), ["source_file", "child"], "left_semi"))
    level = written(roots_and_leaves(nodes, relations).where("is_root").select("source_file", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array("id").alias("path"), "id"))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        level = level.join(edges, ["source_file", "id"]).where(~F.array_contains("path", F.col("child")))
        level = written(level.select("source_file", "root_id", F.lit(depth).alias("depth"), F.concat("path", F.array("child")).alias("path"), F.col("child").alias("id")))
        out = out.union(level)
    if "text" in nodes.columns:
        out = out.join(nodes.select("source_file", "id", F.substring("text", 1, 100).alias("text")), ["source_file", "id"], "left")
        out = out.select("source_file", "root_id", "depth", "path", "id", "text")
    return out
