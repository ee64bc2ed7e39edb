"""Queries over artifacts and relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ALL_TYPES, RELATION_TESTS, TEXT_TESTS, TYPE_TESTS, classify_text, clean_text, map_type, relation_type
from ..functions.tables import session_with
from ..operators import context, graph
from ..sources import adapters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def clean_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"


def tests_sql(value: str, tests: list, otherwise: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({value}, '{'|'.join(words)}') THEN '{name}'" for name, words in tests)
    return f"CASE {arms} ELSE {otherwise} END"


ROWS = f"WITH {adapters.ARTIFACTS}, rows_ AS (SELECT *, {clean_sql('text')} AS clean FROM artifacts)"
CARRIED = f"""{ROWS}, flags AS (SELECT *, CASE WHEN type = 'Heading' THEN coalesce(nullif(clean, ''), 'No Heading') END AS title,
  CASE WHEN type = 'Heading' OR (type = 'System Requirement' AND clean <> '') THEN 1 ELSE 0 END AS reset FROM rows_),
carried AS (SELECT *, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'No Heading') AS heading,
  coalesce(sum(reset) OVER (PARTITION BY source_file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM flags),
infos AS (SELECT source_file, segment, string_agg(id || ': ' || clean, chr(10) ORDER BY seq) AS info, count(*) AS n_info FROM carried WHERE type = 'Information' GROUP BY ALL),
reqs AS (SELECT c.source_file, c.seq, c.id, c.clean, c.heading, coalesce(i.info, '') AS info, coalesce(i.n_info, 0) AS n_info
  FROM carried c LEFT JOIN infos i USING (source_file, segment) WHERE c.type = 'System Requirement' AND c.clean <> '')"""


def _info_text():
    return F.array_join(F.transform("info", lambda x: F.concat(x["id"], F.lit(": "), x["text"])), "\n")


@query("b4_map_type", f"""SELECT p_partkey, {tests_sql("lower(p_type || ' ' || t)", [(t, [w]) for w, t in TYPE_TESTS], "'Unknown'")} AS type
FROM (SELECT *, (['design information', 'Parameter', 'HEADING', 'x', 'System Requirement', 'interface', 'Information'])[p_partkey % 7 + 1] AS t FROM part)""")
def b4(spark, sf_dir):
    names = F.array(*map(F.lit, ["design information", "Parameter", "HEADING", "x", "System Requirement", "interface", "Information"]))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", map_type(F.concat("p_type", F.lit(" "), F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")))).alias("type"))


@query("b5_classify_text", f"""{ROWS} SELECT source_file, seq, id, {tests_sql("lower(clean)", TEXT_TESTS, "CASE WHEN length(trim(clean)) > 50 THEN 'System Requirement' ELSE 'Unknown' END")} AS type FROM rows_""")
def b5(spark, sf_dir):
    return adapters.artifacts(spark, sf_dir).select("source_file", "seq", "id", classify_text(clean_text(F.col("text"))).alias("type"))


@query("b6_type_counts", f"""WITH {adapters.ARTIFACTS}, t AS (SELECT unnest([{', '.join(f"'{t}'" for t in ALL_TYPES)}]) AS type), f AS (SELECT DISTINCT source_file FROM artifacts)
SELECT f.source_file, t.type, count(a.id) AS n FROM f CROSS JOIN t LEFT JOIN artifacts a ON a.source_file = f.source_file AND a.type = t.type GROUP BY ALL""")
def b6(spark, sf_dir):
    return type_counts(adapters.artifacts(spark, sf_dir))


def type_counts(artifacts):
    """source_file, type, n: all types of every file, also those without a row."""
    sums = artifacts.groupBy("source_file").agg(*(F.count_if(F.col("type") == t).alias(t) for t in ALL_TYPES))
    return sums.select("source_file", F.inline(F.array(*(F.struct(F.lit(t).alias("type"), F.col(t).alias("n")) for t in ALL_TYPES))))


@query("b7_clean_text", f"WITH p AS (SELECT page_id, {clean_sql('html')} AS text FROM pages) SELECT * FROM p")
def b7(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", clean_text(F.col("html")).alias("text"))


@query("d1_heading_context", f"{CARRIED} SELECT source_file, seq, id, heading FROM reqs")
def d1(spark, sf_dir):
    return context.heading_context(adapters.artifacts(spark, sf_dir), chunk=200)


@query("d2_info_context", f"{CARRIED} SELECT source_file, seq, id, info, n_info FROM reqs")
def d2(spark, sf_dir):
    return context.info_context(adapters.artifacts(spark, sf_dir)).select("source_file", "seq", "id", _info_text().alias("info"), F.size("info").cast("long").alias("n_info"))


@query("d3_interface_context", f"{ROWS} SELECT source_file, seq, id, clean AS text FROM rows_ WHERE type = 'System Interface'")
def d3(spark, sf_dir):
    return context.interface_context(adapters.artifacts(spark, sf_dir))


@query("d4_augment_requirements", f"""{CARRIED} SELECT r.source_file, seq, id, clean AS text, heading, info, n_info, coalesce(interfaces, '') AS interfaces, coalesce(n, 0) AS n_interfaces FROM reqs r
LEFT JOIN (SELECT source_file, string_agg(id || ': ' || clean, chr(10) ORDER BY seq) AS interfaces, count(*) AS n FROM rows_ WHERE type = 'System Interface' GROUP BY 1) i USING (source_file)""")
def d4(spark, sf_dir):
    lines = lambda items: F.array_join(F.transform(items, lambda x: F.concat(x["id"], F.lit(": "), x["text"])), "\n")
    rows = context.augment_requirements(adapters.artifacts(session_with(spark, context.LONG_LISTS), sf_dir), shown=lines)
    return rows.select("source_file", "seq", "id", "text", "heading", _info_text().alias("info"), F.size("info").cast("long").alias("n_info"), "interfaces", "n_interfaces")


EDGES = f"""{adapters.RELATIONS}, edges AS (SELECT *, {tests_sql("lower(coalesce(relation_type_name, ''))", RELATION_TESTS, "'unknown'")} AS relation_type
FROM relations WHERE source_id IS NOT NULL AND target_id IS NOT NULL), pc AS (SELECT * FROM edges WHERE relation_type = 'parent_child'),
nodes AS (SELECT source_file, source_id AS id FROM edges UNION SELECT source_file, target_id FROM edges),
firsts AS (SELECT source_file, source_id, min(seq) AS first FROM pc GROUP BY ALL),
parents AS (SELECT source_file, target_id AS id, arg_max(source_id, first) AS parent_id FROM pc JOIN firsts USING (source_file, source_id) GROUP BY ALL),
kids AS (SELECT source_file, source_id AS parent, string_agg(target_id, ',' ORDER BY seq) AS children FROM pc GROUP BY ALL)"""
LEVELS = f"""WITH RECURSIVE {EDGES}, up AS (SELECT source_file, id, parent_id AS cur, 1 AS n FROM parents
UNION ALL SELECT u.source_file, u.id, p.parent_id, n + 1 FROM up u JOIN parents p ON p.source_file = u.source_file AND p.id = u.cur WHERE n < 10),
levels AS (SELECT source_file, id, max(n)::INT AS level FROM up GROUP BY ALL)"""


@query("e1_relation_types", f"WITH {EDGES} SELECT relation_type, count(*) AS n FROM edges GROUP BY 1")
def e1(spark, sf_dir):
    return graph.typed_relations(adapters.relations(spark, sf_dir)).groupBy("relation_type").agg(F.count("*").alias("n"))


@query("e2_relations", f"WITH {EDGES} SELECT source_file, id, source_id, target_id, relation_type FROM edges")
def e2(spark, sf_dir):
    return graph.typed_relations(adapters.relations(spark, sf_dir)).select("source_file", "id", "source_id", "target_id", "relation_type")


@query("e3_children", f"WITH {EDGES} SELECT source_file, parent, children FROM kids")
def e3(spark, sf_dir):
    return graph.children(adapters.relations(spark, sf_dir)).withColumn("children", F.array_join("children", ","))


@query("e4_parent_of", f"WITH {EDGES} SELECT * FROM parents")
def e4(spark, sf_dir):
    return graph.parent_of(adapters.relations(spark, sf_dir))


@query("e5_hierarchy_level", f"{LEVELS} SELECT * FROM levels")
def e5(spark, sf_dir):
    return graph.hierarchy_levels(graph.parent_of(adapters.relations(spark, sf_dir)))


@query("e6_augment_graph", f"""{LEVELS} SELECT source_file, id, parent_id, coalesce(children, '') AS child_ids, coalesce(level, 0) AS level
FROM nodes LEFT JOIN parents USING (source_file, id) LEFT JOIN levels USING (source_file, id) LEFT JOIN (SELECT source_file, parent AS id, children FROM kids) USING (source_file, id)""")
def e6(spark, sf_dir):
    relations = adapters.relations(spark, sf_dir)
    return graph.augment_graph(graph.nodes_of(relations), relations).withColumn("child_ids", F.array_join("child_ids", ","))


@query("e7_dependency_graph", f"""WITH {EDGES}, dep AS (SELECT * FROM edges WHERE relation_type IN ('depends_on', 'derives_from', 'refines')),
o AS (SELECT source_file, source_id AS id, string_agg(target_id, ',' ORDER BY seq) AS dependencies FROM dep GROUP BY ALL),
b AS (SELECT source_file, target_id AS id, string_agg(source_id, ',' ORDER BY seq) AS dependents FROM dep GROUP BY ALL)
SELECT source_file, id, coalesce(dependencies, '') AS dependencies, coalesce(dependents, '') AS dependents FROM o FULL JOIN b USING (source_file, id)""")
def e7(spark, sf_dir):
    rows = graph.dependency_graph(adapters.relations(spark, sf_dir))
    return rows.select("source_file", "id", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"))


@query("e8_roots_leaves", f"""WITH {EDGES} SELECT * FROM (SELECT source_file, id, NOT EXISTS (SELECT 1 FROM pc WHERE pc.target_id = nodes.id) AS is_root,
NOT EXISTS (SELECT 1 FROM pc WHERE pc.source_id = nodes.id) AS is_leaf FROM nodes) WHERE is_root OR is_leaf""")
def e8(spark, sf_dir):
    relations = adapters.relations(spark, sf_dir)
    return graph.roots_and_leaves(graph.nodes_of(relations), relations)


@query("e9_requirement_paths", f"""WITH RECURSIVE {EDGES}, walk AS (SELECT source_file, id AS root_id, 0 AS depth, [id] AS path, id FROM nodes WHERE id NOT IN (SELECT target_id FROM pc)
UNION ALL SELECT w.source_file, w.root_id, w.depth + 1, list_append(w.path, e.target_id), e.target_id FROM walk w
JOIN (SELECT DISTINCT source_id, target_id FROM pc) e ON e.source_id = w.id WHERE NOT list_contains(w.path, e.target_id))
SELECT source_file, root_id, depth, array_to_string(path, '/') AS path, id, substr(text, 1, 100) AS text FROM walk LEFT JOIN (SELECT 'N' || doc_id AS id, text FROM documents) USING (id)""")
def e9(spark, sf_dir):
    relations = adapters.relations(spark, sf_dir)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("N"), "doc_id").alias("id"), "text")
    nodes = graph.nodes_of(relations).join(texts, "id", "left")
    return graph.requirement_paths(nodes, relations).withColumn("path", F.array_join("path", "/"))
