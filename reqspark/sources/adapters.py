"""The driver's tables in the shapes of the library: artifacts, relations, interfaces, cases, responses, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import EACH, partitions_for

#: Rows of customers or suppliers that are broadcast at most.
SMALL = 500_000
TYPES = ["Heading", "Information", "Information", "System Interface", "Design Information", "System Requirement", "System Requirement", "System Requirement"]
RELATION_NAMES = ["is parent of", "derived from", "depends on", "refines", "satisfies", "verifies", ""]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, seq, id, type, text: documents as artifacts of the specification of their source; some are blank."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.floor(F.col("doc_id") / 20) % 8 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 37 == 0, "").otherwise(F.concat(F.lit("<html:p>"), "text", F.lit("</html:p>")))
    return _table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_file"), F.col("doc_id").alias("seq"), F.concat(F.lit("ART_"), F.col("doc_id")).alias("id"), kind.alias("type"), text.alias("text")
    )


ARTIFACTS = f"""artifacts AS (SELECT source AS source_file, doc_id AS seq, 'ART_' || doc_id AS id,
  ([{", ".join(f"'{t}'" for t in TYPES)}])[(doc_id // 20) % 8 + 1] AS type,
  CASE WHEN doc_id % 37 = 0 THEN '' ELSE '<html:p>' || text || '</html:p>' END AS text FROM documents)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, seq, id, source_id, target_id, relation_type_name: documents as a tree of four children a node, with a
    second parent for some; ids lacking an end for others."""
    docs = _table(spark, sf_dir, "documents").where("doc_id > 0")
    names = F.array(*map(F.lit, RELATION_NAMES))
    first = docs.select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 53 != 0, F.concat(F.lit("N"), F.floor((F.col("doc_id") - 1) / 4))).alias("source_id"),
        F.concat(F.lit("N"), F.col("doc_id")).alias("target_id"),
        F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")).alias("relation_type_name"),
    )
    second = docs.where("doc_id > 20 AND doc_id % 11 = 0").select(
        (F.col("doc_id") + 1_000_000_000).alias("seq"),
        F.concat(F.lit("N"), F.floor(F.col("doc_id") / 3)).alias("source_id"),
        F.concat(F.lit("N"), F.col("doc_id")).alias("target_id"),
        F.lit("is parent of").alias("relation_type_name"),
    )
    return first.union(second).select(F.lit("tree").alias("source_file"), "seq", F.concat(F.lit("REL_"), F.col("seq")).alias("id"), "source_id", "target_id", "relation_type_name")


RELATIONS = f"""relations AS (SELECT 'tree' AS source_file, seq, 'REL_' || seq AS id, source_id, target_id, relation_type_name FROM (
  SELECT doc_id AS seq, CASE WHEN doc_id % 53 <> 0 THEN 'N' || ((doc_id - 1) // 4) END AS source_id, 'N' || doc_id AS target_id,
    ([{", ".join(f"'{t}'" for t in RELATION_NAMES)}])[doc_id % 7 + 1] AS relation_type_name FROM documents WHERE doc_id > 0
  UNION ALL SELECT doc_id + 1000000000, 'N' || (doc_id // 3), 'N' || doc_id, 'is parent of' FROM documents WHERE doc_id > 20 AND doc_id % 11 = 0))"""


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, id, text: nations as signals of their region."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    text = F.concat(F.lit("CANSignal - "), "n_name", F.lit(" (Message: "), "r_name", F.lit(")"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("scope"), F.concat(F.lit("IF_"), F.col("n_nationkey")).alias("id"), text.alias("text"))


INTERFACES = """interfaces AS (SELECT r_name AS scope, 'IF_' || n_nationkey AS id,
  'CANSignal - ' || n_name || ' (Message: ' || r_name || ')' AS text FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def case_parts(spark: SparkSession, sf_dir: str) -> int:
    """Over how many partitions cases are dealt; lines are counted by the footers of their files."""
    return partitions_for(spark, _table(spark, sf_dir, "lineitem").count())


def _deals(spark: SparkSession, sf_dir: str) -> int:
    """Over how many partitions cases are dealt by number, however many the session has: those of a plain join would be merged into
    a few large ones by adaptive execution. 0 if all lines fit into one."""
    lines = _table(spark, sf_dir, "lineitem").count()
    parts = partitions_for(spark, lines)
    return parts if lines > EACH or parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def _dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.repartition(parts, key) if parts else df


def _met(many: DataFrame, few: DataFrame, key: str, own: str, parts: int) -> DataFrame:
    """many with the row of few that its key names: few is broadcast if it is small, else both are dealt by the key."""
    on = F.col(key) == F.col(own)
    if not parts:
        return many.join(few, on)
    if few.count() <= SMALL:
        return many.join(F.broadcast(few), on)
    return _dealt(many, key, parts).join(_dealt(few, own, parts), on)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requirement_id, idx, scope, summary, action, data, expected_result, test_type: order lines as test cases. They are dealt by
    requirement over a number of partitions that grows with the lines, and stay so for what is grouped or joined by requirement."""
    from pyspark.sql import Window

    line, orders, customer, supplier, nation, region = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    theirs = place.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("scope"))
    ours = place.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("signal"))
    parts = _deals(spark, sf_dir)
    scoped = _met(orders, customer.join(theirs, "c_nationkey").select("c_custkey", "scope"), "o_custkey", "c_custkey", parts)
    sent = _met(line, supplier.join(ours, "s_nationkey").select("s_suppkey", "signal"), "l_suppkey", "s_suppkey", parts)
    rows = _dealt(sent, "l_orderkey", parts).join(_dealt(scoped, "o_orderkey", parts), F.col("l_orderkey") == F.col("o_orderkey"))
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    quantity = F.col("l_quantity").cast("int").cast("string")
    data = F.when(F.col("l_linenumber") == 6, "").when(F.col("l_linenumber") == 5, F.concat("signal", F.lit(" "), quantity)).otherwise(F.concat("signal", F.lit("="), quantity))
    return rows.select(
        F.col("l_orderkey").alias("requirement_id"),
        idx.alias("idx"),
        "scope",
        F.concat(F.lit("Case "), F.col("l_partkey")).alias("summary"),
        F.concat(F.lit("Send "), "signal", F.lit(" signal with value "), quantity).alias("action"),
        data.alias("data"),
        F.concat(F.lit("Flag "), "l_returnflag").alias("expected_result"),
        F.when(F.col("l_linestatus") == "O", "positive").otherwise("negative").alias("test_type"),
    )


CASES = """cases AS (SELECT l_orderkey AS requirement_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS idx,
  r.r_name AS scope, 'Case ' || l_partkey AS summary, 'Send ' || sn.n_name || ' signal with value ' || l_quantity::INT AS action,
  CASE l_linenumber WHEN 6 THEN '' WHEN 5 THEN sn.n_name || ' ' || l_quantity::INT ELSE sn.n_name || '=' || l_quantity::INT END AS data,
  'Flag ' || l_returnflag AS expected_result, CASE WHEN l_linestatus = 'O' THEN 'positive' ELSE 'negative' END AS test_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN region r ON cn.n_regionkey = r.r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requirement_id, response, logprobs: the cases of a requirement as a model might write them, by requirement modulo 5: plain
    JSON, fenced, within prose, without outer braces, blank."""
    key = F.col("requirement_id") % 5
    fields = F.struct("summary", "action", "data", "expected_result", "test_type")
    rows = cases(spark, sf_dir).groupBy("requirement_id").agg(F.sort_array(F.collect_list(F.struct("idx", fields.alias("case")))).alias("all"))
    listed = F.to_json(F.transform("all", lambda x: x["case"]))
    plain = F.concat(F.lit('{"test_cases": '), listed, F.lit("}"))
    text = (
        F.when(key == 0, plain)
        .when(key == 1, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n```\nDone.")))
        .when(key == 2, F.concat(F.lit("The cases are "), plain, F.lit(" as asked.")))
        .when(key == 3, F.concat(F.lit('"test_cases": '), listed))
        .otherwise("  ")
    )
    return rows.select("requirement_id", text.alias("response"), F.transform("all", lambda x: -x["idx"] / 10.0).alias("logprobs"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine-tuning examples from conversations: example_id, requirement_text, heading, infos, interfaces (texts), oracle (ids of
    context items: HEADING, INFO_i, IF_i), rating, status, images."""
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    said = lambda role: F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"])
    key = F.col("conv_id")
    rows = rows.select(
        key.alias("example_id"),
        F.coalesce(F.get(said("assistant"), F.lit(0)), F.lit("")).alias("requirement_text"),
        F.coalesce(F.get(said("system"), F.lit(0)), F.lit("")).alias("heading"),
        said("user").alias("infos"),
        F.slice(said("assistant"), F.lit(2), F.greatest(F.lit(0), F.size(said("assistant")))).alias("interfaces"),
        F.when(key % 12 != 0, (key % 6).cast("int")).alias("rating"),
        F.when(key % 5 == 0, "pending").when(key % 5 == 1, "rejected").otherwise("validated").alias("status"),
    )
    key = F.col("example_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), ((key + i) % 3 + 1).cast("int"))
    ids = F.concat(
        F.when((key % 3 != 0) & (F.col("heading") != ""), F.array(F.lit("HEADING"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(F.transform("infos", lambda x, i: i), lambda i: (i + key) % 2 == 0), lambda i: F.concat(F.lit("INFO_"), i)),
        F.transform(F.filter(F.transform("interfaces", lambda x, i: i), lambda i: i % 2 == 0), lambda i: F.concat(F.lit("IF_"), i)),
    )
    image = lambda i: F.struct(
        pick(["PNG", "SVG", "JPEG"], i).alias("format"),
        (30000 * (i + 1) + key % 10 * 60000).cast("long").alias("size_bytes"),
        pick(["state_machine", "", "photo"], i).alias("image_type"),
        pick(["oracle", "distractor", None], i).alias("relevance"),
        F.when(i % 2 == 0, F.col("requirement_text")).otherwise("").alias("description"),
    )
    images = F.when(key % 4 > 0, F.transform(F.sequence(F.lit(0), (key % 4 - 1).cast("int")), image)).otherwise(F.array().cast("array<struct<format:string,size_bytes:bigint,image_type:string,relevance:string,description:string>>"))
    return rows.withColumn("oracle", F.when(key % 7 != 0, ids).otherwise(F.array().cast("array<string>"))).withColumn("images", images)


EXAMPLES = """turns AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'assistant') AS a, list(text ORDER BY turn) FILTER (role = 'user') AS u, list(text ORDER BY turn) FILTER (role = 'system') AS s FROM conversations GROUP BY 1),
base AS (SELECT conv_id AS example_id, coalesce(a[1], '') AS requirement_text, coalesce(s[1], '') AS heading, coalesce(u, []) AS infos, coalesce(a[2:], []) AS interfaces,
  CASE WHEN conv_id % 12 <> 0 THEN (conv_id % 6)::INT END AS rating, CASE conv_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'validated' END AS status FROM turns),
examples AS (SELECT *, CASE WHEN example_id % 7 <> 0 THEN list_concat(list_concat(CASE WHEN example_id % 3 <> 0 AND heading <> '' THEN ['HEADING'] ELSE [] END,
  [('INFO_' || i)::VARCHAR for i in range(0, len(infos)) if (i + example_id) % 2 = 0]), [('IF_' || i)::VARCHAR for i in range(0, len(interfaces)) if i % 2 = 0]) ELSE [] END AS oracle,
  [{'format': (['PNG', 'SVG', 'JPEG'])[(example_id + i) % 3 + 1], 'size_bytes': 30000 * (i + 1) + example_id % 10 * 60000, 'image_type': (['state_machine', '', 'photo'])[(example_id + i) % 3 + 1],
    'relevance': (['oracle', 'distractor', NULL])[(example_id + i) % 3 + 1], 'description': CASE WHEN i % 2 = 0 THEN requirement_text ELSE '' END} for i in range(0, example_id % 4)] AS images FROM base)"""
