"""Queries over archives, files and HTML tables that Spark makes of the given tables, with their SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import functions as F

from ..functions.html_tables import html_tables
from ..functions.shipping import ship
from ..operators import raft, reports
from ..sources import adapters, archives, files, sinks
from ..streaming.jobs import _folder
from . import case_queries, raft_queries, report_queries
from .context_queries import clean_sql, clean_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _archive(rows: pd.DataFrame) -> bytes:
    """A ReqIF archive of artifacts (seq, id, type, text); every object but the first relates to the one before."""
    kinds = sorted(set(rows["type"]))
    types = "".join(
        f'<SPEC-OBJECT-TYPE IDENTIFIER="t{k}" LONG-NAME={quoteattr(t)}><SPEC-ATTRIBUTES><ATTRIBUTE-DEFINITION-STRING IDENTIFIER="f{k}" LONG-NAME="ReqIF.ForeignID"/>'
        f'<ATTRIBUTE-DEFINITION-XHTML IDENTIFIER="x{k}" LONG-NAME="ReqIF.Text"/></SPEC-ATTRIBUTES></SPEC-OBJECT-TYPE>'
        for k, t in enumerate(kinds)
    )
    types += '<SPEC-RELATION-TYPE IDENTIFIER="r" LONG-NAME="refines"/>'
    objects, relations = [], []
    for n, (_, name, kind, text) in enumerate(rows.itertuples(index=False)):
        k = kinds.index(kind)
        objects.append(
            f'<SPEC-OBJECT IDENTIFIER="o{n}"><TYPE><SPEC-OBJECT-TYPE-REF>t{k}</SPEC-OBJECT-TYPE-REF></TYPE><VALUES>'
            f'<ATTRIBUTE-VALUE-STRING THE-VALUE={quoteattr(name)}><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>f{k}</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING>'
            f"<ATTRIBUTE-VALUE-XHTML><DEFINITION><ATTRIBUTE-DEFINITION-XHTML-REF>x{k}</ATTRIBUTE-DEFINITION-XHTML-REF></DEFINITION><THE-VALUE><h:div>{escape(text)}</h:div></THE-VALUE></ATTRIBUTE-VALUE-XHTML></VALUES></SPEC-OBJECT>"
        )
        if n:
            relations.append(
                f'<SPEC-RELATION IDENTIFIER="l{n}"><SOURCE><SPEC-OBJECT-REF>o{n - 1}</SPEC-OBJECT-REF></SOURCE><TARGET><SPEC-OBJECT-REF>o{n}</SPEC-OBJECT-REF></TARGET><TYPE><SPEC-RELATION-TYPE-REF>r</SPEC-RELATION-TYPE-REF></TYPE></SPEC-RELATION>'
            )
    space = 'xmlns="http://www.omg.org/spec/ReqIF/20110401/reqif.xsd" xmlns:h="http://www.w3.org/1999/xhtml"'
    xml = f'<?xml version="1.0" encoding="UTF-8"?><REQ-IF {space}><SPEC-TYPES>{types}</SPEC-TYPES><SPEC-OBJECTS>{"".join(objects)}</SPEC-OBJECTS><SPEC-RELATIONS>{"".join(relations)}</SPEC-RELATIONS></REQ-IF>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("spec.reqif", xml)
        z.writestr("1/a.png", b"\x89PNG" + str(len(rows)).encode())
    return out.getvalue()


PER_FILE = 50  # artifacts an archive


def _archives(spark, sf_dir):
    """path, content: the documents as archives of PER_FILE artifacts each."""
    ship(spark)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [_archive(rows[["seq", "id", "type", "text"]])]})

    made = adapters.artifacts(spark, sf_dir).select(F.concat(F.lit("a"), F.floor(F.col("seq") / PER_FILE)).alias("path"), "seq", "id", "type", "text")
    return made.groupBy("path").applyInPandas(pack, "path string, content binary")


def _parsed(spark, sf_dir):
    return archives.parse_archives(_archives(spark, sf_dir))


#: What is done to every seventh archive in turn before it is written: kept, cut, no members, no ZIP, a flipped byte, encrypted.
BROKEN = ["", "BadZipFile", "no ReqIF member", "BadZipFile", "error", "RuntimeError"]


def _broken(content, how):
    """An archive spoilt as BROKEN says."""
    n, name = F.octet_length(content), F.octet_length(F.lit("spec.reqif"))
    cut = lambda start, length: F.substring(content, start, length)
    first = 30 + name  # the header of the first member, then its data
    # a block of a reserved type right at the start of the member; the flag of encryption in its header and in the directory
    flip = F.concat(cut(F.lit(1), first), F.lit(b"\x07"), cut(first + 2, n))
    flags = F.concat(cut(F.lit(1), F.lit(6)), F.lit(b"\x01"), cut(F.lit(8), n))
    at = F.instr(F.hex(flags), "504B0102")
    flags = F.concat(F.substring(flags, F.lit(1), F.floor(at / 2).cast("int") + 8), F.lit(b"\x01"), F.substring(flags, F.floor(at / 2).cast("int") + 10, n))
    return F.when(how == 1, cut(F.lit(1), F.floor(n / 2).cast("int"))).when(how == 2, F.lit(b"PK\x05\x06" + bytes(18))).when(how == 3, F.lit(b"no archive")).when(how == 4, flip).when(how == 5, flags).otherwise(content)


def _scanned(spark, sf_dir):
    """Archives written as files, some of them broken, read back and parsed."""
    number = F.substring("path", 2, 99).cast("long")
    how = F.when(number % 7 == 6, F.floor(number / 7) % len(BROKEN)).otherwise(0)
    rows = _archives(spark, sf_dir).select(F.concat("path", F.lit(".reqifz")).alias("name"), _broken(F.col("content"), how).alias("content"))
    folder = _written(spark, "archives", lambda p: sinks.write_named(rows, p, whole="true"))
    return archives.parse_archives(archives.read_archives(spark, folder)).withColumn("source_file", F.regexp_extract("source_file", r"([^/]+)\.reqifz$", 1))


ART = f"WITH {adapters.ARTIFACTS}, a AS (SELECT *, 'a' || (seq // {PER_FILE}) AS path, row_number() OVER (PARTITION BY seq // {PER_FILE} ORDER BY seq) - 1 AS n FROM artifacts)"


HOW = f"how AS (SELECT path, count(*) AS n, count(DISTINCT type) AS types, CASE WHEN any_value(seq) // {PER_FILE} % 7 = 6 THEN ([{', '.join(f"'{x}'" for x in BROKEN)}])[(any_value(seq) // {PER_FILE} // 7) % {len(BROKEN)} + 1] ELSE '' END AS error FROM a GROUP BY 1)"


@query("a1_scan_archives", f"""{ART}, {HOW} SELECT path AS source_file, CASE WHEN error = '' THEN n ELSE 0 END AS objects, CASE WHEN error = '' THEN n - 1 ELSE 0 END AS relations,
CASE WHEN error = '' THEN 1 ELSE 0 END AS images, error AS errors FROM how""")
def a1(spark, sf_dir):
    return archives.scan_report(_scanned(spark, sf_dir)).withColumn("errors", F.array_join("errors", ","))


@query("b1_spec_lookups", f"""{ART}, {HOW}, k AS (SELECT path, type, row_number() OVER (PARTITION BY path ORDER BY type) - 1 AS k FROM (SELECT DISTINCT path, type FROM a) SEMI JOIN (SELECT * FROM how WHERE error = '') USING (path))
SELECT path AS source_file, unnest(['object_type', 'attribute', 'attribute', 'foreign_id']) AS lookup, unnest(['t' || k, 'f' || k, 'x' || k, 't' || k]) AS identifier, unnest([type, 'ReqIF.ForeignID', 'ReqIF.Text', 'f' || k]) AS value FROM k
UNION ALL SELECT path, 'relation_type', 'r', 'refines' FROM how WHERE error = ''""")
def b1(spark, sf_dir):
    return archives.lookups_of(_scanned(spark, sf_dir))


@query("b2_spec_objects", f"{ART} SELECT path AS source_file, n AS seq, id, type, {clean_sql('text')} AS text FROM a")
def b2(spark, sf_dir):
    rows = archives.artifacts_of(_parsed(spark, sf_dir))
    plain = F.replace(F.replace(F.replace(clean_text(F.col("text")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return rows.select("source_file", "seq", "id", "type", clean_text(plain).alias("text"))


@query("b3_resolve_ids", f"{ART} SELECT b.path AS source_file, a.id AS source_id, b.id AS target_id, 'refines' AS relation_type_name FROM a JOIN a b ON a.path = b.path AND a.n + 1 = b.n")
def b3(spark, sf_dir):
    return archives.relations_of(_parsed(spark, sf_dir)).select("source_file", "source_id", "target_id", "relation_type_name")


@query("c1_external_images", f"{ART} SELECT path AS source_file, '1/a.png' AS name, (4 + length(count(*)::VARCHAR))::INT AS size_bytes FROM a GROUP BY 1")
def c1(spark, sf_dir):
    return archives.images_of(_parsed(spark, sf_dir)).select("source_file", "name", "size_bytes")


@query("b8_html_tables", "SELECT p_brand, p_partkey::VARCHAR AS part, p_name AS name, p_size::VARCHAR AS size FROM part")
def b8(spark, sf_dir):
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell("p_partkey"), cell("p_name"), cell("p_size"), F.lit("</tr>"))
    html = F.concat(F.lit("<style>td{}</style><table><tr><th>part</th><th>name</th><th></th></tr>"), F.array_join(F.collect_list("row"), "<tr><td> </td></tr>"), F.lit("</table>"))
    pages = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", row.alias("row")).groupBy("p_brand", F.floor(F.col("p_partkey") / 500).alias("page")).agg(html.alias("html"))
    rows = pages.select("p_brand", F.explode(html_tables(F.col("html"))).alias("r"))
    return rows.select("p_brand", F.col("r.cells")["part"].alias("part"), F.col("r.cells")["name"].alias("name"), F.col("r.cells")["Column_3"].alias("size"))


def _written(spark, name: str, write) -> str:
    path = _folder(spark, name)
    write(path)
    return path


@query("a2_read_examples", f"""WITH {adapters.EXAMPLES} SELECT CASE WHEN example_id % 3 = 0 THEN 'raft_' || example_id || '.json' ELSE example_id || '_annotated.json' END AS file, example_id, status, rating, len(infos) AS n_infos,
array_to_string(oracle, ',') AS oracle FROM examples WHERE example_id % 11 <> 5 AND example_id % 7 <> 3""")
def a2(spark, sf_dir):
    """One JSON file an example, in folders by status; files of other names and broken ones are left out."""
    key, rows = F.col("example_id"), adapters.examples(spark, sf_dir)
    name = F.when(key % 11 == 5, F.concat(F.lit("other_"), key, F.lit(".json"))).when(key % 3 == 0, F.concat(F.lit("raft_"), key, F.lit(".json"))).otherwise(F.concat(key, F.lit("_annotated.json")))
    text = F.to_json(F.struct("example_id", "infos", "oracle", "rating"), {"pretty": "true"})
    text = F.when(key % 7 == 3, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).otherwise(text)
    path = _written(spark, "examples", lambda p: sinks.write_named(rows.select(F.concat_ws("/", "status", name).alias("name"), text.alias("content")), p, whole="true"))
    found = files.read_examples(spark, path, "example_id long, infos array<string>, oracle array<string>, rating int", "{raft_*,*_annotated}.json")
    parts = F.split("file", "/")
    return found.select(F.element_at(parts, -1).alias("file"), "example_id", F.element_at(parts, -2).alias("status"), "rating", F.size("infos").cast("long").alias("n_infos"), F.array_join("oracle", ",").alias("oracle"))


@query("a3_read_chat_jsonl", f"{raft_queries.TRAIN} SELECT example_id, content FROM chat")
def a3(spark, sf_dir):
    path = _written(spark, "chat", lambda p: files.write_chat(raft_queries._chat(spark, sf_dir), p))
    return files.read_chat(spark, path).select("example_id", F.get("messages", F.lit(1))["content"].alias("content"))


DAMAGE = "CASE example_id % 5 WHEN 0 THEN 'Missing ''messages'' field' WHEN 1 THEN 'Expected 3 messages, got 2' WHEN 2 THEN 'not JSON' END"


@query("i14_chat_issues", f"""{raft_queries.TRAIN}, n AS (SELECT example_id, 'chat-' || (example_id % 3) || '.jsonl' AS file, row_number() OVER (PARTITION BY example_id % 3 ORDER BY example_id) - 1 AS number, {DAMAGE} AS what FROM chat)
SELECT file, number, 'Example ' || number || ': ' || what AS issue FROM n WHERE what IS NOT NULL""")
def i14_issues(spark, sf_dir):
    """Chat files, some rows of which are damaged, and the places of those rows."""
    kind, chat = F.col("example_id") % 5, raft_queries._chat(spark, sf_dir)
    rest = F.to_json(F.struct("example_id", F.slice("messages", 1, 2).alias("messages"), "metadata"))
    line = F.when(kind == 0, F.to_json(F.struct("example_id", "metadata"))).when(kind == 1, rest).when(kind == 2, F.lit('{"messages": [')).otherwise(F.to_json(F.struct("example_id", "messages", "metadata")))
    rows = chat.select(F.concat(F.lit("chat-"), F.col("example_id") % 3, F.lit(".jsonl")).alias("name"), "example_id", F.concat(line, F.lit("\n")).alias("content"))
    rows = rows.repartition("name").sortWithinPartitions("name", "example_id").select("name", "content")
    path = _written(spark, "chat", lambda p: sinks.write_named(rows, p))
    return raft.chat_issues(spark.read.text(path)).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))


@query("a4_read_logs", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def a4(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    logs = events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), F.lit("INFO").alias("level"), F.col("user_id").alias("session_id"), "event_type", "value")
    path = _written(spark, "logs", lambda p: logs.write.json(p))
    return files.read_logs(spark, path).where("ts IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("a4_open_logs", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE event_type = 'purchase')
SELECT user_id::VARCHAR AS session_id, count(*) AS records, array_to_string(list_sort(list_distinct(flatten(list(CASE e.event_type WHEN 'error' THEN ['code', 'where'] WHEN 'click' THEN ['k'] ELSE [] END)))), ',') AS keys,
any_value(l.event_id) AS files, any_value(l.event_id % 50) AS tests, any_value(l.value) AS peak_cpu FROM events e LEFT JOIN (SELECT * FROM l WHERE back = 1) l USING (user_id) GROUP BY 1""")
def a4_open(spark, sf_dir):
    """Log records with other fields for each kind of event; purchases bring the session's final metrics so far."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    extra = F.when(kind == "error", F.concat(F.lit('"extra":{"code":'), "event_id", F.lit(',"where":["a",1]},'))).when(kind == "click", F.concat(F.lit('"extra":'), "props", F.lit(","))).otherwise("")
    final = F.concat(F.lit('"final_metrics":{"files_processed":'), "event_id", F.lit(',"test_cases_generated":'), F.col("event_id") % 50, F.lit(',"performance_stats":{"peak_cpu_percent":'), "value", F.lit("}},"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.concat(F.lit("{"), extra, F.when(kind == "purchase", final).otherwise(""), F.lit('"session_id":"'), "user_id", F.lit('","event_type":"'), kind, F.lit('","timestamp":"'), stamp, F.lit('"}'))
    path = _written(spark, "logs", lambda p: events.select(line.alias("value")).write.text(p))
    return reports.final_metrics(files.read_open_logs(spark, path)).withColumn("keys", F.array_join("keys", ","))


@query("a5_read_cases_csv", f"{case_queries.FIELDS} SELECT requirement_id::VARCHAR AS requirement, '[' || summary || ']' AS summary, action || chr(10) || data_text AS text FROM fields")
def a5(spark, sf_dir):
    table = case_queries._table(spark, sf_dir).select("LinkTest", "Summary", F.concat_ws("\n", "Action", "Data").alias("Text"), F.concat(F.lit("F"), F.col("LinkTest").cast("long") % 20).alias("source_file"))
    path = _written(spark, "cases", lambda p: files.write_cases(table, p, "source_file", gzip=True))
    return files.read_cases_csv(spark, path).select(F.col("LinkTest").alias("requirement"), F.col("Summary").alias("summary"), F.col("Text").alias("text"))


@query("a6_write_cases", f"""SELECT 'F' || ("LinkTest"::BIGINT % 20) || '.csv' AS file, * FROM ({case_queries.ORACLES["h4_jira_table"]})""")
def a6(spark, sf_dir):
    """Written as one file for each source file, and read back with the file that each row stands in."""
    table = case_queries._table(spark, sf_dir).withColumn("source_file", F.concat(F.lit("F"), F.col("LinkTest").cast("long") % 20))
    path = _written(spark, "tables", lambda p: files.write_cases(table, p, "source_file", order=("LinkTest", "Issue ID"), gzip=True))
    name = F.substring_index(F.input_file_name(), "/", -1)
    rows = files.read_cases_csv(spark, path).withColumn("file", F.substring(name, F.lit(1), F.length(name) - 3))  # without .gz
    return rows.na.fill("")


@query("a9_write_images", """SELECT source AS source_file, 'p' || (doc_id % 10) || CASE doc_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.SVG' ELSE '.txt' END AS name, count(*) AS same_name, sha256(arg_max(text, doc_id)) AS hash FROM documents GROUP BY ALL""")
def a9_files(spark, sf_dir):
    """Image files, a folder for each archive, read back; of equal names the last one stays."""
    rows = report_queries._with_images(spark, sf_dir).withColumn("seq", F.col("doc_id"))
    path = _written(spark, "images", lambda p: files.write_images(rows, p))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    read = read.select(F.element_at(parts, -2).alias("source_file"), F.element_at(parts, -1).alias("name"), F.sha2("content", 256).alias("hash"))
    counts = rows.groupBy("source_file", F.element_at(F.split("name", "/"), -1).alias("name")).agg(F.count("*").alias("same_name"))
    return read.join(counts, ["source_file", "name"])


@query("a8_write_examples", f"WITH {adapters.EXAMPLES} SELECT status, count(*) AS n, sum(len(infos))::BIGINT AS infos FROM examples GROUP BY 1")
def a8(spark, sf_dir):
    path = _written(spark, "examples", lambda p: files.write_examples(adapters.examples(spark, sf_dir).select("example_id", "infos", "status"), p))
    rows = spark.read.schema("example_id long, infos array<string>, status string").json(path)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("infos")).alias("infos"))
