"""Queries over images, prompts, reports and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses as R
from ..functions.tables import with_once
from ..functions.text import clean_text
from ..operators import context, images, prompts, raft, reports
from ..sources import adapters
from ..streaming import jobs
from . import raft_queries
from .context_queries import CARRIED, ROWS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


KINDS = ["png", "jpeg", "gif", "xyz"]


def _with_images(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.base64(F.encode("text", "UTF-8"))
    tag = F.concat(F.lit('<p><html:img alt="x" src="data:image/'), kind, F.lit(";base64,"), body, F.lit('" /></p>'))
    data = F.concat(F.lit("pics/p"), F.col("doc_id") % 10, F.when(F.col("doc_id") % 3 == 0, ".png").when(F.col("doc_id") % 3 == 1, ".SVG").otherwise(".txt"))
    thing = F.concat(F.lit('<html:object type="application/x" data="'), data, F.lit('">t</html:object>'))
    return docs.select("doc_id", F.col("source").alias("source_file"), F.concat(tag, thing).alias("text"), F.encode("text", "UTF-8").alias("content"), data.alias("name"))


IMAGES = """im AS (SELECT doc_id, source AS source_file, ([{}])[doc_id % 4 + 1] AS kind, text AS body, 'pics/p' || (doc_id % 10) || CASE doc_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.SVG' ELSE '.txt' END AS name FROM documents)""".format(", ".join(f"'{k}'" for k in KINDS))


@query("c2_embedded_images", f"WITH {IMAGES} SELECT doc_id, 0 AS place, CASE kind WHEN 'xyz' THEN 'unknown' ELSE kind END AS format, octet_length(encode(body))::INT AS size_bytes, sha256(body) AS hash FROM im")
def c2(spark, sf_dir):
    return images.embedded_images(_with_images(spark, sf_dir), "doc_id").select("doc_id", "place", "format", "size_bytes", "hash")


@query("c3_object_images", f"WITH {IMAGES} SELECT doc_id, name AS object_data, CASE doc_id % 3 WHEN 0 THEN 'png' ELSE 'svg' END AS format FROM im WHERE doc_id % 3 < 2")
def c3(spark, sf_dir):
    return images.object_images(_with_images(spark, sf_dir), "doc_id").select("doc_id", "object_data", "format")


@query("c4_image_format", f"WITH {IMAGES} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'svg' ELSE (['png', 'jpeg', 'gif', 'unknown'])[doc_id % 4 + 1] END AS format FROM im")
def c4(spark, sf_dir):
    magic = F.element_at(F.array(*map(F.lit, ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "00"])), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _with_images(spark, sf_dir)
    return rows.select("doc_id", images.image_format(F.col("name"), F.concat(F.unhex(magic), F.col("content"))).alias("format"))


@query("c5_image_hash_dedup", f"WITH {IMAGES} SELECT sha256(body) AS hash, count(*) AS n, min(doc_id) AS first FROM im GROUP BY 1")
def c5(spark, sf_dir):
    return _with_images(spark, sf_dir).groupBy(F.sha2("content", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("c6_image_checks", """WITH s AS (SELECT doc_id, (doc_id * 7) % 6000 + 1 AS w, (doc_id * 13) % 5000 + 1 AS h, doc_id % 13 = 0 AS cut, octet_length(encode(text)) > 10485000 AS heavy FROM documents)
SELECT doc_id, CASE WHEN NOT cut THEN w::INT END AS width, CASE WHEN NOT cut THEN h::INT END AS height, CASE WHEN cut THEN '' ELSE concat_ws(';', CASE WHEN greatest(w, h) > 4096 THEN 'larger than 4096 pixels' END, CASE WHEN least(w, h) < 32 THEN 'smaller than 32 pixels' END,
CASE WHEN greatest(w, h) > 10 * least(w, h) THEN 'aspect ratio above 10' END) END AS warnings, CASE WHEN cut THEN 'unreadable' END AS error FROM s""")
def c6(spark, sf_dir):
    """Headers of six formats, each before the bytes of a text, some cut off."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key, w, h = F.col("doc_id"), F.col("doc_id") * 7 % 6000 + 1, F.col("doc_id") * 13 % 5000 + 1
    big = lambda n, size: F.lpad(F.hex(n), 2 * size, "0")
    little = lambda n, size: F.concat(*(F.substring(big(n, size), 2 * size - 1 - 2 * k, 2) for k in range(size)))
    # a comment of up to 9 bytes and a table stand before the frame of a JPEG; the directory of a TIFF has another entry first
    comment = F.concat(F.lit("FFFE"), big(key % 10 + 2, 2), F.repeat(F.lit("FF"), (key % 10).cast("int")), F.lit("FFC40003AA"))
    entry = lambda tag, n: F.concat(F.lit(tag + "0400" + "01000000"), little(n, 4))
    heads = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4)), F.concat(F.lit("474946383961"), little(w, 2), little(h, 2)),
        F.concat(F.lit("424D" + "00" * 16), little(w, 4), little(h, 4)), F.concat(F.lit("FFD8FFE000044A46"), comment, F.lit("FFC2001108"), big(h, 2), big(w, 2)),
        F.concat(F.lit("49492A00080000000300"), entry("FE00", F.lit(0)), entry("0001", w), entry("0101", h)), F.concat(F.lit("5249464600000000574542505650385800000000" + "00" * 4), little(w - 1, 3), little(h - 1, 3)),
    ]
    header = F.unhex(F.element_at(F.array(*heads), (key % 6 + 1).cast("int")))
    whole = F.concat(header, F.encode("text", "UTF-8"))
    content = F.when(key % 13 == 0, F.substring(header, F.lit(1), F.octet_length(header) - 4)).otherwise(whole)
    rows = images.image_checks(docs.select("doc_id", content.alias("content")))
    return rows.select("doc_id", "width", "height", F.array_join("warnings", ";").alias("warnings"), "error")


@query("c7_link_images", f"""WITH {IMAGES}, attached AS (SELECT DISTINCT source_file, name FROM im WHERE doc_id % 2 = 0)
SELECT i.source_file, i.doc_id AS id, CASE WHEN a.name IS NULL THEN 0 ELSE 1 END AS n FROM im i LEFT JOIN attached a ON a.source_file = i.source_file AND a.name = i.name""")
def c7(spark, sf_dir):
    rows = _with_images(spark, sf_dir)
    attached = rows.where("doc_id % 2 = 0").select("source_file", F.col("name").alias("ref_key"), F.col("name").alias("image_id")).distinct()
    linked = images.link_images(rows.withColumnRenamed("doc_id", "id"), attached)
    return linked.select("source_file", "id", F.size("images").alias("n"))


@query("c8_image_report", f"""WITH {IMAGES} SELECT source_file, 2 * count(*) + count(*) FILTER (doc_id % 3 < 2) AS total, count(*) AS external, count(*) + count(*) FILTER (doc_id % 3 < 2) AS embedded,
count(*) FILTER (doc_id % 8 > 0) + count(*) FILTER (doc_id % 9 > 0) AS saved, count(*) FILTER (doc_id % 8 = 0) + count(*) FILTER (doc_id % 9 = 0) AS failed FROM im GROUP BY 1""")
def c8(spark, sf_dir):
    rows = _with_images(spark, sf_dir)
    attached = rows.select("source_file", F.when(F.col("doc_id") % 8 > 0, F.col("content")).alias("content"))
    spoilt = rows.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.replace("text", F.lit("base64,"), F.lit("base64,*"))).otherwise(F.col("text")))
    return images.image_report(attached, images.embedded_images(spoilt, "source_file"), images.object_images(rows, "source_file"))


@query("a9_image_names", "SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '[<>:\"/\\\\|?*]', '_', 'g') AS name FROM pages")
def a9(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", images.safe_name(F.col("url")).alias("name"))


EX = f"WITH {adapters.EXAMPLES}"


@query("d5_route_model", f"{EX} SELECT example_id % 10 > 0 AS enabled, CASE WHEN example_id % 10 > 0 AND len([x for x in images if x.image_type <> '']) > 0 THEN 'vision' ELSE 'text' END AS model, count(*) AS n FROM examples GROUP BY ALL")
def d5(spark, sf_dir):
    """Images without a type were not saved; every tenth requirement has vision disabled."""
    rows = adapters.examples(spark, sf_dir)
    saved = F.transform("images", lambda x: F.struct(F.when(x["image_type"] != "", F.concat(F.lit("/images/"), x["image_type"])).alias("saved_path")))
    enabled = F.col("example_id") % 10 > 0
    return rows.groupBy(enabled.alias("enabled"), images.route_model(saved, enabled).alias("model")).agg(F.count("*").alias("n"))


RULES = [("heading", "the", "door"), ("heading", "der", "unknown"), ("id", "art_1", "window"), ("heading", "la", "light")]
CHOICE = "CASE WHEN contains(lower(heading), 'the') THEN 'door' WHEN contains(lower(heading), 'la') THEN 'light' WHEN contains(upper(id), 'ART_1') THEN 'window' ELSE 'default' END"


def _headed(spark, sf_dir):
    rows = adapters.artifacts(spark, sf_dir).select("source_file", "seq", "id", clean_text(F.col("text")).alias("clean"))
    return rows.withColumn("heading", F.col("clean"))


HEADED = f"{ROWS}, headed AS (SELECT source_file, seq, id, clean, clean AS heading FROM rows_)"


@query("d6_select_template", f"{HEADED} SELECT id, {CHOICE} AS template FROM headed")
def d6(spark, sf_dir):
    return prompts.select_template(_headed(spark, sf_dir), RULES, {"door", "window", "light", "default"}, "default").select("id", "template")


@query("d7_format_table", """WITH k AS (SELECT p_brand AS name, * FROM part UNION ALL SELECT 'all', * FROM part UNION ALL SELECT p_brand || '/' || (p_partkey % 2), * FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY name) AS n, p_name || ' | ' || p_size AS cells FROM k),
l AS (SELECT *, printf('R%02d: ', i) || cells AS line FROM r)
SELECT name, 'Table Data:' || chr(10) || 'name | size' || chr(10) || '-----------' || chr(10) || CASE WHEN any_value(n) <= 20 THEN string_agg(cells || ' | Row ' || i, chr(10) ORDER BY i) WHEN any_value(n) <= 50 THEN string_agg(line, chr(10) ORDER BY i)
ELSE string_agg(line, chr(10) ORDER BY i) FILTER (i <= 10) || chr(10) || '... (showing first 10 and last 10 of ' || any_value(n) || ' total rows) ...' || chr(10) || string_agg(line, chr(10) ORDER BY i) FILTER (i > n - 10) END
|| chr(10) || chr(10) || 'Table contains ' || any_value(n) || ' rows total.' AS text FROM l GROUP BY 1""")
def d7(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", "p_name", "p_size")
    half = F.concat("p_brand", F.lit("/"), F.col("p_partkey") % 2)
    rows = part.select(F.explode(F.array("p_brand", F.lit("all"), half)).alias("name"), "p_partkey", "p_name", "p_size")
    return prompts.table_texts(rows, "name", "p_partkey", {"name": F.col("p_name"), "size": F.col("p_size")})


@query("d8_format_lists", f"""{EX} SELECT example_id, CASE WHEN len(infos) > 0 THEN array_to_string(['- ' || x for x in infos], chr(10)) ELSE 'None' END AS info,
CASE WHEN len(images) > 0 THEN len(images) || ' diagram(s) attached (' || array_to_string(list_sort(list_distinct([upper(x.format) for x in images])), ', ') || '). ' || chr(10) || chr(10)
|| CASE len(images) WHEN 1 THEN 'When analyzing the diagram:' ELSE 'When analyzing the diagrams:' END || chr(10) || '{prompts.GUIDANCE}' ELSE '{prompts.NO_IMAGES}' END AS images FROM examples""")
def d8(spark, sf_dir):
    rows = adapters.examples(spark, sf_dir)
    return rows.select("example_id", prompts.info_lines(F.col("infos")).alias("info"), prompts.image_context(F.transform("images", lambda x: x["format"])).alias("images"))


@query("d9_render_prompts", f"""{EX} SELECT example_id, CASE WHEN requirement_text = '' THEN 'Requirement missing under ' || coalesce(nullif(heading, ''), 'No Heading') ELSE 'Under ' || coalesce(nullif(heading, ''), 'No Heading') || ': ' || requirement_text END AS prompt FROM examples""")
def d9(spark, sf_dir):
    values = {"heading": F.col("heading"), "text": F.col("requirement_text")}
    prompt = prompts.render("Under {heading}: {text}", values, ["text"], {"heading": "No Heading"}, "Requirement missing under {heading}")
    return adapters.examples(spark, sf_dir).select("example_id", prompt.alias("prompt"))


@query("d10_template_usage", f"{HEADED} SELECT {CHOICE} AS template, count(*) AS n FROM headed GROUP BY 1")
def d10(spark, sf_dir):
    return d6(spark, sf_dir).groupBy("template").agg(F.count("*").alias("n"))


def _requirements(spark, sf_dir):
    rows = with_once(adapters.responses(spark, sf_dir), "parsed", R.parse_response(F.col("response")))
    rows = with_once(rows, "error_type", R.triage(F.col("response"), F.col("parsed")))
    return rows.select("requirement_id", F.concat(F.lit("F"), F.col("requirement_id") % 20).alias("source_file"), "error_type", (F.col("requirement_id") % 9).alias("seconds"))


def _timed(spark, sf_dir):
    return _requirements(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("requirement_id")))


REQS = f"""WITH {adapters.CASES}, req AS (SELECT requirement_id, 'F' || (requirement_id % 20) AS source_file, CASE requirement_id % 5 WHEN 4 THEN 'EmptyResponse' WHEN 3 THEN 'InvalidJSONStructure' ELSE 'ok' END AS error_type, requirement_id % 9 AS seconds,
count(*) FILTER (test_type = 'positive') AS p, count(*) FILTER (test_type = 'negative') AS n FROM cases GROUP BY requirement_id),
rep AS (SELECT source_file, count(*) AS requirements, count(*) FILTER (error_type = 'ok') AS successful, count(*) FILTER (error_type <> 'ok') AS failed, coalesce(sum(p) FILTER (error_type = 'ok'), 0)::BIGINT AS positive, coalesce(sum(n) FILTER (error_type = 'ok'), 0)::BIGINT AS negative, sum(seconds)::BIGINT AS seconds FROM req GROUP BY 1)"""


@query("j1_file_report", f"""{REQS}, {adapters.ARTIFACTS}, found AS (SELECT 'F' || substr(source_file, 4) AS source_file, type, text FROM artifacts),
kinds AS (SELECT source_file, string_agg(type || '=' || n, ',' ORDER BY type) AS artifacts, sum(n)::BIGINT AS n_artifacts FROM (SELECT source_file, type, count(*) AS n FROM found GROUP BY ALL) GROUP BY 1),
skip AS (SELECT source_file, count(*) FILTER (type = 'System Requirement' AND text = '') AS skipped FROM found GROUP BY 1)
SELECT source_file, requirements, successful, failed, positive, negative, CASE WHEN successful > 0 THEN round((positive + negative) / successful, 2) ELSE 0 END AS tests_per_requirement,
round(successful / requirements * 100, 1) AS success_percent, round(requirements / seconds, 2) AS per_second, round(seconds / requirements, 2) AS mean_seconds, coalesce(artifacts, '') AS artifacts, coalesce(n_artifacts, 0) AS n_artifacts, coalesce(skipped, 0) AS skipped
FROM rep LEFT JOIN kinds USING (source_file) LEFT JOIN skip USING (source_file)""")
def j1(spark, sf_dir):
    found = adapters.artifacts(spark, sf_dir).withColumn("source_file", F.concat(F.lit("F"), F.substring("source_file", 4, 99)))
    rows = reports.file_report(_requirements(spark, sf_dir), adapters.cases(spark, sf_dir), found)
    kinds = F.array_sort(F.transform(F.map_entries("artifacts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.withColumn("artifacts", F.array_join(kinds, ","))


@query("j2_run_performance", "SELECT round(avg((event_type <> 'error')::INT) * 100, 1) AS success_percent, round(avg(value), 1) AS mean, round(max(value), 1) AS peak FROM events")
def j2(spark, sf_dir):
    return reports.run_performance(spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_type") != "error").alias("success"), "value"))


@query("j3_failure_details", f"""{REQS} SELECT source_file, requirement_id, error_type AS error, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * requirement_id AS at FROM req WHERE error_type <> 'ok'""")
def j3(spark, sf_dir):
    return reports.failure_details(_timed(spark, sf_dir)).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("j3_file_warnings", f"""{REQS}, said AS (SELECT source_file, requirement_id, 'slow: ' || seconds || ' s' AS warning FROM req WHERE seconds > 6 UNION ALL SELECT source_file, requirement_id, error_type FROM req WHERE error_type = 'InvalidJSONStructure')
SELECT source_file, warning, count(*) AS n, min(requirement_id) AS first FROM said GROUP BY ALL""")
def j3_warnings(spark, sf_dir):
    slow = F.when(F.col("seconds") > 6, F.concat(F.lit("slow: "), "seconds", F.lit(" s")))
    odd = F.when(F.col("error_type") == "InvalidJSONStructure", F.col("error_type"))
    return reports.file_warnings(_timed(spark, sf_dir).withColumn("warnings", F.array_compact(F.array(slow, odd))))


@query("j4_session_metrics", """SELECT user_id AS session_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS warnings, count(*) FILTER (event_type = 'purchase' AND value > 50) AS files,
coalesce(sum(value::INT) FILTER (event_type = 'purchase' AND value > 50), 0)::BIGINT AS tests, arg_max(value, (ts, event_id)) AS last_uptime FROM events GROUP BY 1""")
def j4(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    logs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("session_id"), "ts", level.alias("level"), "event_type", (F.col("value") > 50).alias("success"), F.bround("value").cast("int").alias("tests"), F.col("value").alias("uptime"))
    return reports.session_metrics(logs)


@query("j5_directory_result", f"{REQS} SELECT bool_or(successful > 0) AS success, count(*) AS files, sum(requirements)::BIGINT AS requirements, sum(positive + negative)::BIGINT AS tests FROM rep")
def j5(spark, sf_dir):
    return reports.directory_result(j1(spark, sf_dir))


@query("j5_while_writing", f"{REQS} SELECT count(*) AS requirements, count(*) FILTER (error_type = 'ok') AS successful, count(*) FILTER (error_type <> 'ok') AS failed, sum(seconds)::BIGINT AS seconds, max(seconds)::BIGINT AS slowest, count(*) FILTER (error_type = 'ok') > 0 AS success FROM req")
def j5_observed(spark, sf_dir):
    return reports.write_observed(_requirements(spark, sf_dir), jobs._folder(spark, "requirements"))


@query("j6_extraction_audit", f"""{CARRIED}, marked AS (SELECT *, text <> '' AND seq % 6 = 0 AS tabled FROM artifacts),
sums AS (SELECT source_file, count(*) AS artifacts, count(DISTINCT type) AS types, count(*) FILTER (type = 'System Requirement') AS requirements, count(*) FILTER (type = 'System Requirement' AND text <> '') AS with_text,
count(*) FILTER (type = 'System Requirement' AND tabled) AS with_tables, coalesce(sum(seq % 3 + 1) FILTER (type = 'System Requirement' AND tabled), 0)::BIGINT AS tables, count(*) FILTER (type = 'Information') AS infos, count(*) FILTER (type = 'System Interface') AS interfaces FROM marked GROUP BY 1),
ctx AS (SELECT source_file, round(avg(n_info), 6) AS infos_per_requirement, max(n_info) AS most_infos FROM reqs GROUP BY 1)
SELECT s.*, types >= 2 AS varied, coalesce(infos_per_requirement, 0) AS infos_per_requirement, coalesce(most_infos, 0) AS most_infos FROM sums s LEFT JOIN ctx USING (source_file)""")
def j6(spark, sf_dir):
    rows = adapters.artifacts(spark, sf_dir)
    table = F.repeat(F.lit("<table><tr><td>a</td></tr></table>"), (F.col("seq") % 3 + 1).cast("int"))
    marked = rows.withColumn("text", F.when((F.col("text") != "") & (F.col("seq") % 6 == 0), F.concat("text", table)).otherwise(F.col("text")))
    return reports.extraction_audit(marked, context.info_context(rows))


@query("k1_stream_session_metrics", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n FROM events GROUP BY ALL")
def k1(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return jobs.session_windows(spark, f"{path}*", spark.read.parquet(path).schema)


#: Files a batch of the streams below.
FILES = 16


@query("k2_stream_collection", "SELECT conv_id, count(*) AS copies FROM conversations GROUP BY 1")
def k2(spark, sf_dir):
    """Each conversation once, though its turns come in several files, with how many rows stood for it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = jobs._folder(spark, "turns")
    turns.write.partitionBy("role").parquet(path)
    once = jobs.collect_once(spark, f"{path}/*", turns.drop("role").schema, "conv_id", files=FILES)
    return once.select("conv_id").join(turns.groupBy("conv_id").agg(F.count("*").alias("copies")), "conv_id")


@query("k2_running_stats", raft_queries.ORACLES["i3_collection_stats"])
def k2_stats(spark, sf_dir):
    """The figures of all examples after the last batch; examples come as files by status, and every second one comes twice."""
    rows, path = adapters.examples(spark, sf_dir), jobs._folder(spark, "examples")
    for part in (rows, rows.where("example_id % 2 = 0")):
        part.write.mode("append").json(path)
    after = jobs.running_stats(spark, path, rows.schema, "example_id", raft.collection_stats, files=FILES, form="json")
    last = after.agg(F.max_by(F.struct(*(c for c in after.columns if c != "batch")), "batch").alias("last"))
    return last.select("last.*")
