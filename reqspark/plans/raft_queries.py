"""Queries over fine-tuning examples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, quality, raft
from ..sources import adapters
from .context_queries import CARRIED

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


E = f"WITH {adapters.EXAMPLES}"
ITEMS = f"""{E}, items AS (SELECT example_id, oracle, 'HEADING' AS id, 'Heading' AS kind, heading AS text, 0 AS g, 0 AS i FROM examples WHERE heading <> ''
UNION ALL SELECT example_id, oracle, 'INFO_' || (i - 1), 'Information', infos[i], 1, i FROM (SELECT *, unnest(range(1, len(infos) + 1)) AS i FROM examples)
UNION ALL SELECT example_id, oracle, 'IF_' || (i - 1), 'Interface', interfaces[i], 2, i FROM (SELECT *, unnest(range(1, len(interfaces) + 1)) AS i FROM examples))"""
TRAIN = f"""{ITEMS}, kept AS (SELECT * FROM examples WHERE len(oracle) > 0 AND NOT (coalesce(rating, 0) <> 0 AND coalesce(rating, 0) < 3)),
docs AS (SELECT example_id, list_contains(oracle, id) AS o, (CASE kind WHEN 'Interface' THEN 'Interface ' || id ELSE kind END) || ': ' || text AS doc, g, i FROM items),
ctx AS (SELECT example_id, coalesce(list(doc ORDER BY g, i) FILTER (o), []) AS oc, coalesce(list(doc ORDER BY g, i) FILTER (NOT o), []) AS dc FROM docs GROUP BY 1),
train AS (SELECT k.example_id, 'Generate comprehensive test cases for requirement ' || k.example_id || ': ' || requirement_text AS question, coalesce(oc, []) AS oc, coalesce(dc, []) AS dc,
  len([x for x in images if coalesce(x.relevance, 'oracle') = 'oracle']) AS n_o, len([x for x in images if x.relevance = 'distractor']) AS n_d, len(images) > 0 AS has_images, images, rating, 'Test Case 1: ' || requirement_text AS answer FROM kept k LEFT JOIN ctx USING (example_id)),
chat AS (SELECT *, 'Relevant Context:' || chr(10) || array_to_string(['- ' || x for x in oc], chr(10)) || CASE WHEN len(dc) > 0 THEN chr(10) || chr(10) || 'Additional Context (may not be relevant):' || chr(10) || array_to_string(['- ' || x for x in dc], chr(10)) ELSE '' END
  || CASE WHEN n_o > 0 THEN chr(10) || chr(10) || 'Relevant Diagrams: ' || n_o || ' diagram(s) provided. {raft.DIAGRAMS}' ELSE '' END
  || CASE WHEN n_d > 0 THEN chr(10) || chr(10) || 'Additional Diagrams (may not be relevant): ' || n_d || ' diagram(s).' ELSE '' END || chr(10) || chr(10) || question AS content FROM train)"""


def _train(spark, sf_dir):
    key = F.col("example_id")
    body = lambda x: F.when(x["format"] != "SVG", F.base64(F.encode(F.concat(x["format"], x["size_bytes"]), "UTF-8")))
    rows = raft.filter_training(adapters.examples(spark, sf_dir)).withColumns({
        "images": F.transform("images", lambda x: x.withField("base64", body(x))), "generated_test_cases": F.concat(F.lit("Test Case 1: "), "requirement_text"),
        "model_used": F.concat(F.lit("model-"), key % 3), "annotation_notes": F.when(key % 4 > 0, F.concat(F.lit("note "), key)),
    })
    return raft.training_rows(rows)


def _chat(spark, sf_dir):
    return raft.render_chat(_train(spark, sf_dir))


@query("i1_example_columns", f"{E} SELECT example_id, requirement_text, heading, array_to_string(infos, '|') AS infos, array_to_string(interfaces, '|') AS interfaces, array_to_string(oracle, ',') AS oracle, rating, status, len(images) AS n_images FROM examples")
def i1_columns(spark, sf_dir):
    rows = adapters.examples(spark, sf_dir)
    return rows.select("example_id", "requirement_text", "heading", F.array_join("infos", "|").alias("infos"), F.array_join("interfaces", "|").alias("interfaces"), F.array_join("oracle", ",").alias("oracle"), "rating", "status", F.size("images").cast("long").alias("n_images"))


GENERATED = """texts AS (SELECT requirement_id, string_agg('Test Case ' || idx || ': ' || summary || chr(10) || 'Action: ' || action || chr(10) || 'Data: ' || CASE WHEN trim(data) = '' THEN 'N/A' ELSE data END || chr(10) || 'Expected: ' || expected_result || chr(10), chr(10) ORDER BY idx) AS text FROM cases GROUP BY 1)"""
NO_IDS = CARRIED.replace("'ART_' || doc_id AS id", "CASE WHEN doc_id % 3 <> 0 THEN 'ART_' || doc_id END AS id")


@query("i1_build_examples", f"""{NO_IDS}, {adapters.CASES}, {adapters.INTERFACES}, {GENERATED},
placed AS (SELECT *, row_number() OVER (PARTITION BY source_file, segment ORDER BY seq) - 1 AS i FROM carried WHERE type = 'Information'),
listed AS (SELECT source_file, segment, string_agg(coalesce(id, 'INFO_' || i) || ': ' || clean, chr(10) ORDER BY seq) AS infos FROM placed GROUP BY ALL),
scopes AS (SELECT requirement_id, min(scope) AS scope FROM cases GROUP BY 1),
ifs AS (SELECT scope, string_agg(CASE WHEN length(text) % 2 = 1 THEN id ELSE 'IF_' || i END || ': ' || text, chr(10) ORDER BY text) AS interfaces
  FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY text) - 1 AS i FROM interfaces) GROUP BY 1),
pics AS (SELECT *, ['IMG_' || i || ' ' || seq || '_' || i || '.png ' || CASE WHEN i % 2 = 0 THEN 'PNG' ELSE 'UNKNOWN' END for i in range(0, seq % 4) if (i + seq) % 3 <> 0] AS images FROM carried)
SELECT c.seq AS requirement_id, coalesce(c.id, 'UNKNOWN') AS example_id, c.clean AS requirement_text, c.heading, 'HEADING: ' || c.heading AS heading_item, coalesce(l.infos, '') AS infos, ifs.interfaces,
  array_to_string(c.images, ',') AS images, len(c.images) > 0 AS has_images, t.text AS generated, 'model' AS model_used, 0 AS n_annotated, '' AS notes, NULL::INT AS rating, 'pending' AS status
FROM pics c JOIN texts t ON t.requirement_id = c.seq JOIN scopes s ON s.requirement_id = c.seq JOIN ifs ON ifs.scope = s.scope
LEFT JOIN listed l ON l.source_file = c.source_file AND l.segment = c.segment WHERE c.type = 'System Requirement' AND c.clean <> ''""")
def i1(spark, sf_dir):
    cases, names = adapters.cases(spark, sf_dir), adapters.interfaces(spark, sf_dir)
    scopes = cases.groupBy("requirement_id").agg(F.min("scope").alias("scope"))
    by_scope = names.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("text", F.when(F.length("text") % 2 == 1, F.col("id")).alias("id")))).alias("interfaces"))
    artifacts = adapters.artifacts(spark, sf_dir).withColumn("id", F.when(F.col("seq") % 3 != 0, F.col("id")))
    rows = context.augment_requirements(artifacts).drop("interfaces").withColumn("requirement_id", F.col("seq")).join(scopes, "requirement_id").join(by_scope, "scope")
    key = F.col("requirement_id")
    image = lambda i: F.struct(
        F.when((i + key) % 3 != 0, F.concat(F.lit("/images/"), key, F.lit("_"), i, F.lit(".png"))).alias("path"), F.when(i % 2 == 0, "png").alias("format")
    )
    images = F.when(key % 4 > 0, F.transform(F.sequence(F.lit(0), (key % 4 - 1).cast("int")), image)).otherwise(F.array().cast("array<struct<path:string,format:string>>"))
    built = raft.build_examples(rows.withColumn("images", images), cases, "model")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["id"], F.lit(": "), x["text"])), "\n")
    head, note = F.col("retrieved_context.heading"), F.col("context_annotation")
    return built.select(
        "requirement_id", "example_id", "requirement_text", "heading", F.concat(head["id"], F.lit(": "), head["text"]).alias("heading_item"),
        text("retrieved_context.info_artifacts").alias("infos"), text("retrieved_context.interfaces").alias("interfaces"),
        F.array_join(F.transform("images", lambda x: F.concat_ws(" ", x["id"], x["filename"], x["format"])), ",").alias("images"), "has_images", F.col("generated_test_cases").alias("generated"), "model_used",
        (F.size(note["oracle_context"]) + F.size(note["distractor_context"])).alias("n_annotated"), note["annotation_notes"].alias("notes"), note["quality_rating"].alias("rating"), F.col("validation_status").alias("status"),
    )


@query("i2_render_case_text", f"WITH {adapters.CASES}, {GENERATED} SELECT * FROM texts")
def i2(spark, sf_dir):
    return raft.render_case_text(adapters.cases(spark, sf_dir))


@query("i3_collection_stats", f"""{E} SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'validated') AS validated, count(*) FILTER (status = 'rejected') AS rejected,
count(*) FILTER (len(oracle) > 0) AS annotated, count(*) FILTER (len(images) > 0) AS with_images, sum(len(images))::BIGINT AS images, round(sum(len(images)) / count(*), 6) AS images_per_example FROM examples""")
def i3(spark, sf_dir):
    return raft.collection_stats(adapters.examples(spark, sf_dir))


@query("i4_context_items", f"{ITEMS} SELECT example_id, id, kind, text FROM items")
def i4(spark, sf_dir):
    return raft.context_items(adapters.examples(spark, sf_dir))


@query("i5_apply_annotations", f"""{ITEMS}, labelled AS (SELECT e.*, l.doc_id IS NOT NULL AS given, coalesce(l.quality = 0, FALSE) AS skipped, l.quality FROM examples e LEFT JOIN labels l ON l.doc_id = e.example_id),
others AS (SELECT example_id, string_agg(id, ',' ORDER BY g, i) AS distractor FROM items WHERE id <> 'INFO_0' GROUP BY 1)
SELECT l.example_id, CASE WHEN given THEN 'INFO_0' ELSE array_to_string(oracle, ',') END AS oracle, CASE WHEN given THEN coalesce(distractor, '') ELSE '' END AS distractor,
CASE WHEN skipped THEN 'rejected' WHEN given THEN 'validated' ELSE status END AS status, coalesce(quality, rating) AS rating FROM labelled l LEFT JOIN others o USING (example_id)""")
def i5(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("example_id"), F.array(F.lit("INFO_0")).alias("oracle_ids"), (F.col("quality") == 0).alias("skipped"), F.col("quality").alias("new_rating"))
    return raft.apply_annotations(adapters.examples(spark, sf_dir), given).withColumns({"oracle": F.array_join("oracle", ","), "distractor": F.array_join("distractor", ",")})


@query("i6_annotation_queue", f"{E} SELECT example_id FROM examples WHERE len(oracle) = 0 OR coalesce(rating, 0) = 0 ORDER BY length(requirement_text), example_id LIMIT 10")
def i6(spark, sf_dir):
    rows = adapters.examples(spark, sf_dir).withColumn("age", F.length("requirement_text"))
    return raft.annotation_queue(rows, "age", 10).select("example_id")


@query("i7_annotation_progress", f"{E} SELECT status, count(*) AS n, round(count(*) FILTER (len(oracle) > 0) / count(*) * 100, 6) AS annotated_percent FROM examples GROUP BY 1")
def i7(spark, sf_dir):
    return adapters.examples(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.round(F.count_if(F.size("oracle") > 0) / F.count("*") * 100, 6).alias("annotated_percent"))


@query("i8_filter_training", f"{TRAIN} SELECT example_id, rating FROM kept")
def i8(spark, sf_dir):
    return raft.filter_training(adapters.examples(spark, sf_dir)).select("example_id", "rating")


@query("i9_split_context", f"{TRAIN} SELECT example_id, array_to_string(oc, '|') AS oracle_context, array_to_string(dc, '|') AS distractor_context FROM train")
def i9(spark, sf_dir):
    return _train(spark, sf_dir).select("example_id", F.array_join("oracle_context", "|").alias("oracle_context"), F.array_join("distractor_context", "|").alias("distractor_context"))


@query("i10_split_images", f"{TRAIN} SELECT example_id, n_o AS oracle_images, n_d AS distractor_images FROM train")
def i10(spark, sf_dir):
    return _train(spark, sf_dir).select("example_id", F.size("oracle_images").cast("long").alias("oracle_images"), F.size("distractor_images").cast("long").alias("distractor_images"))


NOTES = "CASE WHEN example_id % 4 > 0 THEN 'note ' || example_id ELSE '' END"
META = f"concat_ws('|', example_id::VARCHAR, coalesce(rating::VARCHAR, '-'), {NOTES}, 'model-' || (example_id % 3), (n_o + n_d)::VARCHAR, n_o::VARCHAR)"


def _meta():
    m = F.col("metadata")
    return F.concat_ws("|", m["requirement_id"], F.coalesce(m["quality_rating"].cast("string"), F.lit("-")), m["annotation_notes"], m["original_model"], m["image_count"], m["oracle_image_count"])


@query("i11_training_rows", f"{TRAIN} SELECT example_id, question, len(oc) AS n_oracle, len(dc) AS n_distractor, has_images, rating, answer, {META} AS metadata FROM train")
def i11(spark, sf_dir):
    return _train(spark, sf_dir).select("example_id", "question", F.size("oracle_context").cast("long").alias("n_oracle"), F.size("distractor_context").cast("long").alias("n_distractor"), "has_images", "rating", "answer", _meta().alias("metadata"))


@query("i12_render_chat", f"""{TRAIN} SELECT example_id, '{raft.SYSTEM}' AS system, content, answer AS assistant, {META} AS metadata, CASE WHEN n_o > 0 THEN
array_to_string([to_base64(encode(x.format || x.size_bytes)) for x in images if coalesce(x.relevance, 'oracle') = 'oracle' and x.format <> 'SVG'], ',') ELSE 'none' END AS images FROM chat""")
def i12(spark, sf_dir):
    said = lambda k, part: F.get("messages", F.lit(k))[part]
    pictures = F.coalesce(F.array_join(said(1, "images"), ","), F.lit("none"))
    return _chat(spark, sf_dir).select("example_id", said(0, "content").alias("system"), said(1, "content").alias("content"), said(2, "content").alias("assistant"), _meta().alias("metadata"), pictures.alias("images"))


@query("i13_dataset_stats", f"""{TRAIN} SELECT count(*) AS total, count(*) FILTER (n_o + n_d > 0) AS vision, count(*) FILTER (n_o + n_d = 0) AS text_only, round(count(*) FILTER (n_o + n_d > 0) / count(*) * 100, 6) AS vision_share,
sum(n_o + n_d)::BIGINT AS images, round(sum(n_o + n_d) / count(*), 6) AS images_per_example, count(*) FILTER (n_o + n_d > 0) / count(*) * 100 BETWEEN 50 AND 70 AS balanced FROM train""")
def i13(spark, sf_dir):
    return raft.dataset_stats(_chat(spark, sf_dir))


COUNT = "(length({0}) - length(replace({0}, '- ', ''))) / 2"


@query("i14_validate_chat", f"""{TRAIN}, m AS (SELECT content, CASE WHEN contains(content, 'Additional Context') THEN string_split(content, 'Additional Context')[-1] END AS after FROM chat)
SELECT count(*) AS total, count(*) AS with_oracle, count(after) AS with_distractor, round(avg({COUNT.format("content")}), 6) AS avg_oracle_docs, round(coalesce(avg({COUNT.format("after")}), 0), 6) AS avg_distractor_docs, 0::BIGINT AS issues FROM m""")
def i14(spark, sf_dir):
    return raft.validate_chat(_chat(spark, sf_dir))


@query("i15_analyze_chat", f"""{TRAIN} SELECT n_o + n_d > 0 AS vision, count(*) AS n, round(avg(n_o + n_d), 6) AS avg_images, round(avg((length(content) - length(replace(content, 'Relevant Context:', ''))) / 17), 6) AS avg_markers FROM chat GROUP BY 1""")
def i15(spark, sf_dir):
    user = F.get("messages", F.lit(1))["content"]
    markers = (F.length(user) - F.length(F.replace(user, F.lit("Relevant Context:"), F.lit("")))) / 17
    return _chat(spark, sf_dir).groupBy((F.col("metadata.image_count") > 0).alias("vision")).agg(F.count("*").alias("n"), F.round(F.avg("metadata.image_count"), 6).alias("avg_images"), F.round(F.avg(markers), 6).alias("avg_markers"))


def _hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w.lower()}')::INT" for w in words) + ")"


WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
DOMAIN = " OR ".join(f"({_hits('r', w)} / {len(w)} > 0.1 AND {_hits('c', w)} / {len(w)} > 0.1)" for w in quality.DOMAINS.values())
TECHNICAL = " + ".join(f"regexp_matches(trim(requirement_text), '{p}')::INT" for p in quality.TECHNICAL)
LISTED = ", ".join(f"'{t}'" for t in quality.IMAGE_TYPES)
SCORED = f"""{E}, texts AS (SELECT *, concat_ws(' ', heading, nullif(array_to_string(infos, ' '), ''), nullif(array_to_string(interfaces, ' '), '')) AS context FROM examples),
w AS (SELECT *, lower(requirement_text) AS r, lower(context) AS c, {WORDS.format("requirement_text")} AS rw, {WORDS.format("context")} AS cw FROM texts),
parts AS (SELECT *, CASE WHEN requirement_text = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN len(rw) > 0 THEN len(list_intersect(rw, cw)) / len(rw) ELSE 0 END + CASE WHEN {DOMAIN} THEN 0.06::DOUBLE ELSE 0 END) END AS relevance,
((heading <> '')::INT + (len(infos) > 0)::INT + (len(interfaces) > 0)::INT) / 3 AS kinds, least(1.0::DOUBLE, (length(heading) + length(array_to_string(infos, '')) + length(array_to_string(interfaces, ''))) / 1000) AS quantity,
CASE WHEN requirement_text = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, length(trim(requirement_text)) / 200) * 0.4::DOUBLE + least(1.0::DOUBLE, {_hits("lower(trim(requirement_text))", quality.CLAUSES)} / 3) * 0.4::DOUBLE + ({TECHNICAL}) / 6 * 0.2::DOUBLE END AS complexity,
len(images) AS n, list_sum([x.size_bytes for x in images]) / len(images) AS mean FROM w),
imgs AS (SELECT *, CASE WHEN len(infos) > 1 THEN least(1.0::DOUBLE, kinds + 0.1::DOUBLE) ELSE kinds END AS diversity,
CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN mean BETWEEN 50000 AND 500000 THEN 0.3::DOUBLE WHEN mean > 500000 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END
 + least(0.2::DOUBLE, list_sum([CASE x.format WHEN 'SVG' THEN 0.15::DOUBLE WHEN 'PNG' THEN 0.10::DOUBLE ELSE 0 END for x in images]) / n) + CASE WHEN n >= 3 THEN 0.2::DOUBLE WHEN n = 2 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END
 + len([x for x in images if x.image_type <> '' OR x.description <> '']) / n * 0.1::DOUBLE) END AS image_quality,
CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN {_hits("r", quality.VISUAL)} > 0 THEN 0.3::DOUBLE ELSE 0 END + len([x for x in images if x.image_type IN ({LISTED})]) / n * 0.4::DOUBLE
 + list_sum([CASE WHEN x.description <> '' AND len(rw) > 0 THEN least(0.3::DOUBLE, len(list_intersect(rw, {WORDS.format("x.description")})) / len(rw)) ELSE 0.0::DOUBLE END for x in images]) / n
 + len([x for x in images if x.relevance = 'oracle']) / n * 0.2::DOUBLE) END AS image_relevance FROM parts),
overalls AS (SELECT *, CASE WHEN n > 0 THEN relevance * 0.3::DOUBLE + diversity * 0.15::DOUBLE + quantity * 0.15::DOUBLE + complexity * 0.15::DOUBLE + image_quality * 0.15::DOUBLE + image_relevance * 0.1::DOUBLE
 ELSE (relevance * 0.3::DOUBLE + diversity * 0.15::DOUBLE + quantity * 0.15::DOUBLE + complexity * 0.15::DOUBLE) / 0.75::DOUBLE END AS overall FROM imgs),
scored AS (SELECT *, CASE WHEN overall >= 0.7 THEN 'high' WHEN overall >= 0.4 THEN 'medium' ELSE 'low' END AS priority,
 CASE WHEN complexity <= 0.4 AND diversity >= 0.3 THEN 'foundation' WHEN complexity <= 0.7 AND diversity >= 0.5 THEN 'intermediate' ELSE 'advanced' END AS phase,
 list_filter([CASE WHEN relevance < 0.3 THEN 'Low relevance: Consider adding more domain-specific context' END,
 CASE WHEN diversity < 0.5 THEN 'Low diversity: Include different types of context (heading, info, interfaces)' END,
 CASE WHEN quantity < 0.3 THEN 'Insufficient context: Add more detailed context information' END,
 CASE WHEN complexity < 0.3 THEN 'Simple requirement: Consider if this adds value to training set' END,
 CASE WHEN heading = '' THEN 'Missing heading: Consider adding section header context' END,
 CASE WHEN len(infos) < 2 THEN 'Limited info artifacts (' || len(infos) || '): Add more background information' END,
 CASE WHEN len(interfaces) = 0 THEN 'No interface context: Consider adding system interface definitions' END,
 CASE WHEN n > 0 AND image_quality < 0.4 THEN 'Low image quality: Use higher resolution or vector format diagrams' END,
 CASE WHEN n > 0 AND image_relevance < 0.3 THEN 'Images may not be relevant: Verify diagrams match requirement context' END,
 CASE WHEN len([x for x in images if x.image_type = '' AND x.description = '']) > 0 THEN len([x for x in images if x.image_type = '' AND x.description = '']) || ' image(s) need annotation: Add image_type and description' END],
 lambda t: t IS NOT NULL) AS told FROM overalls)"""


def _scored(spark, sf_dir):
    return quality.score_examples(adapters.examples(spark, sf_dir))


def _score_query(name: str, *columns: str):
    @query(name, f"{SCORED} SELECT example_id, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM scored")
    def run(spark, sf_dir):
        return _scored(spark, sf_dir).select("example_id", *(F.round(c, 6).alias(c) for c in columns))


_score_query("i16_score_relevance", "relevance")
_score_query("i17_score_context", "diversity", "quantity")
_score_query("i18_score_complexity", "complexity")
_score_query("i19_score_images", "image_quality", "image_relevance")


@query("i20_overall_priority", f"{SCORED} SELECT example_id, round(overall, 6) AS overall, priority FROM scored")
def i20(spark, sf_dir):
    return _scored(spark, sf_dir).select("example_id", F.round("overall", 6).alias("overall"), "priority")


@query("i21_recommendations", f"{SCORED} SELECT example_id, array_to_string(told, '; ') AS told FROM scored")
def i21(spark, sf_dir):
    return _scored(spark, sf_dir).select("example_id", F.array_join(quality.recommendations(), "; ").alias("told"))


@query("i22_improvements", f"""{SCORED} SELECT example_id, concat_ws('; ', CASE WHEN relevance < 0.2 THEN 'Regenerate context with better retrieval algorithm' END, CASE WHEN quantity < 0.2 THEN 'Add more context information to retrieved documents' END) AS required,
concat_ws('; ', CASE WHEN diversity < 0.3 THEN 'Incorporate different types of context documents' END, CASE WHEN complexity < 0.2 THEN 'Select more complex requirements for training' END) AS optional, relevance < 0.2 AS regenerate FROM scored""")
def i22(spark, sf_dir):
    return quality.improvements(_scored(spark, sf_dir)).withColumns({"required": F.array_join("required", "; "), "optional": F.array_join("optional", "; ")})


@query("i23_quality_summary", f"""{SCORED}, t AS (SELECT text, count(*) AS n FROM (SELECT unnest(told) AS text FROM scored) GROUP BY 1 ORDER BY n DESC, text LIMIT 5)
SELECT count(*) AS n, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, count(*) FILTER (priority = 'low') AS low, round(avg(overall), 6) AS mean_overall,
round((list(overall ORDER BY overall))[count(*) // 2 + 1], 6) AS median_overall, round(avg(relevance), 6) AS mean_relevance, (SELECT string_agg(text || ' x' || n, '; ' ORDER BY n DESC, text) FROM t) AS top FROM scored""")
def i23(spark, sf_dir):
    return quality.quality_summary(_scored(spark, sf_dir))


@query("i24_curriculum_phase", f"{SCORED} SELECT example_id, phase, round(overall, 6) AS overall, row_number() OVER (PARTITION BY phase ORDER BY round(overall, 9) DESC, example_id)::INT AS place FROM scored")
def i24(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("overall", F.round("overall", 9))
    return quality.curriculum_phases(rows).withColumn("overall", F.round("overall", 6))


@query("i25_phase_gate", f"""{SCORED}, s AS (SELECT phase, count(*) AS n, avg(overall) AS mean FROM scored GROUP BY 1), p(phase, k, need, least_, factor) AS (VALUES ('foundation', 0, 50, 0.6, 0.8), ('intermediate', 1, 100, 0.7, 0.7), ('advanced', 2, 150, 0.8, 0.6)),
j AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean FROM p LEFT JOIN s USING (phase)), t AS (SELECT *, least(1.0::DOUBLE, mean * factor::DOUBLE + 0.05::DOUBLE * k) AS score FROM j),
g AS (SELECT *, coalesce(bool_and(n >= need AND score >= least_) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS before FROM t)
SELECT phase, n, CASE WHEN before THEN round(score, 6) END AS score, n >= need AS enough, before AND n >= need AND score >= least_ AS passed FROM g""")
def i25(spark, sf_dir):
    return quality.phase_gate(_scored(spark, sf_dir))


@query("i26_curriculum_status", f"""{SCORED} SELECT p.phase, count(example_id) AS n, greatest(0, need - count(example_id))::BIGINT AS shortfall FROM (VALUES ('foundation', 50), ('intermediate', 100), ('advanced', 150)) p(phase, need) LEFT JOIN scored s USING (phase) GROUP BY p.phase, need""")
def i26(spark, sf_dir):
    return quality.curriculum_status(_scored(spark, sf_dir))
