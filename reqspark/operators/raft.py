"""Retrieval-augmented fine-tuning data: context items, annotation, filtering, chat rows, statistics.

Examples have example_id, requirement_text, heading, infos, interfaces (arrays of texts), oracle (ids of context items), rating,
status, images. All jobs on one example are column expressions: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts of chat rows.
SYSTEM = (
    "You are an expert automotive test case generator with vision capabilities. "
    "Analyze both text context and diagrams to generate comprehensive test cases. "
    "Use only the relevant context and ignore irrelevant information."
)
DIAGRAMS = "Analyze visual information to understand system behavior, state transitions, signal flows, and test scenarios."


def render_case_text(cases: DataFrame) -> DataFrame:
    """requirement_id, text of the cases of each requirement in their order."""
    data = F.when(F.trim("data") == "", "N/A").otherwise(F.col("data"))
    text = F.concat(F.lit("Test Case "), "idx", F.lit(": "), "summary", F.lit("\nAction: "), "action", F.lit("\nData: "), data, F.lit("\nExpected: "), "expected_result", F.lit("\n"))
    rows = cases.select("requirement_id", "idx", text.alias("text")).groupBy("requirement_id").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("all"))
    return rows.select("requirement_id", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("text"))


def build_examples(requirements: DataFrame, cases: DataFrame, model: str) -> DataFrame:
    """An example to be annotated for each requirement with cases. Requirements have requirement_id, id, text, heading, info and
    interfaces (arrays of id and text) and images (array of path and format). Context without an id is named by its place;
    images without a path are left out, but keep their number."""
    no_text = F.lit("")
    listed = lambda name, prefix: F.transform(
        name, lambda x, i: F.struct(F.coalesce(x["id"], F.concat(F.lit(prefix), i)).alias("id"), F.coalesce(x["text"], no_text).alias("text"))
    )
    heading = F.coalesce("heading", F.lit("No Heading"))
    retrieved = F.struct(F.struct(F.lit("HEADING").alias("id"), heading.alias("text")).alias("heading"), listed("info", "INFO_").alias("info_artifacts"), listed("interfaces", "IF_").alias("interfaces"))
    named = F.transform("images", lambda x, i: F.struct(
        F.concat(F.lit("IMG_"), i).alias("id"), x["path"].alias("path"), F.substring_index(x["path"], "/", -1).alias("filename"), F.upper(F.coalesce(x["format"], F.lit("unknown"))).alias("format")
    ))
    images = F.filter(named, lambda x: x["path"] != "")
    nothing = F.array().cast("array<string>")
    annotation = F.struct(nothing.alias("oracle_context"), nothing.alias("distractor_context"), no_text.alias("annotation_notes"), F.lit(None).cast("int").alias("quality_rating"))
    rows = requirements.join(render_case_text(cases).withColumnRenamed("text", "generated_test_cases"), "requirement_id")
    return rows.select(
        "requirement_id", F.coalesce("id", F.lit("UNKNOWN")).alias("example_id"), F.coalesce("text", no_text).alias("requirement_text"), heading.alias("heading"),
        retrieved.alias("retrieved_context"), images.alias("images"), (F.size(images) > 0).alias("has_images"), "generated_test_cases",
        F.lit(model).alias("model_used"), annotation.alias("context_annotation"), F.lit("pending").alias("validation_status"),
    )


def items() -> Column:
    """array<struct<id, kind, text>>: the heading if it has text, information, interfaces."""
    item = lambda id_, kind, text: F.struct(id_.alias("id"), F.lit(kind).alias("kind"), text.alias("text"))
    kind = "array<struct<id:string,kind:string,text:string>>"
    head = F.when(F.col("heading") != "", F.array(item(F.lit("HEADING"), "Heading", F.col("heading")))).otherwise(F.array().cast(kind))
    listed = lambda name, prefix, label: F.transform(name, lambda x, i: item(F.concat(F.lit(prefix), i), label, x))
    return F.concat(head, listed("infos", "INFO_", "Information"), listed("interfaces", "IF_", "Interface"))


def context_items(examples: DataFrame) -> DataFrame:
    return examples.select("example_id", F.inline(items()))


def apply_annotations(examples: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations (example_id, oracle_ids, skipped, new_rating): the items that are not oracle are distractors."""
    rows = examples.join(annotations, "example_id", "left")
    every = F.transform(items(), lambda x: x["id"])
    given = F.col("oracle_ids").isNotNull()
    return rows.select(
        "example_id",
        F.when(given, F.col("oracle_ids")).otherwise(F.col("oracle")).alias("oracle"),
        F.when(given, F.array_except(every, "oracle_ids")).otherwise(F.array().cast("array<string>")).alias("distractor"),
        F.when(F.col("skipped"), "rejected").when(given, "validated").otherwise(F.col("status")).alias("status"),
        F.coalesce("new_rating", "rating").alias("rating"),
    )


def annotation_queue(examples: DataFrame, order: str, batch_size: int) -> DataFrame:
    """The oldest examples without oracle items or rating."""
    open_ = (F.size("oracle") == 0) | (F.coalesce("rating", F.lit(0)) == 0)
    return examples.where(open_).orderBy(order, "example_id").limit(batch_size)


def collection_stats(examples: DataFrame) -> DataFrame:
    n, images = F.count("*"), F.coalesce(F.sum(F.size("images")), F.lit(0))
    by = lambda s: F.count_if(F.col("status") == s)
    return examples.agg(
        n.alias("total"), by("pending").alias("pending"), by("validated").alias("validated"), by("rejected").alias("rejected"),
        F.count_if(F.size("oracle") > 0).alias("annotated"), F.count_if(F.size("images") > 0).alias("with_images"), images.alias("images"),
        F.round(F.when(n > 0, images / n).otherwise(0.0), 6).alias("images_per_example"),
    )


def filter_training(examples: DataFrame, min_rating: int = 3) -> DataFrame:
    """Examples with oracle items, without those rated below min_rating; no rating, or 0, passes."""
    return examples.where((F.size("oracle") > 0) & ~((F.coalesce("rating", F.lit(0)) != 0) & (F.coalesce("rating", F.lit(0)) < min_rating)))


def _doc(x: Column) -> Column:
    name = F.when(x["kind"] == "Interface", F.concat(F.lit("Interface "), x["id"])).otherwise(x["kind"])
    return F.concat(name, F.lit(": "), x["text"])


def training_rows(examples: DataFrame, distractors: Column | None = None) -> DataFrame:
    """example_id, question, oracle_context, distractor_context, oracle_images, distractor_images, has_images, answer, metadata; without
    given distractor ids all items that are not oracle are. The answer is generated_test_cases; it, annotation_notes and model_used
    are empty where examples lack the column."""
    given = lambda c, otherwise=None: F.col(c) if c in examples.columns else F.lit(otherwise).cast("string")
    is_oracle = lambda x: F.array_contains("oracle", x["id"])
    is_other = (lambda x: ~is_oracle(x)) if distractors is None else (lambda x: ~is_oracle(x) & F.array_contains(distractors, x["id"]))
    of = lambda keep: F.transform(F.filter(items(), keep), _doc)
    relevance = lambda x: F.coalesce(x["relevance"], F.lit("oracle"))
    oracle_images = F.filter("images", lambda x: relevance(x) == "oracle")
    distractor_images = F.filter("images", lambda x: relevance(x) == "distractor")
    metadata = F.struct(
        F.col("example_id").alias("requirement_id"), F.col("rating").alias("quality_rating"), F.coalesce(given("annotation_notes"), F.lit("")).alias("annotation_notes"),
        given("model_used").alias("original_model"), (F.size(oracle_images) + F.size(distractor_images)).alias("image_count"), F.size(oracle_images).alias("oracle_image_count"),
    )
    question = F.concat(F.lit("Generate comprehensive test cases for requirement "), F.col("example_id").cast("string"), F.lit(": "), F.col("requirement_text"))
    return examples.select(
        "example_id", question.alias("question"), of(is_oracle).alias("oracle_context"), of(is_other).alias("distractor_context"),
        oracle_images.alias("oracle_images"), distractor_images.alias("distractor_images"), (F.size("images") > 0).alias("has_images"), "rating",
        F.coalesce(given("generated_test_cases"), F.lit("")).alias("answer"), metadata.alias("metadata"),
    )


def user_message() -> Column:
    lines = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    n, m = F.size("oracle_images"), F.size("distractor_images")
    return F.concat(
        F.lit("Relevant Context:\n"),
        lines("oracle_context"),
        F.when(F.size("distractor_context") > 0, F.concat(F.lit("\n\nAdditional Context (may not be relevant):\n"), lines("distractor_context"))).otherwise(""),
        F.when(n > 0, F.concat(F.lit("\n\nRelevant Diagrams: "), n, F.lit(" diagram(s) provided. " + DIAGRAMS))).otherwise(""),
        F.when(m > 0, F.concat(F.lit("\n\nAdditional Diagrams (may not be relevant): "), m, F.lit(" diagram(s)."))).otherwise(""),
        F.lit("\n\n"),
        F.col("question"),
    )


def render_chat(rows: DataFrame) -> DataFrame:
    """example_id, messages (system, user, assistant), metadata of training rows. The user's message has the images: the base64 of
    relevant ones that have it."""
    kind = "array<string>"
    has_bytes = "base64" in rows.schema["oracle_images"].dataType.elementType.names
    pictures = F.array_compact(F.transform("oracle_images", lambda x: x["base64"])) if has_bytes else F.array().cast(kind)
    pictures = F.when(F.size("oracle_images") > 0, pictures)
    message = lambda role, text, images=F.lit(None).cast(kind): F.struct(F.lit(role).alias("role"), text.alias("content"), images.alias("images"))
    messages = F.array(message("system", F.lit(SYSTEM)), message("user", user_message(), pictures), message("assistant", F.col("answer")))
    return rows.select("example_id", messages.alias("messages"), "metadata")


def dataset_stats(chat: DataFrame) -> DataFrame:
    total, vision = F.count("*"), F.count_if(F.col("metadata.image_count") > 0)
    images = F.coalesce(F.sum("metadata.image_count"), F.lit(0))
    share = F.when(total > 0, vision / total * 100).otherwise(0.0)
    return chat.agg(
        total.alias("total"), vision.alias("vision"), (total - vision).alias("text_only"), F.round(share, 6).alias("vision_share"), images.alias("images"),
        F.round(F.when(total > 0, images / total).otherwise(0.0), 6).alias("images_per_example"), share.between(50, 70).alias("balanced"),
    )


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def validate_chat(chat: DataFrame) -> DataFrame:
    """One row of statistics, issues (examples whose messages aren't three) included."""
    user = F.get("messages", F.lit(1))["content"]
    oracle, other = F.contains(user, F.lit("Relevant Context:")), F.contains(user, F.lit("Additional Context"))
    after = F.substring_index(user, "Additional Context", -1)
    return chat.agg(
        F.count("*").alias("total"), F.count_if(oracle).alias("with_oracle"), F.count_if(other).alias("with_distractor"),
        F.round(F.coalesce(F.avg(F.when(oracle, _count(user, "- "))), F.lit(0.0)), 6).alias("avg_oracle_docs"),
        F.round(F.coalesce(F.avg(F.when(other, _count(after, "- "))), F.lit(0.0)), 6).alias("avg_distractor_docs"),
        F.count_if(F.coalesce(F.size("messages"), F.lit(0)) != 3).alias("issues"),
    )


def chat_issues(lines: DataFrame) -> DataFrame:
    """file, number, issue: what is wrong with which row of chat files, rows counted from 0 within a file. lines are those of
    spark.read.text over the files.

    No task sees a whole file: rows are numbered within the pieces in which files are read, and one row a piece tells how many rows
    precede it. Only rows with an issue are joined."""
    piece = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = lines.select(*piece, F.monotonically_increasing_id().alias("at"), "value")
    pieces = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    messages = F.try_variant_get(F.try_parse_json("value"), "$.messages", "array<variant>")
    n = F.size(messages)
    issue = (
        F.when(F.try_parse_json("value").isNull(), "not JSON").when(F.try_variant_get(F.try_parse_json("value"), "$.messages", "variant").isNull(), "Missing 'messages' field")
        .when(messages.isNull(), "'messages' is no list").when(n != 3, F.concat(F.lit("Expected 3 messages, got "), n))
    )
    found = rows.select("file", "start", "at", issue.alias("issue")).where("issue IS NOT NULL").join(pieces, ["file", "start"])
    number = F.col("before") + F.col("at") - F.col("first")
    return found.select("file", number.alias("number"), F.concat(F.lit("Example "), number, F.lit(": "), "issue").alias("issue"))
