"""Quality of fine-tuning examples: scores, recommendations, summary, curriculum. Column expressions but for the summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written

WORD = r"[\p{L}\p{N}_]+"
#: Words of a domain.
DOMAINS = {
    "automotive": ["vehicle", "car", "engine", "transmission", "brake", "steering", "ABS", "ESP", "ECU", "CAN", "LIN", "FlexRay", "ADAS", "safety", "emission", "fuel", "battery", "electric", "hybrid", "autonomous"],
    "aerospace": ["aircraft", "avionics", "flight", "altitude", "pressure", "temperature", "navigation", "radar", "GPS", "inertial", "hydraulics", "pneumatics"],
    "medical": ["patient", "therapy", "diagnosis", "monitoring", "alarm", "sensor", "dosage", "infusion", "ventilation", "anesthesia", "radiation"],
}
#: Words and signs of complex requirements, words and kinds of images, weights of scores, and the phases.
CLAUSES = ["shall", "must", "should", "will", "may", "can", "if", "when", "then"]
TECHNICAL = [r"\b\d+\.\d+\b", r"[A-Z]{3,}", r"[<>]=", "±", "°", "%"]
VISUAL = ["diagram", "state", "flow", "chart", "graph", "timing", "sequence", "transition", "ui", "interface", "display", "screen", "button", "menu", "visual", "shown", "depicted"]
IMAGE_TYPES = ["state_machine", "timing_diagram", "flow_chart", "sequence_diagram", "block_diagram", "signal_flow", "ui_mockup", "parameter_table"]
WEIGHTS = {"relevance": 0.30, "diversity": 0.15, "quantity": 0.15, "complexity": 0.15, "image_quality": 0.15, "image_relevance": 0.10}
PHASES = [("foundation", 50, 0.6, 0.8), ("intermediate", 100, 0.7, 0.7), ("advanced", 150, 0.8, 0.6)]  # examples, threshold, factor


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _hits(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w.lower())).cast("int") for w in words), F.lit(0))


def _context() -> Column:
    return F.concat_ws(" ", F.array(F.col("heading")), "infos", "interfaces")


def relevance() -> Column:
    text, context = F.lower("requirement_text"), F.lower(_context())
    words = _words(F.col("requirement_text"))
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, _words(_context()))) / F.size(words)).otherwise(0.0)
    domain = F.lit(False)
    for names in DOMAINS.values():
        domain = domain | ((_hits(text, names) / len(names) > 0.1) & (_hits(context, names) / len(names) > 0.1))
    score = F.least(F.lit(1.0), share + F.when(domain, 0.06).otherwise(0.0))
    return F.when(F.col("requirement_text") == "", 0.0).otherwise(score)


def diversity() -> Column:
    kinds = ((F.col("heading") != "").cast("int") + (F.size("infos") > 0).cast("int") + (F.size("interfaces") > 0).cast("int")) / 3
    return F.when(F.size("infos") > 1, F.least(F.lit(1.0), kinds + 0.1)).otherwise(kinds)


def quantity() -> Column:
    length = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + F.length(x))
    return F.least(F.lit(1.0), (F.length("heading") + length("infos") + length("interfaces")) / 1000)


def complexity() -> Column:
    text = F.trim("requirement_text")
    technical = sum((text.rlike(p).cast("int") for p in TECHNICAL), F.lit(0)) / len(TECHNICAL)
    score = F.least(F.lit(1.0), F.length(text) / 200) * 0.4 + F.least(F.lit(1.0), _hits(F.lower(text), CLAUSES) / 3) * 0.4 + technical * 0.2
    return F.when(F.col("requirement_text") == "", 0.0).otherwise(score)


def image_quality() -> Column:
    n = F.size("images")
    mean = F.aggregate("images", F.lit(0).cast("long"), lambda s, x: s + x["size_bytes"]) / n
    size = F.when(mean.between(50_000, 500_000), 0.3).when(mean > 500_000, 0.2).otherwise(0.1)
    kinds = F.aggregate("images", F.lit(0.0), lambda s, x: s + F.when(x["format"] == "SVG", 0.15).when(x["format"].isin("PNG", "TIFF"), 0.10).otherwise(0.0))
    bonus = F.when(n >= 3, 0.2).when(n == 2, 0.15).otherwise(0.05)
    told = F.size(F.filter("images", lambda x: (x["image_type"] != "") | (x["description"] != ""))) / n
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.3 + size + F.least(F.lit(0.2), kinds / n) + bonus + told * 0.1))


def image_relevance() -> Column:
    n, words = F.size("images"), _words(F.col("requirement_text"))
    visual = F.when(_hits(F.lower("requirement_text"), VISUAL) > 0, 0.3).otherwise(0.0)
    types = F.size(F.filter("images", lambda x: x["image_type"].isin(IMAGE_TYPES))) / n * 0.4
    overlap = lambda x: F.when((x["description"] != "") & (F.size(words) > 0), F.least(F.lit(0.3), F.size(F.array_intersect(words, _words(x["description"]))) / F.size(words))).otherwise(0.0)
    told = F.aggregate("images", F.lit(0.0), lambda s, x: s + overlap(x)) / n
    oracle = F.size(F.filter("images", lambda x: x["relevance"] == "oracle")) / n * 0.2
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), visual + types + told + oracle))


def score_examples(examples: DataFrame) -> DataFrame:
    """Examples with the six scores, overall and priority."""
    rows = examples.withColumns({"relevance": relevance(), "diversity": diversity(), "quantity": quantity(), "complexity": complexity(), "image_quality": image_quality(), "image_relevance": image_relevance()})
    every = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    plain = sum((F.col(k) * w for k, w in WEIGHTS.items() if not k.startswith("image")), F.lit(0.0)) / 0.75
    rows = rows.withColumn("overall", F.when(F.size("images") > 0, every).otherwise(plain))
    return rows.withColumn("priority", F.when(F.col("overall") >= 0.7, "high").when(F.col("overall") >= 0.4, "medium").otherwise("low"))


def recommendations() -> Column:
    told = F.size(F.filter("images", lambda x: (x["image_type"] == "") & (x["description"] == "")))
    some = F.size("images") > 0
    return F.array_compact(
        F.array(
            F.when(F.col("relevance") < 0.3, "Low relevance: Consider adding more domain-specific context"),
            F.when(F.col("diversity") < 0.5, "Low diversity: Include different types of context (heading, info, interfaces)"),
            F.when(F.col("quantity") < 0.3, "Insufficient context: Add more detailed context information"),
            F.when(F.col("complexity") < 0.3, "Simple requirement: Consider if this adds value to training set"),
            F.when(F.col("heading") == "", "Missing heading: Consider adding section header context"),
            F.when(F.size("infos") < 2, F.concat(F.lit("Limited info artifacts ("), F.size("infos"), F.lit("): Add more background information"))),
            F.when(F.size("interfaces") == 0, "No interface context: Consider adding system interface definitions"),
            F.when(some & (F.col("image_quality") < 0.4), "Low image quality: Use higher resolution or vector format diagrams"),
            F.when(some & (F.col("image_relevance") < 0.3), "Images may not be relevant: Verify diagrams match requirement context"),
            F.when(some & (told > 0), F.concat(told, F.lit(" image(s) need annotation: Add image_type and description"))),
        )
    )


def improvements(scored: DataFrame) -> DataFrame:
    """example_id, required, optional (arrays), regenerate."""
    required = F.array_compact(F.array(F.when(F.col("relevance") < 0.2, "Regenerate context with better retrieval algorithm"), F.when(F.col("quantity") < 0.2, "Add more context information to retrieved documents")))
    optional = F.array_compact(F.array(F.when(F.col("diversity") < 0.3, "Incorporate different types of context documents"), F.when(F.col("complexity") < 0.2, "Select more complex requirements for training")))
    return scored.select("example_id", required.alias("required"), optional.alias("optional"), (F.col("relevance") < 0.2).alias("regenerate"))


def upper_median(scored: DataFrame, column: str = "overall", bins: int = 1000) -> float | None:
    """Of n values in ascending order the one at place n // 2. A histogram of at most bins rows tells the bin that holds it, which is
    split again until it holds one value: no task orders values, however many of them lie close together."""
    values = written(scored.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    place = n // 2
    while n and low < high:
        part = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1))
        rows = values.where(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(rows.collect()):
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def quality_summary(scored: DataFrame, top: int = 5) -> DataFrame:
    """One row: count, priorities, mean and upper median of overall, mean relevance, the most frequent recommendations."""
    told = scored.select(F.explode(recommendations()).alias("text")).groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(top)
    told = told.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "text"))), lambda x: F.concat(x["text"], F.lit(" x"), -x["n"])), "; ").alias("top"))
    by = lambda p: F.count_if(F.col("priority") == p).alias(p)
    median = F.lit(upper_median(scored)).cast("double")
    sums = scored.agg(
        F.count("*").alias("n"), by("high"), by("medium"), by("low"), F.round(F.avg("overall"), 6).alias("mean_overall"),
        F.round(median, 6).alias("median_overall"), F.round(F.avg("relevance"), 6).alias("mean_relevance"),
    )
    return sums.withColumn("key", F.lit(1)).join(told.withColumn("key", F.lit(1)), "key").drop("key")


def curriculum_phases(scored: DataFrame) -> DataFrame:
    """example_id, phase, overall, place: ranked within the phase. Rows are sorted over all partitions, so a phase may hold most of
    them; a place is the rows of the phase in earlier partitions plus that within the own one."""
    phase = F.when((F.col("complexity") <= 0.4) & (F.col("diversity") >= 0.3), "foundation").when((F.col("complexity") <= 0.7) & (F.col("diversity") >= 0.5), "intermediate").otherwise("advanced")
    order = ["phase", F.desc("overall"), "example_id"]
    rows = scored.select("example_id", "overall", phase.alias("phase")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("phase", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("phase").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("phase", "part").orderBy(F.desc("overall"), "example_id")))
    ranked = ranked.join(counts.select("phase", "part", before.alias("before")), ["phase", "part"])
    return ranked.select("example_id", "overall", "phase", (F.col("before") + F.col("place")).alias("place"))


def phase_gate(scored: DataFrame) -> DataFrame:
    """phase, n, score, enough, passed: phases pass in order, each lifting the next, until one fails."""
    sums = curriculum_phases(scored).groupBy("phase").agg(F.count("*").alias("n"), F.avg("overall").alias("mean"))
    kept = {r["phase"]: (r["n"], r["mean"]) for r in sums.collect()}  # three rows at most
    out, passed, going = [], 0, True
    for phase, least, threshold, factor in PHASES:
        n, mean = kept.get(phase, (0, 0.0))
        score = min(1.0, mean * factor + 0.05 * passed) if going else None
        going = going and n >= least and score >= threshold
        out.append((phase, n, None if score is None else round(score, 6), n >= least, going))
        passed += going
    return scored.sparkSession.createDataFrame(out, "phase string, n long, score double, enough boolean, passed boolean")


def curriculum_status(scored: DataFrame) -> DataFrame:
    """phase, n, shortfall: all phases, also those without examples."""
    sums = curriculum_phases(scored).agg(*(F.count_if(F.col("phase") == p).alias(p) for p, *_ in PHASES))
    rows = F.array(*(F.struct(F.lit(p).alias("phase"), F.col(p).alias("n"), F.greatest(F.lit(0).cast("long"), m - F.col(p)).alias("shortfall")) for p, m, *_ in PHASES))
    return sums.select(F.inline(rows))
