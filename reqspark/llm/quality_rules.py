"""Quality rules: counting rules, then distribution divergence against language references.

Method: for each document two histograms are held against the reference of its language by Jensen-Shannon distance
(base 2, so 0 to 1): the classes of its characters, and its common words. The reference of a language is the sum of
the histograms of all its documents; the common words are fixed lists. Guards: the character test needs
``min_chars`` characters in words, the word test ``min_words`` words; a shorter document passes that test. A
document goes if either distance or their sum is too large.

DataFrame functions only. Two scans, no text is shuffled; the references are a written table of one row a language, which Spark broadcasts if it
is small and else joins by language.

Defined cases: a null text has no words; a null language has no reference, so only the counting rules hold; a language
without a list of common words has no word test;
repeated doc_ids are judged row by row; an empty text has no words and fails for too few; a very long text is counted whole; an empty
table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, whole_text, words_of

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8

#: The most common function words of a language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "was", "with", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "est", "que", "dans"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
#: Character classes, each removed before the next is counted; what remains is the last class.
CLASSES = [r"\p{Ll}+", r"\p{Lu}+", r"[\p{L}\p{M}]+", r"\p{Nd}+", r"[.,;:!?'\"()-]+"]


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more. Hashes find out whether there is any; only then are
    windows compared as text, sorted so that equal ones are neighbours."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - WINDOW)
    text = lambda i: F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ")
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW))))
    ordered = F.array_sort(F.transform(starts, lambda i: F.struct(text(i).alias("text"), i.alias("at"))))
    same = lambda a, k, x: F.coalesce(F.get(a, k)["text"] == x["text"], F.lit(False))
    twice = let(ordered, lambda a: F.filter(a, lambda x, k: same(a, k - 1, x) | same(a, k + 1, x)))
    covered = F.aggregate(
        F.array_sort(F.transform(twice, lambda x: x["at"])),
        F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
        lambda acc, x: F.struct((acc["total"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("total"), x.alias("last")),
        lambda acc: acc["total"],
    )
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((n > WINDOW) & some, covered).otherwise(0)


def _with_words(docs: DataFrame, *more: str) -> DataFrame:
    text = F.col("text").cast("string")
    df = docs.select(*more, F.col("lang").cast("string").alias("lang"), whole_text(text).alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    return df.withColumn("word_text", F.array_join("words", ""))


def _histograms(df: DataFrame) -> DataFrame:
    """Adds ``char_counts`` and ``word_counts`` (null without a word list for the language)."""
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"rest{k}", F.regexp_replace(F.col(f"rest{k - 1}" if k else "word_text"), pattern, ""))
    left = [F.length("text"), F.length("word_text"), *(F.length(f"rest{k}") for k in range(len(CLASSES)))]
    df = df.withColumn("char_counts", F.array(*(a - b for a, b in zip(left, left[1:])), left[-1]))
    listed = reduce(
        lambda found, x: found.when(F.col("lang") == x[0], F.array(*map(F.lit, x[1]))), COMMON_WORDS.items(), F.when(F.lit(False), None)
    )
    df = df.withColumn("places", let(listed, lambda names: F.transform("words", lambda w: F.array_position(names, F.lower(w)))))
    kinds = range(max(map(len, COMMON_WORDS.values())) + 1)
    counts = F.array(*(F.size("places") - F.size(F.array_remove("places", F.lit(k).cast("bigint"))) for k in kinds))
    return df.withColumn("word_counts", F.when(F.col("places").isNotNull(), counts))


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance between two arrays of shares; null if one is null."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def references(docs: DataFrame) -> DataFrame:
    """One row a language: shares of character classes and of common words over all documents of it."""
    n_chars, n_words = len(CLASSES) + 2, max(map(len, COMMON_WORDS.values())) + 1
    rows = _histograms(_with_words(docs)).where(F.col("lang").isNotNull())
    sums = [F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, n in (("char_counts", n_chars), ("word_counts", n_words)) for k in range(n)]
    totals = rows.groupBy("lang").agg(*sums)
    words = F.when(F.col("word_counts0").isNotNull(), F.array(*(F.col(f"word_counts{k}") for k in range(n_words))))
    chars = F.array(*(F.col(f"char_counts{k}") for k in range(n_chars)))
    return totals.select("lang", _share(chars).alias("ref_chars"), _share(words).alias("ref_words"))


def quality_rules(
    docs: DataFrame, *, max_char_distance: float = 0.32, max_word_distance: float = 0.45, max_total: float = 0.52, min_chars: int = 200, min_words: int = 50
) -> DataFrame:
    """Each row of docs with its counts and verdict: row (the input row), doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words (long), char_distance, word_distance (double, null where a guard holds), base_failed,
    kept (boolean)."""
    known = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang")
    df = _histograms(_with_words(known, "row", "doc_id"))
    df = df.join(materialise(references(docs)), "lang", "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length("word_text").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("word_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.when(F.length("word_text") >= min_chars, jensen_shannon(_share(F.col("char_counts")), F.col("ref_chars"))).alias("char_distance"),
        F.when(F.size("words") >= min_words, jensen_shannon(_share(F.col("word_counts")), F.col("ref_words"))).alias("word_distance"),
    )
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    chars, words = F.coalesce("char_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    far = (chars > max_char_distance) | (words > max_word_distance) | (chars + words > max_total)
    # The first test always holds; it keeps a filter on the verdict above this projection, which would else be evaluated twice.
    return df.withColumn("kept", F.when(F.monotonically_increasing_id() >= 0, ~F.col("base_failed") & ~far).otherwise(False))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
