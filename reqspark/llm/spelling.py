"""Spelling variants: words grouped with the far more frequent word one code point away, by a bidirectional FM-index.

Words are maximal runs of letters [A-Za-z] and U+00C0 to U+00FF, A-Z in lower case, of at least ``min_chars`` code points, with at
least ``min_count`` occurrences in all texts. Two words are near if they differ by one inserted, deleted or replaced code point.
A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` times its own;
its root is where the forms lead.

Search: one error leaves the first or the second half of a word intact. So a near word begins with the word's first half, which
is matched exactly and then extended to the right allowing one error, or ends with its second half, which is matched and
extended to the left. Both run on a bidirectional FM-index of the delimited words (module fm_index); the left extension is
the right one on reversed words.

At scale: occurrences are counted with partial sums before the one shuffle by word. Words are dealt by their first two code points
for the first search and by their last three for the second (halves have at least that many), so a word meets only words that
may be near; a deal holds about ``BLOCK`` words. A larger one, of a hot beginning, is split into parts, and every part of its
queries meets every part of its words. An index and its queries are bounded by the size of a part. Counts, vocabulary and links
are written tables; nothing of them comes to the driver. Roots take as many rounds as the logarithm of the longest chain; a chain
at least doubles n at each step.

Defined cases: null and empty texts have no words. Rows that repeat a doc_id count each; a null doc_id is written as an empty
string where a run's hash needs it. Very long texts and runs are treated whole. Empty tables give no rows. Columns beside doc_id
and text are not looked at.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .common import discard, lower_ascii, materialise, table, whole_text
from .fm_index import FMIndex, near_words

#: Between words (as a regular expression of Java).
NOT_LETTERS = r"[^A-Za-zÀ-ÿ]+"
#: Words a deal, and queries that are searched at once.
BLOCK, BATCH = 1 << 15, 1 << 12


def count_words(docs: DataFrame, *, min_chars: int = 5, min_count: int = 3, damage: int | None = None) -> DataFrame:
    """word, n. With damage, one in so many runs (by crc32 of doc_id and run) loses a code point first: planted slips."""
    runs = F.array_remove(F.split(lower_ascii(whole_text()), NOT_LETTERS, -1), "")
    out = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("word"))
    if damage:
        h = F.crc32(F.concat("doc_id", F.lit(":"), F.col("word")))
        at = (h % F.length("word")).cast("int")
        without = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        out = out.select(F.when(h % damage == 0, without).otherwise(F.col("word")).alias("word"))
    return out.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _deals(words: DataFrame, min_chars: int) -> DataFrame:
    """back, deal, part, asked, word, indexed: what is searched together; back tells reversed words (second halves)."""
    back = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    half = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    shared = F.when(F.col("back"), min_chars - min_chars // 2).otherwise(min_chars // 2)
    deals = max(1, -(-words.count() // BLOCK))
    both = words.select("word", back).select("back", half.alias("word"), F.pmod(F.xxhash64(F.substring(half, F.lit(1), shared)), F.lit(deals)).alias("deal"))
    parts = both.groupBy("back", "deal").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
    both = both.join(parts, ["back", "deal"]).withColumn("own", F.pmod(F.xxhash64(F.lit(7), "word"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    indexed = both.select("back", "deal", F.col("own").alias("part"), every.alias("asked"), "word", F.lit(True).alias("indexed"))
    return indexed.union(both.select("back", "deal", every.alias("part"), F.col("own").alias("asked"), "word", F.lit(False).alias("indexed")))


def near_pairs(words: DataFrame, *, min_chars: int = 5) -> DataFrame:
    """word, near: each pair of different words (column word, each once) that differ by one code point, both ways round."""
    if min_chars < 2:
        raise ValueError("words need two halves")
    ship(words.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        back, known, asked = group.column("back")[0].as_py(), [], []
        for word, indexed in zip(group.column("word").to_pylist(), group.column("indexed").to_pylist()):
            (known if indexed else asked).append(word)
        left, right = [], []
        if known and asked:
            index = FMIndex(known)
            for length, same in groupby(sorted(asked, key=len), len):
                same = list(same)
                for k in range(0, len(same), BATCH):
                    batch = same[k : k + BATCH]
                    i, j = near_words(index, batch, length - length // 2 if back else length // 2)
                    left += [batch[x] for x in i]
                    right += [known[x] for x in j]
        if back:
            left, right = [x[::-1] for x in left], [x[::-1] for x in right]
        return pa.table({"word": pa.array(left, pa.string()), "near": pa.array(right, pa.string())})

    deals = materialise(_deals(words.select("word"), min_chars))
    return deals.groupBy("back", "deal", "part", "asked").applyInArrow(run, "word string, near string").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (columns word, form; no cycles) lead, for each word that has one."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, now = now, materialise(now.select("word", "root").join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(old)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(words: DataFrame, *, min_chars: int = 5, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of words (columns word, n)."""
    words = materialise(words.select("word", "n"))
    near = near_pairs(words, min_chars=min_chars)
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("near").alias("form")))
    best = near.join(words.withColumnRenamed("word", "near"), "near").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = -F.col("best.minus_n") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.minus_n")).alias("form_n")
    )
    out = materialise(out)
    led = roots(out.where("form IS NOT NULL"))
    return out.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(count_words(table(spark, sf_dir, "documents"), damage=97))
