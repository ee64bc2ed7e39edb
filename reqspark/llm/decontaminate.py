"""Benchmark decontamination: the words of documents that lie in a passage of a benchmark item, by a prefix-filtered join.

Words are runs of letters, digits and code points beyond ASCII, A-Z in lower case. A window is ``window`` consecutive words of
an item; an item of fewer words, but not none, is one window. A document's word is hit if it lies in any occurrence of a window.

1. A window is a set of shingles of ``shingle`` words (fewer in a shorter item). A document holds a window only if it holds all
   of them, so one of them is a sufficient prefix. Documents are read once; a place whose shingle is one of the items' is written
   with the words around it, as far as a window can reach.
2. The written places tell how often each shingle occurs in the corpus. A window with a shingle that occurs nowhere is gone;
   the others are ordered by rarity, and only the rarest shingle of a window is joined with the places.
3. A place and the offset of the shingle within the window give where the window would start and end; both must lie in the
   document, and the words there must be those of the window.

At scale: what is broadcast is the 64-bit hashes of the items' shingles, at most ``BROADCAST`` of them; of more, their
remainders by ``BROADCAST``, which let some places through that step 2 sheds. No text is shuffled. A passage that a third of all
documents hold makes rows in proportion to its occurrences, which joins can split; documents meet only with themselves
afterwards.

Defined cases: a null or empty text has no words, such a document has a row with zeros, such an item no window. Documents that
share a doc_id, or have none, keep a row each. Items that share an item_id count as one; windows of an item without an id
hit, but it isn't counted or named. Equal items are each named. Empty tables give no rows, or zeros. Very long texts are
treated whole. Columns beside doc_id, item_id and text are not looked at.

All of it is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, table, whole_text

#: Between words (as a regular expression of Java and RE2 alike).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hashes that are broadcast at most: some 64 MB.
BROADCAST = 1 << 22


def words_in(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD, -1), "")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, words: each window of each item."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_in(whole_text()).alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words"))


def _hash(words: Column, at: Column, size: int) -> Column:
    """Of the shingle of size words from place at (from 0)."""
    return F.xxhash64(*(F.get(words, at + k) for k in range(size)))


def _shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """window, length, size, k, h: the shingles of each different window."""
    out = windows.select("words").distinct().select("words", F.array_join("words", " ").alias("window"), F.size("words").alias("length"))
    out = out.withColumn("size", F.least(F.lit(shingle), F.col("length")))
    out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))))
    h = F.coalesce(*(F.when(F.col("size") == s, _hash(F.col("words"), F.col("k"), s)) for s in range(1, shingle + 1)))
    return out.select("window", "length", "size", "k", h.alias("h"))


def _places(docs: DataFrame, shingles: DataFrame, window: int, shingle: int) -> DataFrame:
    """at, doc_id, n_words, pos, found, near, before: a row for each place of a document with a shingle of the items, and one
    with found null for each document. found holds hashes, near the words around the place, before how many of them precede it."""
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())
    out = docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", words_in(whole_text()).alias("words"))
    out = out.select("at", "doc_id", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    n = F.size("words")
    for size in sizes:
        keys = shingles.where(F.col("size") == size).select("h").distinct()
        exact = keys.limit(BROADCAST + 1).count() <= BROADCAST
        key = (lambda h: h) if exact else (lambda h: F.pmod(h, F.lit(BROADCAST)))
        h = F.xxhash64("word", *(F.get("words", F.col("pos") + k) for k in range(1, size)))
        out = out.withColumn(f"h{size}", F.when(F.col("pos") + size <= n, h))
        keys = keys.select(key(F.col("h")).alias(f"key{size}")).distinct()
        out = out.join(F.broadcast(keys), key(F.col(f"h{size}")) == F.col(f"key{size}"), "left")
    none = F.array().cast("array<bigint>")
    met = [F.col(f"key{s}").isNotNull() for s in sizes]
    # no lambda from here on: the rows of all places stay in generated code, where the words beside them aren't copied
    found = F.concat(none, *(F.when(m, F.array(f"h{s}")).otherwise(none) for s, m in zip(sizes, met)))
    last, reach = F.col("pos") == n, window - shingle
    first = F.greatest(F.lit(0), F.col("pos") - reach)
    near = F.when(~last, F.array_join(F.slice("words", first + 1, F.col("pos") - first + window), " "))
    return out.where(reduce(or_, met, last)).select(
        "at", F.when(last, F.col("doc_id")).alias("doc_id"), F.when(last, n).alias("n_words"), "pos", F.when(~last, found).alias("found"),
        near.alias("near"), (F.col("pos") - first).alias("before"),
    )


def _hits(places: DataFrame, shingles: DataFrame) -> DataFrame:
    """at, start, end, window: the occurrences of windows."""
    found = places.where("found IS NOT NULL").select("at", "pos", "near", "before", F.explode("found").alias("h"))
    counts = found.groupBy("h").agg(F.count("*").alias("n"))
    order = F.min(F.struct("n", "h", "k"))
    prefix = shingles.join(counts, "h").groupBy("window", "length", "size").agg(F.count("*").alias("present"), order.alias("rarest"))
    prefix = prefix.where("present = length - size + 1").select("window", "length", "rarest.h", "rarest.k")
    met = found.join(prefix, "h").where("before >= k").withColumn("words", F.slice(F.split("near", " "), F.col("before") - F.col("k") + 1, F.col("length")))
    same = met.where((F.size("words") == F.col("length")) & (F.array_join("words", " ") == F.col("window")))
    start = F.col("pos") - F.col("k")
    return same.select("at", start.alias("start"), (start + F.col("length")).alias("end"), "window").distinct()


def find_passages(docs: DataFrame, items: DataFrame, *, window: int = 10, shingle: int = 4) -> DataFrame:
    """doc_id, n_words, n_hit, hits (occurrences of windows, from word start to before word end, in order), items (item_ids as
    strings, in order), contaminated; a row for each row of docs."""
    if not 1 <= shingle <= window:
        raise ValueError("a shingle has at least one word and at most a window's")
    windows = materialise(_windows(items, window).distinct())
    shingles = materialise(_shingles(windows, shingle))
    places = materialise(_places(docs, shingles, window, shingle))
    hits = materialise(_hits(places, shingles))
    spans = hits.groupBy("at").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    more = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to"))
    spans = spans.withColumn("n_hit", F.aggregate("hits", none, more)["n"])
    named = windows.where("item_id IS NOT NULL").select("item_id", F.array_join("words", " ").alias("window"))
    held = hits.select("at", "window").distinct().join(named, "window").groupBy("at").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = places.where("found IS NULL").select("at", "doc_id", F.col("n_words").cast("long")).join(spans, "at", "left").join(held, "at", "left")
    empty = F.array().cast(dict(spans.dtypes)["hits"])
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("hits", empty).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
