"""Personal data: four checked formats, and boosted trees for what is written otherwise.

Formats (base spans): email, ip, card, phone; what fails its check is dropped. Then high-recall generators propose
looser, overlapping spans (runs of digits and separators, runs of digits alone, addresses with "(at)" and "(dot)").
Gradient-boosted trees, trained here, tell from format and context features whether a proposal is personal data. They learn
from other forms than the checked ones: each checked span stands for itself and for its rewritten forms (``REWRITTEN``: an
address spelt out, a number without its plus sign or with other separators), and, in the same place, after the same words,
for values that are none (``SPOILT``: dates, ranges, references), so that a context word alone tells nothing. A proposal that
overlaps no checked span and has no word of its own kind before it is no personal data, whatever words of other kinds stand there;
one with such a word, or that is a part of a checked span, is left open. No feature sees the checks or the signs that only they
ask for (the plus sign, the at sign).

On held-out labels each kind gets the lowest probability threshold that keeps the share of right ones at ``precision`` or
more; a kind without one adds nothing. Proposals that overlap no base span and reach the threshold of their kind are
added; of those that overlap each other the longest stays, of equal ones the likeliest.

The trees learn from at most ``max_training_rows`` proposals (a bounded sample, by hash); thresholds come from all labels
outside the training fold, as a histogram of at most 400 rows.

DataFrame and Spark ML functions only. One scan of the text, which is never shuffled; spans and proposals are kept. Spans are
found in time near their number, however long the text.

Defined cases: a null text counts as empty; repeated doc_ids are scanned row by row; an empty table, or labels of one class
only, train no trees and add nothing; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, table, whole_text
from .spans import find_all, labelled, no_spans, overlaps, written

KINDS = ["email", "ip", "card", "phone"]
#: The formats, so written that they match the same spans without going back over a run: a local part or a run of
#: digits is only tried from its start, or from where the last match ended.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators.
LOOSE_NUMBER = r"[+(]?[0-9][0-9\x20().+/-]{5,}[0-9]"
DIGITS = r"(?<![0-9])[0-9]{7,19}(?![0-9])"
LOOSE_EMAIL = rf"(?<!{LOCAL}){LOCAL}++\x20?[(\[][Aa][Tt][)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[][Dd][Oo][Tt][)\]])\x20?[A-Za-z0-9-]++)++"
#: Words that stand before such data.
CONTEXT = {
    "email": "mail|contact|write|address|correo|adresse",
    "ip": r"\bip\b|host|server|address|addr",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|appel|anruf",
}
BEFORE = 32
#: Forms into which a checked span is rewritten to learn from: pattern and replacement, one after the other.
REWRITTEN = {
    "email": [[("@", " (at) "), (r"\.", " (dot) ")], [("@", "[at]"), (r"\.", ".")]],
    "phone": [[(r"^\+", "")], [(r"^\+", ""), (r"[\x20()-]+", ".")], [(r"^\+", ""), (r"[\x20()-]+", "-")]],
    "card": [[(r"[\x20-]", ".")], [(r"[\x20-]", "/")]],
    "ip": [],
}
#: What the digits of a checked number become to learn what is none: a date, a range of years, references.
SPOILT = [
    (r"^(..)(..)(....).*$", "$1/$2/$3"), (r"^(....)(....).*$", "$1-$2"), (r"^(...)(....).*$", "$1/$2"), (r"^(....)(..)(..).*$", "$1-$2-$3"),
]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0), lambda s, x: s + x
    )
    return total % 10 == 0


def _small(part: Column) -> Column:
    """At most 255; leading zeros don't count."""
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def base_spans(text: Column) -> Column:
    """All checked spans, in the order of kinds, then of places."""
    has = lambda sign, spans: F.when(F.contains(text, F.lit(sign)), spans).otherwise(no_spans())
    email = has("@", find_all(text, EMAIL))
    ip = F.filter(find_all(text, IP), lambda s: F.forall(F.split(s["value"], r"\."), _small))
    card = F.filter(
        find_all(text, CARD), lambda s: let(_digits(s["value"]), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    )
    phone = F.filter(has("+", find_all(text, PHONE)), lambda s: F.length(_digits(s["value"])).between(8, 15))
    return F.concat(*(labelled(s, k, i) for i, (s, k) in enumerate(zip((email, ip, card, phone), KINDS))))


def _proposals(text: Column) -> Column:
    """What the generators find: start, end, value, the text before, and the signs next to it."""
    loose = F.when(F.lower(text).rlike(r"[(\[]at[)\]]"), find_all(text, LOOSE_EMAIL)).otherwise(no_spans())
    emails = F.when(F.contains(text, F.lit("@")), find_all(text, EMAIL)).otherwise(no_spans())
    numbers = F.when(text.rlike("[0-9]{3}"), F.array_distinct(F.concat(find_all(text, LOOSE_NUMBER), find_all(text, DIGITS)))).otherwise(no_spans())
    return F.transform(
        F.concat(emails, loose, numbers),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - BEFORE), F.least(F.lit(BEFORE), s["start"]))).alias("before"),
            F.substring(text, s["end"] + 1, F.lit(1)).alias("after"),
        ),
    )


def _features(p: Column) -> dict[str, Column]:
    value, before = F.regexp_replace(p["value"], r"^\+", ""), p["before"]
    count = lambda pattern: (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))).cast("double")
    groups = F.array_remove(F.split(value, "[^0-9]+", -1), "")
    out = {
        "length": F.length(value).cast("double"),
        "digits": count("[0-9]"),
        "address": value.rlike("[A-Za-z]").cast("double"),
        "separators": count(r"[\x20().-]"),
        "slashes": count("/"),
        "groups": F.size(groups).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"),
        "first": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)).cast("double"),
        "joined": before.rlike("[a-z0-9]$").cast("double"),
        "goes_on": p["after"].rlike("[A-Za-z0-9]").cast("double"),
    }
    near = {k: before.rlike(w) for k, w in CONTEXT.items()}
    own = lambda k: F.col("kind") == k
    mine = reduce(or_, (own(k) & near[k] for k in KINDS))
    return out | {"near_own": mine.cast("double"), "near_other": reduce(or_, (~own(k) & near[k] for k in KINDS)).cast("double")}


def _kind(p: Column) -> Column:
    n = F.length(_digits(p["value"]))
    number = F.when(p["value"].rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip").when(n >= 13, "card").otherwise("phone")
    return F.when(p["value"].rlike(r"@|[(\[][Aa][Tt][)\]]"), "email").otherwise(number)


def _rewritten(p: Column, kind: Column) -> Column:
    """A proposal of a checked span in its other forms."""

    def form(steps: list[tuple[str, str]]) -> Column:
        value = p["value"]
        for pattern, other in steps:
            value = F.regexp_replace(value, pattern, other)
        return value

    forms = F.array().cast("array<string>")
    for name, steps in REWRITTEN.items():
        if steps:
            forms = F.when(kind == name, F.array(*map(form, steps))).otherwise(forms)
    return F.transform(F.array_except(F.array_distinct(forms), F.array(p["value"])), lambda v: p.withField("value", v))


def _spoilt(p: Column, kind: Column) -> Column:
    """In the place of a checked number, values of like length that are no such data."""
    digits = _digits(p["value"])
    values = F.when(kind.isin("phone", "card"), F.array(*(F.regexp_replace(digits, *form) for form in SPOILT))).otherwise(F.array().cast("array<string>"))
    return F.transform(values, lambda v: p.withField("value", v))


def _described(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """Proposals (p) with kind and features."""
    features = _features(F.col("p"))
    rows = rows.withColumn("kind", _kind(F.col("p"))).select("row_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"), "kind", "whole", "overlap", "hash", "fold", *(c.alias(n) for n, c in features.items()))
    rows = rows.withColumn("label", F.when(F.col("whole"), 1.0).when(~F.col("overlap") & (F.col("near_own") == 0), 0.0) if label is None else label)
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def _trees(proposals: DataFrame, precision: float, max_training_rows: int) -> DataFrame | None:
    """The proposals (row_id, base, p, and whether p is a whole checked span or overlaps one) apart from checked spans that the
    trees and the thresholds of their kinds select, with their scores; None if there is nothing to learn."""
    rows = _described(proposals)
    of = F.get(F.filter("base", lambda b: (b["start"] == F.col("p.start")) & (b["end"] == F.col("p.end"))), F.lit(0))["kind"]
    checked = proposals.where("whole")
    forms = _described(checked.withColumn("p", F.explode(_rewritten(F.col("p"), of))), F.lit(1.0))
    others = _described(checked.withColumn("p", F.explode(_spoilt(F.col("p"), of))), F.lit(0.0))
    known = rows.union(forms).union(others).where("label IS NOT NULL")
    training = known.where("fold > 0").orderBy("hash", "row_id", "start", "end", "kind", "length", "groups", "label").limit(max_training_rows).select("features", "label", "row_id")
    training = materialise(training.repartition(8, "row_id"))
    if training.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=4, seed=7).fit(training)
    scored = lambda df: trees.transform(df).withColumn("score", vector_to_array("probability")[1])
    bins = scored(known.where("fold = 0")).groupBy("kind", F.floor(F.col("score") * 100).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("yes")).collect()
    chosen = F.lit(False)
    for kind in KINDS:
        n = yes = 0.0
        least = None
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            n, yes = n + r["n"], yes + r["yes"]
            if r["bin"] >= 50 and yes >= precision * n:
                least = r["bin"] / 100
        if least is not None:
            chosen = chosen | ((F.col("kind") == kind) & (F.col("score") >= least))
    return scored(rows.where("NOT overlap")).where(chosen)


def _best(spans: Column) -> Column:
    """Of spans (start, order, end, kind, score) that overlap, the longest, then the one of the highest score."""
    length = lambda s: s["end"] - s["start"]
    better = lambda a, b: F.when(length(a) != length(b), length(a) > length(b)).otherwise(a["score"] >= b["score"])

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        rest = F.slice(acc, F.lit(1), F.size(acc) - 1)
        clash = (F.size(acc) > 0) & (s["start"] < F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)))
        return F.when(~clash, F.concat(acc, F.array(s))).when(better(last, s), acc).otherwise(F.concat(rest, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double>>"), step)


def find_pii(docs: DataFrame, *, precision: float = 0.99, max_training_rows: int = 20_000) -> DataFrame:
    """doc_id, base and added (arrays of spans: start, order, end, kind; code points, end exclusive)."""
    text = whole_text(F.col("text").cast("string"))
    found = docs.select("doc_id", text.alias("text")).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", base_spans(F.col("text")).alias("base"), _proposals(F.col("text")).alias("proposals")
    )
    found = materialise(found)
    proposals = found.where(F.size("proposals") > 0).select("row_id", "doc_id", "base", F.explode("proposals").alias("p"))
    proposals = proposals.select(
        "row_id",
        "base",
        "p",
        F.exists("base", lambda b: (b["start"] == F.col("p.start")) & (b["end"] == F.col("p.end"))).alias("whole"),
        overlaps(F.col("base"), F.col("p.start"), F.col("p.end")).alias("overlap"),
        F.xxhash64("doc_id", "p.start").alias("hash"),
        F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold"),
    )
    chosen = _trees(proposals, precision, max_training_rows)
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    if chosen is None:
        return found.select("doc_id", "base", none.alias("added"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    spans = chosen.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("start", order.alias("order"), "end", "kind", "score"))).alias("added"))
    spans = spans.select("row_id", F.transform(_best(F.col("added")), lambda s: s.dropFields("score")).alias("added"))
    return found.join(spans, "row_id", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    by_kind = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["order"], s["start"], s["end"], s["kind"])))
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(by_kind).alias("spans"))
