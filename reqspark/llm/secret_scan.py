"""Secret scans: three formats, and a randomness test battery for other long tokens.

Formats (base spans): assign, access, hex. The battery looks at every other run of 20 or more token characters:
1. its encoding is inferred from its characters (digits, hex, base32, letters and digits, base64), and each character
   becomes its place in that alphabet;
2. three tests against "every place is equally likely": chi-squared uniformity over equal cells of the alphabet, the
   runs test about the middle of the alphabet, and first-order serial correlation. A token stays when the smallest of
   the three p-values, times three, is at least ``alpha``;
3. length-aware control of false discoveries: the likelihood ratio of the random model to ordinary text is an
   e-value, which grows with each character. Ordinary text is a Markov chain of character classes, counted over all
   shorter tokens (8 to 19 characters) of the corpus. The e-values of all tokens of the corpus go through the e-BH
   procedure at level ``fdr``: the k largest are discoveries if the smallest of them is at least tokens / (k * fdr).
   For this only a histogram of logarithms (at most ``BINS`` rows) comes to the driver, lower edges standing for
   their bins, which errs to the safe side.

DataFrame functions only. Two scans of the text, which is never shuffled; what is kept between is spans and tokens.

Defined cases: a null text counts as empty; repeated doc_ids are scanned row by row; tokens of equal e-values are discovered
together or not at all; a text is scanned whole, however long it is; an empty table gives no row; other columns are not looked
at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, materialise, table, whole_text
from .spans import find_all, labelled, overlaps, written

#: The formats. Runs shorter than the least length can't hold a longer match, so the length is part of
#: the access and hex patterns; a short assign match still uses up its text, so its length is tested afterwards.
ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN = 6
KINDS = ["assign", "access", "hex", "random"]

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
SHORTER = r"[A-Za-z0-9+/_=-]{8,}"
DIGITS = "0123456789"
SIGNS = "+/_=-"
BINS = 2000


def _bases(text: Column) -> list[Column]:
    assign = F.filter(find_all(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= MIN_ASSIGN)
    return [assign, find_all(text, ACCESS), find_all(text, HEX)]


def class_model(docs: DataFrame) -> dict[str, float]:
    """Natural logarithms of the chances of ordinary text: key "ab" is character class b after a (^: start), add-one
    smoothed, then divided evenly among the characters of b. Tokens meet first as strings of classes, so that few rows
    are shuffled; the result has 20 rows."""
    tokens = docs.select(F.explode(F.regexp_extract_all(whole_text(), F.lit(SHORTER), F.lit(0))).alias("t")).where(F.length("t") < 20)
    classes = F.translate("t", UPPER + LOWER + DIGITS + SIGNS, "U" * 26 + "l" * 26 + "d" * 10 + "s" * 5)
    strings = tokens.groupBy(F.concat(F.lit("^"), classes).alias("c")).agg(F.count("*").alias("n"))
    pairs = strings.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("c") - 1), lambda i: F.substring("c", i, 2))).alias("pair"))
    seen = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    size = {"U": 26, "l": 26, "d": 10, "s": 5}
    out = {}
    for a in "^Ulds":
        total = sum(seen.get(a + b, 0) + 1 for b in size)
        out |= {a + b: math.log((seen.get(a + b, 0) + 1) / total / n) for b, n in size.items()}
    return out


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the logistic form, at most 0.0002 off."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), 1.5976 * z + 0.07056 * z * z * z))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def chi_squared_p(codes: Column, size: Column) -> Column:
    """Uniformity of codes below size, over cells with about five expected or more."""
    n = F.size(codes)
    cells = F.greatest(F.lit(2), F.least(size, F.floor(n / 5).cast("int"), F.lit(16)))
    cell = F.transform(codes, lambda x: F.floor(x * cells / size).cast("int"))
    #: how many of the alphabet's places fall into a cell
    width = lambda k: F.ceil((k + 1) * size / cells) - F.ceil(k * size / cells)
    x2 = let(cell, lambda c: _sum(F.transform(F.sequence(F.lit(0), cells - 1), lambda k: F.pow(F.size(F.filter(c, lambda v: v == k)).cast("double"), F.lit(2.0)) * size / width(k) / n))) - n
    df = (cells - 1).cast("double")
    z = (F.pow(F.greatest(x2, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return _upper_tail(z)


def runs_p(codes: Column, size: Column) -> Column:
    """Wald-Wolfowitz about the middle of the alphabet, two-sided; 0 if all codes are on one side."""
    high = F.transform(codes, lambda x: (2 * x >= size).cast("int"))

    def p(bits: Column) -> Column:
        n = F.size(bits).cast("double")
        ones = F.aggregate(bits, F.lit(0), lambda s, x: s + x).cast("double")
        changes = F.size(F.filter(bits, lambda x, i: (i > 0) & (F.get(bits, i - 1) != x)))
        mean = 2 * ones * (n - ones) / n + 1
        deviation = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
        return F.when((ones == 0) | (ones == n) | (mean <= 2), 0.0).otherwise(2 * _upper_tail(F.abs(changes + 1 - mean) / deviation))

    return let(high, p)


def serial_p(codes: Column) -> Column:
    """First-order serial correlation, two-sided; 0 if all codes are equal."""

    def p(x: Column) -> Column:
        n = F.size(x).cast("double")
        mean = _sum(F.transform(x, lambda v: v.cast("double"))) / n
        off = F.transform(x, lambda v: v - mean)

        def of(d: Column) -> Column:
            square = _sum(F.transform(d, lambda v: v * v))
            r = _sum(F.transform(d, lambda v, i: F.when(i > 0, v * F.get(d, i - 1)).otherwise(0.0))) / square
            return F.when(square == 0, 0.0).otherwise(2 * _upper_tail(F.abs(r + 1 / n) * F.sqrt(n)))

        return let(off, of)

    return let(codes, p)


def battery(token: Column, model: dict[str, float]) -> Column:
    """struct<p, log_e>: the combined p-value against randomness, and the log likelihood ratio to ordinary text."""
    plain = F.regexp_replace(token, "=+$", "")
    kinds = [
        ("^[0-9]+$", DIGITS),
        ("^[0-9a-f]+$", DIGITS + "abcdef"),
        ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
        ("^[A-Z2-7]+$", UPPER + "234567"),
        ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
        ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
        ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ]
    alphabet = F.when(F.lit(False), "")
    for pattern, letters in kinds:
        alphabet = alphabet.when(plain.rlike(pattern), letters)
    alphabet = alphabet.otherwise(UPPER + LOWER + DIGITS + SIGNS)

    def tests(x: Column) -> Column:
        t, letters = x["t"], x["a"]
        size = F.length(letters)
        n = F.length(t)
        codes = F.transform(F.sequence(F.lit(1), n), lambda i: F.instr(letters, F.substring(t, i, F.lit(1))) - 1)
        classes = F.concat(F.lit("^"), F.translate(t, UPPER + LOWER + DIGITS + SIGNS, "U" * 26 + "l" * 26 + "d" * 10 + "s" * 5))
        pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(classes, i, F.lit(2)))
        chance = F.create_map(*(v for k, p in model.items() for v in (F.lit(k), F.lit(p))))
        text = let(F.struct(pairs.alias("p"), chance.alias("m")), lambda y: _sum(F.transform(y["p"], lambda k: y["m"][k])))
        smallest = let(codes, lambda c: F.least(chi_squared_p(c, size), runs_p(c, size), serial_p(c)))
        return F.struct(F.least(F.lit(1.0), 3 * smallest).alias("p"), (-n * F.log(size.cast("double")) - text).alias("log_e"))

    return F.when(F.length(plain) >= 8, let(F.struct(plain.alias("t"), alphabet.alias("a")), tests))


def discovery_threshold(tokens: DataFrame, fdr: float) -> float:
    """The least log e-value that e-BH accepts among all tokens (column log_e; null: not a candidate any more)."""
    edge = F.floor(F.least(F.lit(BINS), F.greatest(F.lit(-1), F.coalesce("log_e", F.lit(-1.0)))))
    bins = tokens.groupBy(edge.alias("edge")).agg(F.count("*").alias("n")).collect()
    total, k, best = sum(r["n"] for r in bins), 0, math.inf
    for r in sorted(bins, key=lambda r: -r["edge"]):
        k += r["n"]
        if r["edge"] >= 0 and r["edge"] >= math.log(total / (k * fdr)):
            best = float(r["edge"])
    return best


def secret_scan(docs: DataFrame, *, alpha: float = 0.01, fdr: float = 0.01) -> DataFrame:
    """doc_id, base and random (arrays of spans: start, order, end, kind; code points, end exclusive)."""
    docs = docs.select("doc_id", whole_text(F.col("text").cast("string")).alias("text"))
    model = class_model(docs)
    bases = _bases(F.col("text"))
    found = docs.select(
        "doc_id",
        F.array_sort(F.concat(*(labelled(s, k, i) for i, (s, k) in enumerate(zip(bases, KINDS))))).alias("base"),
        find_all(F.col("text"), TOKEN).alias("tokens"),
    )
    rest = F.filter("tokens", lambda t: ~overlaps(F.col("base"), t["start"], t["end"]))
    judged = F.transform(rest, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), battery(t["value"], model).alias("is")))
    found = materialise(found.select("doc_id", "base", F.when(F.size("tokens") > 0, judged).alias("tokens")))
    passed = lambda t: F.when(t["is"]["p"] >= alpha, t["is"]["log_e"])
    least = discovery_threshold(found.select(F.explode("tokens").alias("t")).select(passed(F.col("t")).alias("log_e")), fdr)
    random = F.filter(F.coalesce("tokens", F.expr("array()").cast("array<struct<start:int,end:int,`is`:struct<p:double,log_e:double>>>")), lambda t: F.coalesce(passed(t) >= least, F.lit(False)))
    return found.select("doc_id", "base", labelled(random, "random", 3).alias("random"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
