"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .quality_rules import CLASSES, COMMON_WORDS

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.node AS vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, r.node = min(other) AS kept
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) c ON c.a = r.node GROUP BY r.node"""


def _strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _distance(p: str, q: str) -> str:
    part = lambda a: f"CASE WHEN {a}[i] > 0 THEN {a}[i] * log2({a}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0::DOUBLE, list_sum([{part(p)} + {part(q)} for i in range(1, len({p}) + 1)]) / 2))"


_names = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_strings(v)}" for k, v in COMMON_WORDS.items()) + " END"
_rests, _last = [], "word_text"
for _k, _pattern in enumerate(CLASSES):
    _rests.append(f"r{_k} AS (SELECT *, regexp_replace({_last}, '{_pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS rest{_k} FROM {'d' if _k == 0 else f'r{_k - 1}'})")
    _last = f"rest{_k}"
_lengths = ["length(text)", "length(word_text)", *(f"length(rest{k})" for k in range(len(CLASSES)))]
_chars = "[" + ", ".join([*(f"{a} - {b}" for a, b in zip(_lengths, _lengths[1:])), _lengths[-1]]) + "]"
_share = "CASE WHEN list_sum({0}) > 0 THEN [x / list_sum({0}) for x in {0}] ELSE [0.0::DOUBLE for x in {0}] END"

QUALITY = rf"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (SELECT *, array_to_string(words, '') AS word_text, {_names} AS names FROM t),
{", ".join(_rests)},
h AS (SELECT *, {_chars} AS chars, [lower(w) for w in words] AS lw FROM r{len(CLASSES) - 1}),
c AS (SELECT *, [len([w for w in lw if w = x]) for x in names] AS listed FROM h),
k AS (SELECT *, list_concat([len(words) - list_sum(listed)], listed) AS counts FROM c),
ref AS (SELECT lang, {", ".join(f"sum(chars[{i}]) AS c{i}" for i in range(1, len(CLASSES) + 3))}, {", ".join(f"sum(counts[{i}]) AS w{i}" for i in range(1, 14))} FROM k WHERE lang IS NOT NULL GROUP BY lang),
ref2 AS (SELECT lang, [{", ".join(f"c{i}::DOUBLE" for i in range(1, len(CLASSES) + 3))}] AS rc, CASE WHEN w1 IS NOT NULL THEN [{", ".join(f"w{i}::DOUBLE" for i in range(1, 14))}] END AS rw FROM ref),
both_ AS (SELECT k.*, {_share.format("chars")} AS p, {_share.format("rc")} AS q, {_share.format("counts")} AS u, {_share.format("rw")} AS v FROM k LEFT JOIN ref2 USING (lang)),
dist AS (SELECT *, CASE WHEN length(word_text) >= 200 AND q IS NOT NULL THEN {_distance("p", "q")} END AS dc, CASE WHEN len(words) >= 50 AND counts IS NOT NULL AND v IS NOT NULL THEN {_distance("u", "v")} END AS dw FROM both_),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
cover AS (SELECT doc_id, sum(least(8, gap)) AS n FROM (SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS gap FROM twice) GROUP BY 1),
lines AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM t),
o AS (SELECT doc_id, len(words) AS n_words, length(word_text) AS word_chars, length(regexp_replace(word_text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  coalesce(dc, 0) AS dc, coalesce(dw, 0) AS dw FROM dist LEFT JOIN cover USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (dc > 0.32 OR dw > 0.45 OR dc + dw > 0.52) AS kept FROM f"""

_word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_word}')"

DECONTAMINATION = f"""WITH i AS (SELECT item_id::VARCHAR AS item_id, {_split} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k:k + 9], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_split} AS w FROM documents),
places AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT * FROM places SEMI JOIN win USING (win, m)),
cover AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM hit) GROUP BY 1),
held AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit JOIN win USING (win, m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN held USING (doc_id)"""

NEGATIVES = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_sum([a.q[i] * b.q[i] for i in range(1, len(a.q) + 1)])::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""

ORACLES = {"op1_vectors": VECTORS, "op10_quality_rules": QUALITY, "op12_decontamination": DECONTAMINATION, "op13_hard_negatives": NEGATIVES}
