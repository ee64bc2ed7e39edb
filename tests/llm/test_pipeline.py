"""The whole corpus pipeline on a small table with every kind of row, and on an empty one."""

import zlib

import numpy as np
import tokenizers

import corpus_pipeline
from reqspark.llm.tokens import default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, words string, id long"
LETTERS = np.array(list("abcdefghijklmnopqrstuvwxyz"))


def words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(LETTERS, rng.integers(3, 9))) for _ in range(n)]


def wrapped(ws, width):
    return "\n".join(" ".join(ws[k : k + width]) for k in range(0, len(ws), width))


def test_pipeline(spark, tmp_path):
    texts = {k: wrapped(words(k, 60 + k), 9) for k in range(40)}
    texts[40] = wrapped(words(3, 63), 16)  # of 3, wrapped otherwise: no line is like another, all shingles are
    texts[41] = texts[5]  # all its lines are repeated
    shared = " ".join(words(999, 12))
    texts[6] += "\n" + shared
    texts[42] = wrapped(words(42, 70), 9) + "\n" + shared.upper() + "\nlast"
    texts |= {43: None, 44: "", 45: " \n\t", 46: "too short", 47: "again and again " * 200, 48: wrapped(words(48, 30_000), 9)}
    data = [(k, t, "en" if k % 2 else None, None if k == 6 else f"s{k % 3}", len(t or ""), None, "x", k) for k, t in texts.items()]
    data += [data[7], (None, wrapped(words(77, 80), 9), None, None, None, True, None, None)]
    spark.createDataFrame(data, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stay = {k: t for k, t in texts.items() if k < 40 or k == 48} | {42: texts[42].replace("\n" + shared.upper(), ""), None: data[-1][1]}
    library = tokenizers.Tokenizer.from_file(str(default_vocabulary()))
    pieces = {}
    for p in got:
        pieces.setdefault(p.doc_id, []).append(p)
    assert pieces.keys() - {41} == stay.keys()
    assert sum(p.length for p in pieces.get(41, [])) <= 1
    for k, text in stay.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine, end = sorted(pieces[k], key=lambda p: p.start), 0
        for p in mine:
            assert p.start == end and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
            end += p.length
        assert end == len(ids)
    rooms = {}
    for p in got:
        rooms.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for room in rooms.values():
        at = 0
        for offset, length in sorted(room):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(k, wrapped(words(k, 50), 9), "en", "s", 1, None, "x", k) for k in range(5)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes] and out.count() == 5


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
