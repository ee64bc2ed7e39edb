"""What a task holds and how often values are computed, whatever the size of the input."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from reqspark.functions import responses as R
from reqspark.functions import similarity, tables
from reqspark.operators import dedup
from reqspark.plans import case_queries, report_queries
from reqspark.sources import adapters

SF = "/root/testdata/sf0.001"


def test_partitions_grow_with_the_lines(spark, monkeypatch):
    assert tables.partitions_for(spark, 1_000) == 4 and tables.partitions_for(spark, 2_600_000) == 11
    before = sorted(adapters.cases(spark, SF).collect())
    monkeypatch.setattr(adapters, "partitions_for", lambda spark, rows: 4 + rows // 1_000)
    parts = adapters.case_parts(spark, SF)
    for most in (adapters.SMALL, 0):  # customers and suppliers broadcast, and dealt by their keys
        monkeypatch.setattr(adapters, "SMALL", most)
        cases = adapters.cases(spark, SF)
        assert parts > 8 and cases.rdd.getNumPartitions() == parts and sorted(cases.collect()) == before
    for name in ("g7_number_cases", "h3_issue_id", "h4_jira_table", "b11_explode_cases", "i2_render_case_text", "g4_dedup_report", "g3_keep_last"):
        from reqspark.plans import registry

        assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() == parts, name


def test_many_lines_are_dealt_by_number_whatever_the_session_has(spark, monkeypatch):
    """Also a session of enough partitions: adaptive execution would merge those of a plain join."""
    before = sorted(adapters.cases(spark, SF).collect())
    monkeypatch.setattr(adapters, "EACH", 1_000)
    for rows in (adapters.cases(spark, SF), adapters.responses(spark, SF)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
    assert sorted(adapters.cases(spark, SF).collect()) == before


def test_responses_are_parsed_once(spark):
    once = adapters.responses(spark, SF).select(R.parse_response(F.col("response")).alias("parsed"))
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("objectkeys")
    for rows in (report_queries.j3(spark, SF), report_queries.j3_warnings(spark, SF), case_queries.b12(spark, SF)):
        assert 0 < parses(rows) <= parses(once)


def test_ratios_of_many_pairs_are_difflibs():
    r = random.Random(5)
    xs = ["".join(r.choice("ab d\0é😀"[: r.randint(2, 7)]) for _ in range(r.randint(0, 60))) for _ in range(2_000)]
    ys = ["".join(r.choice(x or "a") for _ in range(r.randint(0, 50))) if r.random() < 0.4 else x[: len(x) // 2] + "b" + x[r.randint(0, len(x)) :] for x in xs]
    xs[:20], ys[:20] = [x * 9 for x in xs[:20]], [y * 9 for y in ys[:20]]
    assert similarity.ratios(xs, ys).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(xs, ys)]
    assert max(similarity.matched(xs[20:], ys[20:])) > 20


def test_pairs_are_compared_before_they_are_sorted(spark):
    rows = dedup.described_pairs(adapters.cases(spark, SF))
    assert "PythonUDF" not in rows._jdf.queryExecution().executedPlan().toString() and "each(" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.columns == ["requirement_id", "a", "b", "similarity", "summary_a", "summary_b"]


def test_only_the_last_image_of_a_name_is_written(spark, monkeypatch):
    from reqspark.sources import files

    seen = {}
    monkeypatch.setattr(files, "write_named", lambda rows, folder, **options: seen.update(rows={r.name: (r.place, r.content) for r in rows.collect()}, n=rows.count()))
    images = spark.createDataFrame([("s", k if k else None, f"p{k % 3}.png", b"%d" % k) for k in range(30)], "source_file string, seq long, name string, content binary")
    files.write_images(images, "unused")
    assert seen == {"n": 3, "rows": {"s/p0.png": (27, b"27"), "s/p1.png": (28, b"28"), "s/p2.png": (29, b"29")}}


def test_case_tables_dont_share_a_task(spark, monkeypatch):
    from reqspark.sources import files

    seen = []
    monkeypatch.setattr(files, "write_named", lambda rows, folder, **options: seen.extend(rows.select("name", F.spark_partition_id().alias("part")).distinct().collect()))
    table = spark.range(200).select(F.col("id").alias("LinkTest"), F.concat(F.lit("F"), F.col("id") % 20).alias("source_file"))
    files.write_cases(table, "unused", "source_file")
    assert len({r.name for r in seen}) == len({r.part for r in seen}) == len(seen) == 20


def test_lists_of_a_file_are_written_once_a_task(spark, tmp_path):
    """Lists of more than Parquet's usual dictionary, in a caller's session that stays as it is."""
    from reqspark.operators import context

    own = tables.session_with(spark, context.LONG_LISTS)
    long = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.sha2(F.concat_ws("/", "seq", k), 256)), " ")
    kind = F.when(F.col("seq") % 5 == 0, "System Interface").otherwise("System Requirement")
    rows = own.range(500).select(F.lit("f").alias("source_file"), F.col("id").alias("seq"), F.col("id").cast("string").alias("id")).withColumn("type", kind)
    rows = rows.withColumn("text", F.when(F.col("type") == "System Interface", long).otherwise("x"))
    lines = lambda items: F.array_join(F.transform(items, lambda x: x["text"]), "\n")
    augmented = context.augment_requirements(rows, 100, shown=lines, together=150)
    augmented.write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out").groupBy(F.xxhash64("interfaces"), "n_interfaces").agg(F.count("*"), F.max(F.length("interfaces")), F.countDistinct("seq")).collect()
    assert [tuple(r)[1:] for r in out] == [(100, 400, 100 * (300 * 65) - 1, 400)]
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 3 * 100 * 300 * 65
    from reqspark.plans import registry

    assert registry.QUERIES["d4_augment_requirements"](spark, SF).sparkSession.conf.get("parquet.dictionary.page.size") == str(1 << 30)
    assert spark.conf.get("parquet.dictionary.page.size", None) is None
