"""Streams that remember keys: figures after each batch, replays, and work that doesn't grow."""

import json

import pytest
from pyspark.sql import functions as F

from reqspark.streaming import jobs

SCHEMA = "example_id long, status string, n int"


def stats(rows):
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "validated").alias("validated"), F.sum("n").alias("n"))


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda k, status="pending": {"example_id": k, "status": status, "n": k}
    batches = [[row(1), row(2, "validated")], [row(2, "validated"), row(3)], [row(1), row(4, "validated"), row(4, "validated")], [row(3)]]
    return folder, batches


def test_figures_after_each_batch(spark, files, tmp_path):
    folder, batches = files
    out = f"file://{tmp_path}/stats"
    seen, want = {}, []
    for k, rows in enumerate(batches):
        put(folder, f"{k}.json", rows)
        for r in rows:
            seen.setdefault(r["example_id"], r)
        want.append((k, len(seen), sum(r["status"] == "validated" for r in seen.values()), sum(r["n"] for r in seen.values())))
        # one batch a call, each going on where the last one ended
        got = jobs.running_stats(spark, str(folder), SCHEMA, "example_id", stats, form="json", out=out)
        assert sorted((r.batch, r.total, r.validated, r.n) for r in got.collect()) == want
    again = jobs.running_stats(spark, str(folder), SCHEMA, "example_id", stats, form="json", out=out)
    assert sorted((r.batch, r.total, r.validated, r.n) for r in again.collect()) == want  # nothing new: no batch


def test_batches_of_one_call(spark, files, tmp_path):
    folder, batches = files
    for k, rows in enumerate(batches):
        put(folder, f"{k}.json", rows)
    got = jobs.running_stats(spark, str(folder), SCHEMA, "example_id", stats, form="json")
    last = max(got.collect(), key=lambda r: r.batch)
    assert (last.batch, last.total, last.validated, last.n) == (3, 4, 2, 10)


def test_each_key_once_and_batches_that_run_again(spark, files, tmp_path):
    folder, batches = files
    out = f"file://{tmp_path}/rows"
    for k, rows in enumerate(batches[:2]):
        put(folder, f"{k}.json", rows)
    assert sorted(r.example_id for r in jobs.collect_once(spark, str(folder), SCHEMA, "example_id", form="json", out=out).collect()) == [1, 2, 3]
    # a batch whose end was not noted runs again, and counts once
    commits = tmp_path / "rows-state" / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink(missing_ok=True)
    for k, rows in enumerate(batches[2:], 2):
        put(folder, f"{k}.json", rows)
    assert sorted(r.example_id for r in jobs.collect_once(spark, str(folder), SCHEMA, "example_id", form="json", out=out).collect()) == [1, 2, 3, 4]


def test_batches_read_their_own_files_alone(spark, files, tmp_path):
    """Rows read by a batch are those of its files, however many came before."""
    folder, _ = files
    for k in range(6):
        put(folder, f"{k}.json", [{"example_id": 10 * k + i, "status": "x", "n": 1} for i in range(5)])
    seen = []
    real = jobs._once
    counted = lambda *a: real(*a).filter(F.lit(True))
    jobs._once = counted
    try:
        jobs.collect_once(spark, str(folder), SCHEMA, "example_id", form="json", out=f"file://{tmp_path}/rows")
    finally:
        jobs._once = real
    for k in range(6):
        seen.append(spark.read.parquet(f"file://{tmp_path}/rows/batch={k}").count())
    assert seen == [5] * 6
