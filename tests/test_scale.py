"""Forms of jobs that decide how their figures grow."""

import hashlib

from pyspark.sql import functions as F

from tallyline.operators import stats as st
from tallyline.session import durable


def test_draws_are_joined_as_they_are(spark):
    """Draws are near distinct, so neither a sort nor an aggregate of them comes before the one shuffle."""
    rows = spark.range(40).select(F.lit("g").alias("k"), (F.col("id") * 3).alias("v"), F.col("id").alias("o"))
    drawn = st.drawn_weights(rows, ["k"], "v", "o", 5, "x")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Aggregate" not in plan and "SortMergeJoin" not in plan
    got = sorted((r["__b"], r["v"]) for r in drawn.collect() for _ in range(r["__w"]))
    want = sorted((b, int(hashlib.md5(f"x|{b}|{i}".encode()).hexdigest()[:15], 16) % 40 * 3) for b in range(1, 6) for i in range(40))
    assert got == want


def test_few_ranks_make_many_tasks_of_draws(spark):
    """Small files of ranks are dealt again before a rank becomes many draws."""
    rows = spark.range(0, 40, 1, 1).select(F.lit("g").alias("k"), F.col("id").alias("v"), F.col("id").alias("o"))
    plan = st.drawn_weights(rows, ["k"], "v", "o", 5, "x")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_stage_tables_of_digests_take_little_disk(spark):
    rows = spark.range(0, 20_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    files = durable(rows).inputFiles()
    assert files and all(".zstd." in f for f in files)


def test_workflow_documents_are_parsed_once(spark, tmp_path):
    from tallyline.sources import documents as docs

    path = str(tmp_path / "docs")
    spark.createDataFrame([('{"schema_version":"v1","run_id":1,"envelope":{"deadline_ms":5},"tasks":[{"task_id":2,"dependencies":[1]}]}',)], "value string").write.text(path)
    good, _ = docs.read_documents(spark, path, docs.WORKFLOW, ["run_id"])
    tables = docs.workflow_tables(good)
    assert not [n for n, t in tables.items() if "from_json" in t._jdf.queryExecution().executedPlan().toString()]
    assert [tuple(r) for r in tables["task_deps"].collect()] == [(1, 2, 1)]
