"""Keys of few rows are walked by one task, keys above the block in rounds: same rows either way."""
import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import graph as gr

BIG = 9223372036854775807


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def stages(monkeypatch):
    """Stage tables written by the graph operators."""
    made = []
    keep = gr.durable
    monkeypatch.setattr(gr, "durable", lambda df: made.append(1) or keep(df))
    return made


def test_rounds_do_not_follow_the_depth_of_small_graphs(spark, stages):
    runs = spark.range(3).withColumnRenamed("id", "r")
    nodes = runs.select("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("node"), F.lit(2).cast("long").alias("w"))
    edges = nodes.where("node < 39").select("r", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    assert _rows(gr.critical_path(nodes, edges, ["r"], "w")) == [(0, 80), (1, 80), (2, 80)]
    assert gr.closure(edges, nodes.where("node = 0").select("r", "node"), ["r"]).count() == 120
    assert {r.node: r.level for r in gr.levels(edges, ["r"]).collect()} == {i: i for i in range(40)}
    assert len(stages) <= 6


def test_both_ways_give_the_same_rows(spark):
    rnd = random.Random(3)
    some = lambda: rnd.choice([None, *range(7)])
    nodes = [(g, i, rnd.choice([None, 1, 5, BIG - 3]) if g % 3 == 2 else rnd.randint(1, 9)) for g in range(9) for i in range(7)]
    nodes += [(None, 1, 4), (None, 1, 4), (2, None, 4), (3, 1, 6), (3, 6, 2), (4, 0, 1), (4, 0, 8)]
    edges = [(g, some(), some()) for g in range(9) for _ in range(g + 3)] + [(None, 1, 2), (5, 1, 99), (5, 99, 2)]
    edges += [(g, a, a + 1) for g in (1, 2, 3, 4) for a in range(6)]
    seeds = [(g, rnd.randint(0, 6)) for g in range(9)] + [(None, 1), (2, None), (2, None), (6, 77)]
    n, e, s = (spark.createDataFrame(x, t) for x, t in ((nodes, "r long, node long, w long"), (edges, "r long, src long, dst long"), (seeds, "r long, node long")))
    ways = [(_rows(gr.longest_path(n, e, ["r"], "w", b)), _rows(gr.levels(e, ["r"], b)), _rows(gr.closure(e, s, ["r"], b))) for b in (gr.BLOCK, 12, 0)]
    assert ways[0] == ways[1] == ways[2]
    assert len(ways[0][0]) >= len(nodes) and any(r[2] is None for r in ways[0][0])


def test_keys_run_on_over_batches(spark):
    nodes = spark.range(4).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("node"), F.lit(1.5).alias("w")).withColumn("node", F.col("node").cast("string"))
    edges = nodes.where("node <> '49'").select("r", F.col("node").alias("src"), (F.col("node").cast("int") + 1).cast("string").alias("dst"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _rows(gr.critical_path(nodes, edges, ["r"], "w")) == [(r, 75.0) for r in range(4)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_optional_tasks_are_admitted_once(spark, monkeypatch):
    from tallyline.operators import selection as sel

    made = []
    keep = sel.durable
    monkeypatch.setattr(sel, "durable", lambda df: made.append(df.columns) or keep(df))
    tasks = spark.createDataFrame([(1, 1, 9, 5, 6), (1, 2, 8, 4, 6), (1, 3, 7, 1, 6), (1, 4, 6, 1, 6)], "run_id long, task_id long, value long, use long, headroom long")
    deps = spark.createDataFrame([(1, 3, 2)], "run_id long, task_id long, dep_id long")
    got = sel.shed_optional(tasks, deps, "run_id")
    assert _rows(got) == [(1, 1, True, True), (1, 2, False, False), (1, 3, True, False), (1, 4, False, False)]
    assert made == [["run_id", "task_id", "admitted"]]
