"""Runs of few rows are dealt once and judged where they lie, longer ones by finer keys: same rows either way."""
import random

import pytest
from pyspark.sql import functions as F

from tallyline import session
from tallyline.plans import conservation as cv
from tallyline.plans import whole_run as wr
from test_whole_run import tables, tampers  # noqa: F401

C = F.col


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def plans(monkeypatch, spark):
    """Plans of the stage tables written by the audits, without broadcasts."""
    made, keep = [], session.durable
    none = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in none}
    for module in (cv, wr):
        monkeypatch.setattr(module, "durable", lambda df: made.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    for k, v in none.items():
        spark.conf.set(k, v)
    yield made
    for k, v in old.items():
        spark.conf.set(k, v)


def test_dealt_tables_are_joined_in_place(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(20)]), rnd.randint(0, 3), i) for i in range(300)]
    a = session.dealt(spark.createDataFrame(rows, "k long, x long, a long"), "k")
    b = session.dealt(spark.createDataFrame(rows[::7], "k long, x long, b long"), "k")
    old = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with session.in_place(spark):
        joined = a.hint("merge").join(b.hint("merge"), ["k", "x"], "left").groupBy("k", "x").agg(F.count("b").alias("n"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        got = {(r.k, r.x): r.n for r in joined.collect()}
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == old
    pairs = {(k, x) for k, x, _ in rows}
    assert got == {(k, x): 0 if k is None else sum(r[:2] == (k, x) for r in rows) * sum(r[:2] == (k, x) for r in rows[::7]) for k, x in pairs}


def test_keys_are_parted_by_all_their_rows(spark):
    a, b = (spark.createDataFrame(x, "k long, v long") for x in ([(1, 1), (1, 2), (2, 3), (None, 4), (None, 5), (None, 6)], [(1, 7), (2, 8)]))
    small, big = session.by_size([a, b], "k", 2)
    assert [_rows(x) for x in small] == [[(2, 3), (None, 4), (None, 5), (None, 6)], [(2, 8)]]
    assert [_rows(x) for x in big] == [[(1, 1), (1, 2)], [(1, 7)]]
    assert session.by_size([a, b], "k", 9)[1] is None


def test_audit_of_a_run_shuffles_little(tables, plans):  # noqa: F811
    ids, t = tables
    t = dict(t)
    for (code, (table, column, where, value)), run in zip(tampers().items(), ids):
        t[table] = t[table].withColumn(column, F.when((C("run_id") == run) & where, value).otherwise(C(column)))
    lying = _rows(wr.verify_whole_run(t))
    assert plans and max(p.count("Exchange hashpartitioning") for p in plans) <= 15
    assert lying and _rows(wr.verify_whole_run(t, 30)) == lying


def _schedules(spark, rnd):
    make = spark.createDataFrame
    run, task, prof, dep, ent, ev, skip = [], [], [], [], [], [], []
    for r in range(24):
        n, seq = rnd.randint(1, 5), 1
        ev.append((r, 1, 0, "run.started", None))
        for i in range(1, n + 1):
            s, odd = rnd.randint(0, 9), rnd.random() < 0.1
            e = s + rnd.randint(0, 9)
            task.append((r, i, i % 2 == 0, 0.5, None, rnd.choice(["x", "y", None]), rnd.random() < 0.5))
            prof.append((r, i, "p", i, e - s, i, 1, 1, 0.9, 0.01 if not odd else 0.2))
            for j in range(1 if rnd.random() < 0.9 else 2):
                ent.append((r, i + 9 * (rnd.random() < 0.03), "p", i, s, e, "completed" if rnd.random() < 0.9 else "cancelled", i % 2 == 0, i, 1, 1, 0.99))
            for kind, at in (("profile.selected", s), ("task.started", s), ("task.completed", e)):
                seq += 1
                ev.append((r, seq, at, kind, i))
            if i > 1:
                dep.append((r, i, i - 1))
            if rnd.random() < 0.1:
                skip.append((r, i))
        run.append((r, rnd.random() < 0.8, 18, sum(range(n + 1)), n, n, 0.99 ** n, 5, 17, 9, 9, 9, 2, 0.9))
    run.append((None, True, 1, 1, 1, 1, 1.0, 1, 1, 1, 1, 1, 1, 0.5))
    ev.append((None, 1, 0, "run.started", None))
    return [
        make(run, "run_id long, success boolean, makespan long, total_tokens long, total_cost long, total_context long, success_probability double, model_bound long, deadline_ms long, "
                  "max_tokens long, max_cost long, max_context long, max_parallelism long, success_floor double"),
        make(task, "run_id long, task_id long, optional boolean, min_quality double, deadline_ms long, resource string, writes boolean"),
        make(prof, "run_id long, task_id long, name string, provider long, p95 long, tokens long, cost long, context long, quality double, failure double"),
        make(dep, "run_id long, task_id long, dep_id long"),
        make(ent, "run_id long, task_id long, backend string, provider long, start_ms long, end_ms long, outcome string, optional boolean, tokens long, cost long, context long, probability double"),
        make(ev, "run_id long, sequence long, at long, kind string, task_id long"), make(skip, "run_id long, task_id long"),
        make([(i, 1 + i % 2) for i in range(6)], "provider long, limit long")]


def test_conservation_of_a_run_shuffles_little(spark, plans):
    given = _schedules(spark, random.Random(8))
    lying = _rows(cv.conservation_report(*given))
    assert plans and max(p.count("Exchange hashpartitioning") for p in plans) <= 20
    assert len(lying) == 25 * len(cv.CHECKS) and {r[2] for r in lying} == {True, False}
    assert _rows(cv.conservation_report(*given, 20)) == lying
