"""Streams over long and late logs give what the batch form gives."""

import inspect

import pandas as pd
from pyspark.sql import functions as F

from tallyline.session import fresh_dir
from tallyline.streaming import jobs, stateful
from test_streams import Handle

DAY = 86_400


def default(fn):
    return inspect.signature(fn).parameters["retain"].default


def fed(processor, batches):
    processor.init(Handle())
    return [r for b in batches for pdf in processor.handleInputRows((1,), iter([pd.DataFrame(b)]), None) for r in pdf.itertuples()]


def test_ledger_knows_old_ids():
    op = lambda seq, name, who, res: {"seq": seq, "operation": name, "attempt_id": who, "res_units": res, "act_units": None}
    rows = [op(1, "reserve", 7, 5), op(2, "cancel", 7, None)], [op(30_000_000, "reserve", 8, 5)], [op(30_000_001, "reserve", 7, 5), op(30_000_002, "cancel", 7, None)]
    assert [r.reason for r in fed(stateful._Ledger(100, default(stateful.ledger_stream)), rows)] == [None, None, None, "identity_conflict", "terminal_attempt"]


def test_quota_knows_old_calls():
    op = lambda seq, day, name, who: {"seq": seq, "at_ms": day * DAY * 1000, "op": name, "logical": who, "attempt": 0, "tokens": 1, "reset_ms": 0}
    rows = [op(1, 0, "acquire", 7), op(2, 0, "complete", 7)], [op(3, 30, "acquire", 8)], [op(4, 30, "acquire", 7)]
    lim = {"rpm": 9, "tpm": 99, "concurrency": 9}
    got = fed(stateful._Quota(lim, lim, 3_600_000, 3, 100, 1000, default(stateful.quota_admission_stream)), rows)
    assert [r.reasons for r in got] == ["", "", "", "terminal"]


def test_late_rows_are_counted_and_late_repeats_known(spark):
    path = fresh_dir(spark, "late")
    for batch in ([(1, 0)], [(2, 30 * DAY)], [(3, 31 * DAY)], [(4, 60), (1, 32 * DAY)]):
        df = spark.createDataFrame(batch, "event_id long, s long").select("event_id", F.lit(1).cast("long").alias("units"), F.timestamp_seconds("s").alias("at"))
        df.coalesce(1).write.mode("append").parquet(path)
    tail = lambda: jobs.tail(spark, path, df.schema, 1)
    assert sorted(r["event_id"] for r in jobs.drain(jobs.exactly_once(tail(), "event_id", "at"), "x2").collect()) == [1, 2, 3, 4]
    use = jobs.drain_updates(jobs.quota_stream(tail().withColumn("provider", F.lit(1)), "provider", "at", "units", "1 hour"), ["provider", "window_ms"], "x3")
    assert {r["window_ms"] // 3_600_000: r["calls"] for r in use.collect()} == {0: 2, 720: 1, 744: 1, 768: 1}
