"""Streams over the event log, each drained to a table and compared with its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog.graphs import LEDGER, _ops
from tallyline.catalog.registry import query
from tallyline.catalog.sqlviews import EVENTS, w
from tallyline.session import durable, fresh_dir
from tallyline.streaming import jobs, stateful

PARTS = 3


def _log(spark, df, order: str):
    """Write a log in ``PARTS`` ordered appends and tail it one append at a time."""
    path = fresh_dir(spark, "tail")
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    width = (hi - lo) // PARTS + 1
    for i in range(PARTS):
        df.where(F.col(order).between(lo + i * width, lo + (i + 1) * width - 1)).write.mode("append").parquet(path)
    return jobs.tail(spark, path, df.schema)


def _events(spark, d):
    return fx.events(spark, d).select("run_id", "sequence", "event_id", "at_ms", "at_us", "kind", "units", "k", F.timestamp_micros("at_us").alias("at"))


@query("stream_tail", w(EVENTS) + " SELECT run_id, sequence, event_id, kind FROM ev")
def stream_tail(spark, d):
    return jobs.drain(_log(spark, _events(spark, d).select("run_id", "sequence", "event_id", "kind"), "event_id"), "tail-out")


@query("stream_exactly_once", "SELECT event_id FROM events")
def stream_exactly_once(spark, d):
    e = _events(spark, d)
    again = e.unionByName(e.where("event_id % 7 = 0")).select("event_id", "at", "at_us")
    return jobs.drain(jobs.exactly_once(_log(spark, again, "at_us"), "event_id", "at"), "once").select("event_id")


@query("stream_append_outcomes", w(EVENTS) + """
, x AS (SELECT run_id, event_id, at_us * 4 AS pos, at_ms, 'accepted' AS outcome FROM ev
  UNION ALL SELECT run_id, event_id, at_us * 4 + 1, at_ms, 'repeat' FROM ev WHERE event_id % 7 = 0
  UNION ALL SELECT run_id, event_id, at_us * 4 + 2, at_ms, 'conflict' FROM ev WHERE event_id % 11 = 0
  UNION ALL SELECT run_id, event_id + 1000000000, at_us * 4 + 3, at_ms - 172800000, NULL FROM ev WHERE event_id % 13 = 0)
SELECT run_id, event_id, pos, coalesce(outcome, CASE WHEN at_ms < max(at_ms) FILTER (WHERE outcome = 'accepted') OVER (PARTITION BY run_id ORDER BY pos) - 86400000
  THEN 'late' ELSE 'accepted' END) AS outcome FROM x""")
def stream_append_outcomes(spark, d):
    """The log with repeats, changed repeats and new ids two days late, where a day is waited for."""
    e = _events(spark, d)
    row = lambda k, at, what: ((F.col("at_us") * 4 + k).alias("pos"), at.alias("at_ms"), F.sha2(what.cast("string"), 256).alias("digest"))
    at, units = F.col("at_ms"), F.col("units")
    rows = e.select("run_id", "event_id", *row(0, at, units)).unionByName(
        e.where("event_id % 7 = 0").select("run_id", "event_id", *row(1, at, units))).unionByName(
        e.where("event_id % 11 = 0").select("run_id", "event_id", *row(2, at, units + 1))).unionByName(
        e.where("event_id % 13 = 0").select("run_id", (F.col("event_id") + 1000000000).alias("event_id"), *row(3, at - 172800000, units)))
    return jobs.drain(stateful.append_outcomes(_log(spark, rows, "pos"), 86400000), "outcomes")


@query("stream_quota_usage", w(EVENTS) + """
SELECT k AS provider, at_ms // 3600000 * 3600000 AS window_ms, count(*) AS calls, CAST(sum(units) AS BIGINT) AS tokens FROM ev GROUP BY ALL""")
def stream_quota_usage(spark, d):
    s = _log(spark, _events(spark, d).withColumnRenamed("k", "provider"), "at_us")
    return jobs.drain_updates(jobs.quota_stream(s, "provider", "at", "units", "1 hour"), ["provider", "window_ms"], "usage")


@query("stream_late_events", w(EVENTS) + """
, x AS (SELECT run_id, sequence, CASE WHEN event_id % 101 = 0 THEN at_ms - 86400000 ELSE at_ms END AS at_ms FROM ev),
y AS (SELECT *, max(at_ms) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_mark FROM x)
SELECT run_id, sequence, at_ms, high_mark FROM y WHERE at_ms < high_mark""")
def stream_late_events(spark, d):
    e = _events(spark, d).withColumn("at_ms", F.when(F.col("event_id") % 101 == 0, F.col("at_ms") - 86400000).otherwise(F.col("at_ms")))
    return jobs.drain(stateful.late_events(_log(spark, e, "at_us")), "late")


@query("stream_ledger", LEDGER + """
SELECT ledger, seq, applied, reason, spent AS spent_units, CAST(coalesce(list_sum(list_filter(active, lambda v: v >= 0)), 0) AS BIGINT) AS held_units FROM f WHERE seq > 0""")
def stream_ledger(spark, d):
    ops = _ops(spark, d).drop("cap")
    return jobs.drain(stateful.ledger_stream(_log(spark, ops, "seq"), 220), "ledger")


@query("stream_quota_admission")
def stream_quota_admission(spark, d):
    """Calls acquire, and each is settled 40 events later: completed, failed or rate limited."""
    k = F.col("k")
    e = _events(spark, d)
    ask = e.select((k % 7).alias("provider"), (F.col("event_id") * 2).alias("seq"), "at_ms", F.lit("acquire").alias("op"), F.col("event_id").alias("logical"),
                   F.lit(0).cast("long").alias("attempt"), F.col("units").alias("tokens"), F.lit(0).cast("long").alias("reset_ms"))
    op = F.when(F.col("kind") == "error", "limited").when(F.col("kind") == "click", "fail").otherwise("complete")
    end = e.select((k % 7).alias("provider"), ((F.col("event_id") + 40) * 2 + 1).alias("seq"), (F.col("at_ms") + 7200000).alias("at_ms"), op.alias("op"),
                   F.col("event_id").alias("logical"), F.lit(0).cast("long").alias("attempt"), F.expr("units div 2").alias("tokens"), F.lit(600000).cast("long").alias("reset_ms"))
    retry = e.where("kind = 'click'").select((k % 7).alias("provider"), ((F.col("event_id") + 60) * 2 + 1).alias("seq"), (F.col("at_ms") + 10800000).alias("at_ms"),
                                             F.lit("acquire").alias("op"), F.col("event_id").alias("logical"), F.lit(1).cast("long").alias("attempt"),
                                             F.col("units").alias("tokens"), F.lit(0).cast("long").alias("reset_ms"))
    rows = ask.unionByName(end).unionByName(retry)
    limits = {"rpm": 9, "tpm": 360, "concurrency": 6}, {"rpm": 8, "tpm": 420, "concurrency": 8}
    return jobs.drain(stateful.quota_admission_stream(_log(spark, rows, "seq"), *limits, width=3600000), "quota")


@query("stream_unknown_inflight", w(EVENTS) + """
, x AS (SELECT run_id, event_id AS task_id, units, at_ms FROM ev WHERE kind = 'view'), wm AS (SELECT max(at_ms) - 3600000 AS m FROM ev)
SELECT run_id, task_id, units AS charged, at_ms + 7200000 AS due_ms FROM x, wm WHERE task_id % 3 <> 0 AND at_ms + 7200000 < m""")
def stream_unknown_inflight(spark, d):
    """Views dispatch work; two thirds of it is never settled.  Other events only move the clock."""
    e = _events(spark, d)
    live = durable(e.select("run_id", F.col("event_id").alias("task_id"), F.when(F.col("kind") == "view", "dispatch").otherwise("tick").alias("op"), "units", "at_ms", "at", "at_us"))
    done = live.where("op = 'dispatch' and task_id % 3 = 0").withColumns({
        "op": F.lit("settle"), "at_ms": F.col("at_ms") + 1800000, "at": F.col("at") + F.expr("interval 30 minutes"), "at_us": F.col("at_us") + 1800000000})
    top = live.agg(F.max("at_us")).first()[0]
    rows = live.unionByName(done.where(F.col("at_us") <= top))
    return jobs.drain(stateful.unknown_inflight(_log(spark, rows, "at_us"), "at", "1 hour", 7200000), "unknown")


@query("stream_status", w(EVENTS) + """
SELECT run_id, coalesce(arg_max(kind, sequence) FILTER (WHERE kind IN ('purchase', 'error')), 'running') AS state, count(*) AS events,
  CAST(sum(CASE WHEN kind IN ('purchase', 'error') THEN units ELSE 0 END) AS BIGINT) AS units FROM ev GROUP BY run_id""")
def stream_status(spark, d):
    s = jobs.status_stream(_log(spark, _events(spark, d), "at_us"), "run_id", "sequence", "kind", ["purchase", "error"])
    return jobs.drain_updates(s, ["run_id"], "status")


@query("stream_circuit", w(EVENTS) + """
, x AS (SELECT run_id, sequence, kind, at_ms, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY sequence) AS failures FROM ev)
SELECT run_id, sequence, CAST(failures AS BIGINT) AS failures, at_ms + 60000 AS until_ms FROM x WHERE kind = 'error' AND failures >= 5""")
def stream_circuit(spark, d):
    e = _events(spark, d).withColumn("failed", F.col("kind") == "error")
    s = stateful.circuit_stream(_log(spark, e, "at_us"), "at", "1 hour", 5, 60000)
    return jobs.drain(s, "circuit").where("state = 'opened'").drop("state")
