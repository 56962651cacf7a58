"""Closures, levels, critical paths, greedy selection and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog.registry import query
from tallyline.catalog.sqlviews import ATTEMPTS, CLAIMS, DEPS, EVENTS, RUNS, TASKS, w
from tallyline.operators import graph as gr
from tallyline.operators import ledgers as lg
from tallyline.operators import resources as rs
from tallyline.operators import selection as sel
from tallyline.operators.scan import rlast, running

RW = lambda *views: w(*views).replace("WITH ", "WITH RECURSIVE ", 1)


def _down(spark, d):
    """Edges dependency -> task."""
    return fx.deps(spark, d).select("run_id", F.col("dep_id").alias("src"), F.col("task_id").alias("dst"))


@query("protected_closure", RW(TASKS, DEPS) + """
, p AS (SELECT run_id, task_id FROM tasks WHERE NOT optional UNION SELECT d.run_id, d.dep_id FROM p JOIN deps d ON d.run_id = p.run_id AND d.task_id = p.task_id)
SELECT run_id, task_id FROM p""")
def protected_closure(spark, d):
    up = fx.deps(spark, d).select("run_id", F.col("task_id").alias("src"), F.col("dep_id").alias("dst"))
    seeds = fx.tasks(spark, d).where("not optional").select("run_id", F.col("task_id").alias("node"))
    return gr.closure(up, seeds, ["run_id"]).withColumnRenamed("node", "task_id")


RANKS = """, walk AS (SELECT run_id, task_id, end_ms - start_ms AS len FROM tasks
  UNION SELECT d.run_id, d.dep_id, walk.len + t.end_ms - t.start_ms FROM walk JOIN deps d ON d.run_id = walk.run_id AND d.task_id = walk.task_id
  JOIN tasks t ON t.run_id = d.run_id AND t.task_id = d.dep_id)"""


def _durations(spark, d):
    return fx.tasks(spark, d).select("run_id", F.col("task_id").alias("node"), (F.col("end_ms") - F.col("start_ms")).alias("w"))


@query("upward_ranks", RW(TASKS, DEPS) + RANKS + " SELECT run_id, task_id, max(len) AS rank FROM walk GROUP BY ALL")
def upward_ranks(spark, d):
    return gr.longest_path(_durations(spark, d), _down(spark, d), ["run_id"], "w").withColumnRenamed("node", "task_id")


@query("graph_levels", RW(DEPS) + """
, e AS (SELECT run_id, dep_id AS src, task_id AS dst FROM deps UNION SELECT run_id, max(task_id), min(task_id) FROM present WHERE run_id % 71 = 0 GROUP BY run_id HAVING count(*) > 1),
wk AS (SELECT run_id, src AS node, 0 AS n FROM e UNION SELECT run_id, dst, 0 FROM e UNION SELECT e.run_id, e.dst, wk.n + 1 FROM wk JOIN e ON e.run_id = wk.run_id AND e.src = wk.node WHERE wk.n < 8),
m AS (SELECT run_id, node, max(n) AS n FROM wk GROUP BY ALL)
SELECT run_id, node AS task_id, CASE WHEN n < 8 THEN CAST(n AS BIGINT) END AS level FROM m""")
def graph_levels(spark, d):
    t = fx.attempts(spark, d).where("run_id % 71 = 0").groupBy("run_id").agg(F.max("task_id").alias("src"), F.min("task_id").alias("dst")).where("src <> dst")
    return gr.levels(_down(spark, d).unionByName(t), ["run_id"]).withColumnRenamed("node", "task_id")


@query("model_bounds", RW(TASKS, DEPS) + RANKS + """
, c AS (SELECT run_id, max(len) AS path FROM walk GROUP BY run_id),
pw AS (SELECT run_id, provider, sum(end_ms - start_ms) AS work FROM tasks GROUP BY ALL),
g AS (SELECT run_id, CAST((sum(work) + 2) // 3 AS BIGINT) AS work_bound, CAST(max((work + least(1 + provider % 4, 3) - 1) // least(1 + provider % 4, 3)) AS BIGINT) AS provider_bound FROM pw GROUP BY run_id)
SELECT run_id, path AS critical_path, work_bound, provider_bound, greatest(path, work_bound, provider_bound) AS bound FROM c JOIN g USING (run_id)""")
def model_bounds(spark, d):
    from tallyline.plans.audits import model_bounds as bounds

    t = fx.tasks(spark, d).select("*", (F.col("end_ms") - F.col("start_ms")).alias("duration"), F.lit(3).cast("long").alias("parallelism"))
    return bounds(t, _down(spark, d), fx.providers(spark, d).select("provider", "limit"))


@query("critical_path_stretch", RW(TASKS, DEPS) + RANKS + """
, c AS (SELECT run_id, max(len) AS path FROM walk GROUP BY run_id), m AS (SELECT run_id, max(end_ms) - min(start_ms) AS makespan FROM tasks GROUP BY run_id)
SELECT run_id, round(makespan / path, 6) AS stretch FROM c JOIN m USING (run_id)""")
def critical_path_stretch(spark, d):
    path = gr.critical_path(_durations(spark, d), _down(spark, d), ["run_id"], "w")
    span = fx.tasks(spark, d).groupBy("run_id").agg((F.max("end_ms") - F.min("start_ms")).alias("m"))
    return path.join(span, "run_id").select("run_id", F.round(F.col("m") / F.col("critical_path"), 6).alias("stretch"))


@query("transport_paths", RW(TASKS, DEPS) + """
, local AS (SELECT run_id, task_id, CASE WHEN context = 0 THEN 0 WHEN run_id % 37 = 0 THEN NULL ELSE (context * 8000 + 999) // 1000 END + provider % 50 AS ms FROM tasks),
walk AS (SELECT run_id, task_id, ms FROM local UNION SELECT d.run_id, d.dep_id, walk.ms + l.ms FROM walk JOIN deps d ON d.run_id = walk.run_id AND d.task_id = walk.task_id
  JOIN local l ON l.run_id = d.run_id AND l.task_id = d.dep_id)
SELECT run_id, CASE WHEN count(*) FILTER (WHERE ms IS NULL) = 0 THEN CAST(max(ms) AS BIGINT) END AS critical_path FROM walk GROUP BY run_id""")
def transport_paths(spark, d):
    wide = F.when(F.col("run_id") % 37 == 0, 0).otherwise(1000).cast("long")
    t = fx.tasks(spark, d).select("run_id", F.col("task_id").alias("node"),
                                  F.try_add(gr.transfer_ms(F.col("context"), wide), F.col("provider") % 50).alias("w"))
    return gr.critical_path(t, _down(spark, d), ["run_id"], "w")


@query("skip_cascade", RW(TASKS, DEPS) + """
, s AS (SELECT run_id, task_id FROM tasks WHERE optional AND tokens % 5 = 0),
c AS (SELECT run_id, task_id FROM s UNION SELECT d.run_id, d.task_id FROM c JOIN deps d ON d.run_id = c.run_id AND d.dep_id = c.task_id)
SELECT c.run_id, c.task_id, CASE WHEN s.task_id IS NOT NULL THEN 'skipped' WHEN NOT t.optional THEN 'required_dependency_skipped' ELSE 'dependency_skipped' END AS reason
FROM c LEFT JOIN s ON s.run_id = c.run_id AND s.task_id = c.task_id JOIN tasks t ON t.run_id = c.run_id AND t.task_id = c.task_id""")
def skip_cascade(spark, d):
    t = fx.tasks(spark, d).withColumn("node", F.col("task_id"))
    return gr.skip_cascade(_down(spark, d), t.where("optional and tokens % 5 = 0"), t.where("not optional"), ["run_id"]).withColumnRenamed("node", "task_id")


@query("evidence_lineage", RW(CLAIMS) + """
, e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0 UNION SELECT doc_id, doc_id // 3 FROM documents WHERE doc_id % 5 = 0 AND doc_id > 0),
c AS (SELECT evidence AS node FROM claims UNION SELECT e.dst FROM c JOIN e ON e.src = c.node)
SELECT node FROM c""")
def evidence_lineage(spark, d):
    i = F.col("doc_id")
    a = fx.table(spark, d, "documents").where("doc_id > 0")
    one = F.lit(1).alias("space")
    e = a.select(one, i.alias("src"), F.expr("doc_id div 2").alias("dst")).unionByName(
        a.where("doc_id % 5 = 0").select(one, i.alias("src"), F.expr("doc_id div 3").alias("dst")))
    seeds = fx.claims(spark, d).select(one, F.explode("evidence").alias("node"))
    return gr.closure(e, seeds, ["space"]).select("node")


@query("pack_context", """WITH RECURSIVE b AS (
  SELECT lang AS ctx, doc_id AS ref, n_chars AS bytes, n_chars // 4 AS tokens, doc_id % 97 AS value, doc_id % 250 = 0 AS mandatory,
    CASE WHEN doc_id % 250 = 0 THEN true ELSE doc_id % 11 <> 0 END AS valid FROM documents),
g AS (SELECT ctx, sum(CASE WHEN mandatory THEN bytes ELSE 0 END) AS mb, sum(CASE WHEN mandatory THEN tokens ELSE 0 END) AS mt FROM b GROUP BY ctx),
c AS (SELECT ctx, (CASE ctx WHEN 'en' THEN 60000 WHEN 'es' THEN 10 ELSE 30000 END) - mb AS cb, (CASE ctx WHEN 'en' THEN 14000 ELSE 12000 END) - mt AS ct FROM g),
o AS (SELECT b.*, cb, ct, row_number() OVER (PARTITION BY b.ctx ORDER BY -(value::DOUBLE / greatest(1, bytes + 4 * tokens)), -value, bytes, tokens, ref) AS r
      FROM b JOIN c ON b.ctx = c.ctx WHERE cb >= 0 AND ct >= 0 AND NOT mandatory AND valid),
f AS (SELECT ctx, ref, r, bytes <= cb AND tokens <= ct AS inc, CASE WHEN bytes <= cb AND tokens <= ct THEN bytes ELSE 0 END AS ub, CASE WHEN bytes <= cb AND tokens <= ct THEN tokens ELSE 0 END AS ut FROM o WHERE r = 1
  UNION ALL SELECT o.ctx, o.ref, o.r, f.ub + o.bytes <= cb AND f.ut + o.tokens <= ct, f.ub + CASE WHEN f.ub + o.bytes <= cb AND f.ut + o.tokens <= ct THEN o.bytes ELSE 0 END,
    f.ut + CASE WHEN f.ub + o.bytes <= cb AND f.ut + o.tokens <= ct THEN o.tokens ELSE 0 END FROM f JOIN o ON o.ctx = f.ctx AND o.r = f.r + 1)
SELECT b.ctx, b.ref, CASE WHEN mandatory AND (cb < 0 OR ct < 0) THEN 'required_context_exceeds_cap' WHEN mandatory THEN 'mandatory' WHEN cb < 0 OR ct < 0 THEN 'not_evaluated_after_refusal'
  WHEN NOT valid THEN 'optional_block_invalid' WHEN inc THEN 'selected_by_value_density' ELSE 'does_not_fit' END AS reason, mandatory AND cb >= 0 AND ct >= 0 OR coalesce(inc, false) AS included
FROM b JOIN c ON b.ctx = c.ctx LEFT JOIN f ON f.ctx = b.ctx AND f.ref = b.ref""")
def pack_context(spark, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    must = i % 250 == 0
    b = fx.table(spark, d, "documents").select(
        F.col("lang").alias("ctx"), i.alias("ref"), n.alias("bytes"), F.expr("n_chars div 4").alias("tokens"), (i % 97).alias("value"),
        must.alias("mandatory"), F.when(must, True).otherwise(i % 11 != 0).alias("valid"))
    c = F.col("ctx")
    budgets = b.select("ctx").distinct().select(
        "ctx", F.when(c == "en", 60000).when(c == "es", 10).otherwise(30000).cast("long").alias("max_bytes"), F.when(c == "en", 14000).otherwise(12000).cast("long").alias("max_tokens"))
    return sel.pack_context(b, budgets, "ctx")


@query("shed_optional", RW(TASKS, DEPS, RUNS) + """
, o AS (SELECT t.run_id, t.task_id, t.cost AS use, t.tokens AS value, r.cost_cap // 4 AS headroom, row_number() OVER (PARTITION BY t.run_id ORDER BY t.tokens DESC, t.task_id) AS r
        FROM tasks t JOIN runs r USING (run_id) WHERE t.optional OR t.task_id % 2 = 0),
f AS (SELECT run_id, task_id, r, use <= headroom AS fits, CASE WHEN use <= headroom THEN use ELSE 0 END AS used FROM o WHERE r = 1
  UNION ALL SELECT o.run_id, o.task_id, o.r, f.used + o.use <= o.headroom, f.used + CASE WHEN f.used + o.use <= o.headroom THEN o.use ELSE 0 END FROM f JOIN o ON o.run_id = f.run_id AND o.r = f.r + 1),
gone AS (SELECT run_id, task_id FROM f WHERE NOT fits UNION SELECT d.run_id, d.task_id FROM gone g JOIN deps d ON d.run_id = g.run_id AND d.dep_id = g.task_id JOIN f ON f.run_id = d.run_id AND f.task_id = d.task_id)
SELECT f.run_id, f.task_id, fits, fits AND g.task_id IS NULL AS kept FROM f LEFT JOIN gone g ON g.run_id = f.run_id AND g.task_id = f.task_id""")
def shed_optional(spark, d):
    t = fx.tasks(spark, d).where("optional or task_id % 2 = 0").join(fx.runs(spark, d).select("run_id", "cost_cap"), "run_id")
    t = t.select("run_id", "task_id", F.col("tokens").alias("value"), F.col("cost").alias("use"), F.expr("cost_cap div 4").alias("headroom"))
    return sel.shed_optional(t, fx.deps(spark, d), "run_id")


@query("conservation_rows", RW(EVENTS) + """
, x AS (SELECT run_id, sequence, CASE WHEN kind IN ('signup', 'view') THEN units ELSE 0 END AS r,
          CASE WHEN kind = 'purchase' THEN units ELSE 0 END AS a, CASE WHEN kind = 'click' THEN units // 2 ELSE 0 END AS l FROM ev),
f AS (SELECT run_id, CAST(0 AS BIGINT) AS sequence, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS spent, false AS viol FROM x GROUP BY run_id
  UNION ALL SELECT x.run_id, x.sequence, f.held + r - CASE WHEN a + l > f.held + r THEN 0 ELSE a + l END, f.spent + a, a + l > f.held + r FROM f JOIN x ON x.run_id = f.run_id AND x.sequence = f.sequence + 1)
SELECT run_id, sequence, 'resource_conservation_violation' AS code FROM f WHERE viol
UNION ALL SELECT run_id, sequence, 'resource_cap_exceeded' FROM f WHERE sequence > 0 AND spent + held > 1500
UNION ALL SELECT run_id, max(sequence), 'resource_leak' FROM f GROUP BY run_id HAVING arg_max(held, sequence) <> 0""")
def conservation_rows(spark, d):
    from tallyline.catalog.events import _movements

    return lg.conservation_rows(_movements(spark, d), ["run_id"], "sequence", "cap")


def _ops(spark, d):
    k = F.col("kind")
    op = F.when(k.isin("signup", "view"), "reserve").when(k == "purchase", "settle").when(k == "click", "cancel").otherwise("audit")
    u = F.col("units")
    return fx.events(spark, d).select(
        F.col("run_id").alias("ledger"), F.col("sequence").alias("seq"), (F.col("k") % 20).alias("attempt_id"), op.alias("operation"),
        F.when((op == "reserve") & (u % 17 != 0), u).alias("res_units"), F.when((op == "settle") & (u % 13 != 0), F.expr("units div 2")).alias("act_units"),
        F.lit(220).cast("long").alias("cap"))


LEDGER = RW(EVENTS) + """
, o AS (SELECT run_id AS ledger, sequence AS seq, CAST(k % 20 AS BIGINT) AS att, CASE kind WHEN 'signup' THEN 'reserve' WHEN 'view' THEN 'reserve' WHEN 'purchase' THEN 'settle' WHEN 'click' THEN 'cancel' ELSE 'audit' END AS op,
   CASE WHEN kind IN ('signup', 'view') AND units % 17 <> 0 THEN units END AS res, CASE WHEN kind = 'purchase' AND units % 13 <> 0 THEN units // 2 END AS act FROM ev),
f AS (SELECT ledger, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS spent, [-1::BIGINT FOR i IN range(20)] AS active, [false FOR i IN range(20)] AS term, CAST(NULL AS VARCHAR) AS reason, false AS applied FROM o GROUP BY ledger
  UNION ALL
  SELECT ledger, seq, spent + CASE WHEN applied AND op = 'settle' THEN act ELSE 0 END,
    [CASE WHEN i = att AND applied THEN CASE WHEN op = 'reserve' THEN res ELSE -1 END ELSE active[i + 1] END FOR i IN range(20)],
    [CASE WHEN i = att AND (reason = 'capacity_exceeded' OR (applied AND op <> 'reserve')) THEN true ELSE term[i + 1] END FOR i IN range(20)], reason, applied
  FROM (SELECT *, reason IS NULL AS applied FROM (
    SELECT o.ledger, o.seq, o.att, o.op, o.res, o.act, f.spent, f.active, f.term,
     CASE WHEN op = 'audit' THEN 'unknown_operation'
      WHEN op = 'reserve' AND res IS NULL THEN 'malformed_input' WHEN op = 'settle' AND act IS NULL THEN 'malformed_input'
      WHEN op = 'reserve' AND (active[att + 1] >= 0 OR term[att + 1]) THEN 'identity_conflict'
      WHEN op = 'reserve' AND f.spent + list_sum(list_filter(active, lambda v: v >= 0)) + res > 220 THEN 'capacity_exceeded'
      WHEN op = 'reserve' AND f.spent + res > 220 THEN 'capacity_exceeded'
      WHEN op <> 'reserve' AND active[att + 1] < 0 THEN CASE WHEN term[att + 1] THEN 'terminal_attempt' ELSE 'unknown_attempt' END
      WHEN op = 'settle' AND act > active[att + 1] THEN 'actual_over_reservation' END AS reason
    FROM f JOIN o ON o.ledger = f.ledger AND o.seq = f.seq + 1)))"""


@query("ledger_replay", LEDGER + """
SELECT ledger, seq, applied, reason, spent AS spent_units, CAST(coalesce(list_sum(list_filter(active, lambda v: v >= 0)), 0) AS BIGINT) AS held_units FROM f WHERE seq > 0""")
def ledger_replay(spark, d):
    return lg.replay_ledger(_ops(spark, d), "ledger", ["units"], ["cap"]).select("ledger", "seq", "applied", "reason", "spent_units", "held_units")


@query("ledger_mismatches", LEDGER + """
SELECT ledger, seq, 'decision_mismatch' AS code FROM f WHERE seq > 0 AND seq % 29 = 0 UNION ALL SELECT ledger, seq, 'post_snapshot_mismatch' FROM f WHERE seq > 0 AND seq % 31 = 0""")
def ledger_mismatches(spark, d):
    """Recorded outcomes are the replayed ones with planted differences."""
    s = F.col("seq")
    r = lg.replay_ledger(_ops(spark, d), "ledger", ["units"], ["cap"])
    r = r.select("*", F.when(s % 29 == 0, ~F.col("applied")).otherwise(F.col("applied")).alias("rec_applied"), F.col("reason").alias("rec_reason"),
                 F.when(s % 31 == 0, F.col("spent_units") + 1).otherwise(F.col("spent_units")).alias("rec_spent_units"), F.col("held_units").alias("rec_held_units"))
    return lg.ledger_mismatches(r, "ledger", ["units"])


@query("ledger_failures", LEDGER + f"""
, y AS (SELECT o.ledger, o.seq, o.op, lag(f.active) OVER (PARTITION BY f.ledger ORDER BY f.seq)[o.att + 1] AS before,
  last_value(o.res IGNORE NULLS) OVER (PARTITION BY o.ledger, o.att ORDER BY o.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said
  FROM f LEFT JOIN o ON o.ledger = f.ledger AND o.seq = f.seq)
SELECT ledger, seq, 'invalid_event_id' AS code FROM o WHERE seq % 41 = 0 UNION ALL SELECT ledger, seq, 'duplicate_event_id' FROM o WHERE seq % 41 = 0
UNION ALL SELECT ledger, seq, 'unknown_operation' FROM o WHERE op = 'audit'
UNION ALL SELECT ledger, seq, 'reservation_mismatch' FROM y WHERE op <> 'reserve' AND said IS DISTINCT FROM (CASE WHEN before >= 0 THEN before END)
UNION ALL SELECT ledger, seq, 'decision_mismatch' FROM f WHERE seq > 0 AND seq % 29 = 0 UNION ALL SELECT ledger, seq, 'post_snapshot_mismatch' FROM f WHERE seq > 0 AND seq % 31 = 0
UNION ALL SELECT DISTINCT ledger, CAST(NULL AS BIGINT), 'claimed_snapshot_mismatch' FROM o WHERE ledger % 7 = 0""")
def ledger_failures(spark, d):
    """Each row that ends an attempt records what the attempt last asked for, also where that was refused or has ended."""
    s = F.col("seq")
    r = lg.replay_ledger(_ops(spark, d), "ledger", ["units"], ["cap"])
    asked = running(r, ["ledger", "attempt_id"], "seq", {"__asked": rlast(F.col("res_units"), inclusive=False)})
    name = F.concat(F.lit(lg.EVENT_PREFIX + "-"), F.lpad((s - F.when(s % 41 == 0, 1).otherwise(0)).cast("string"), 12, "0"))
    r = asked.select(
        "*", name.alias("event_id"), F.when(F.col("operation") == "reserve", F.col("res_units")).otherwise(F.col("__asked")).alias("rec_res_units"),
        F.when(s % 29 == 0, ~F.col("applied")).otherwise(F.col("applied")).alias("rec_applied"), F.col("reason").alias("rec_reason"),
        F.when(s % 31 == 0, F.col("spent_units") + 1).otherwise(F.col("spent_units")).alias("rec_spent_units"), F.col("held_units").alias("rec_held_units"))
    end = r.groupBy("ledger").agg(F.max_by(F.struct("spent_units", "held_units"), "seq").alias("e"))
    claimed = end.select("ledger", (F.col("e.spent_units") + F.when(F.col("ledger") % 7 == 0, 1).otherwise(0)).alias("spent_units"), "e.held_units")
    return lg.ledger_failures(r, "ledger", ["units"], ["cap"], claimed)


@query("quota_usage", w(EVENTS) + """
SELECT k AS provider, at_ms // 3600000 AS "window", count(*) AS calls, CAST(sum(units) AS BIGINT) AS tokens FROM ev GROUP BY ALL""")
def quota_usage(spark, d):
    e = fx.events(spark, d).withColumnRenamed("k", "provider")
    return lg.quota_usage(e, ["provider"], "at_ms", "units", 3600000)


QUOTA = RW(EVENTS) + """
, c AS (SELECT k % 5 AS provider, at_ms // 86400000 AS win, event_id AS call, event_id * 2 AS seq, units FROM ev WHERE kind IN ('view', 'click')),
s AS (SELECT k % 5 AS provider, (at_ms + 7200000) // 86400000 AS win, event_id AS call, (event_id + 40) * 2 + 1 AS seq, units - units // 3 AS unused FROM ev WHERE kind = 'view'),
t AS (SELECT provider, win, call, seq, units AS amount, true AS ask FROM c UNION ALL SELECT s.provider, s.win, s.call, s.seq, s.unused, false FROM s JOIN c USING (provider, win, call)),
r AS (SELECT *, row_number() OVER (PARTITION BY provider, win ORDER BY seq) AS n FROM t),
f AS (SELECT provider, win, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS calls, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS adm FROM r GROUP BY provider, win
  UNION ALL SELECT provider, win, n, calls + CASE WHEN ask AND ok THEN 1 ELSE 0 END, used + CASE WHEN ask AND ok THEN amount WHEN NOT ask AND ok THEN -amount ELSE 0 END, CASE WHEN ask AND ok THEN list_append(adm, call) ELSE adm END
  FROM (SELECT r.provider, r.win, r.n, f.calls, f.used, f.adm, r.ask, r.amount, r.call, CASE WHEN r.ask THEN f.calls < 20 AND f.used + r.amount <= 300 ELSE list_contains(f.adm, r.call) END AS ok
    FROM f JOIN r ON r.provider = f.provider AND r.win = f.win AND r.n = f.n + 1)),
z AS (SELECT provider, win, unnest(adm) AS call FROM (SELECT provider, win, arg_max(adm, n) AS adm FROM f GROUP BY ALL))"""


@query("quota_admission", QUOTA + """
SELECT c.provider, c.win AS "window", c.call, z.call IS NOT NULL AS admitted FROM c LEFT JOIN z ON z.provider = c.provider AND z.win = c.win AND z.call = c.call""")
def quota_admission(spark, d):
    return lg.quota_admission(*_quota(spark, d), "provider", "seq", "call", "at_ms", 86400000, 20, 300)


def _quota(spark, d):
    e = fx.events(spark, d).select((F.col("k") % 5).alias("provider"), F.col("event_id").alias("call"), "at_ms", "kind", "units")
    calls = e.where("kind in ('view', 'click')").select("provider", (F.col("call") * 2).alias("seq"), "call", "at_ms", F.col("units").alias("tokens"))
    settles = e.where("kind = 'view'").select("provider", ((F.col("call") + 40) * 2 + 1).alias("seq"), "call", (F.col("at_ms") + 7200000).alias("at_ms"),
                                             (F.col("units") - F.expr("units div 3")).alias("unused"))
    return calls, settles


@query("quota_counters", QUOTA + """
, d AS (SELECT s.provider, s.call, min(s.seq) AS seq, max(s.unused) AS unused FROM s GROUP BY ALL),
x AS (SELECT c.*, z.call IS NOT NULL AS ok, d.seq AS ended, d.unused FROM c LEFT JOIN z ON z.provider = c.provider AND z.win = c.win AND z.call = c.call
  LEFT JOIN d ON d.provider = c.provider AND d.call = c.call),
m AS (SELECT provider, p, sum(v) AS v FROM (SELECT provider, seq AS p, 1 AS v FROM x WHERE ok UNION ALL SELECT provider, ended, -1 FROM x WHERE ok AND ended IS NOT NULL) GROUP BY ALL),
pk AS (SELECT provider, CAST(max(l) AS BIGINT) AS peak_leases FROM (SELECT provider, sum(v) OVER (PARTITION BY provider ORDER BY p) AS l FROM m) GROUP BY provider),
e AS (SELECT k % 5 AS provider, event_id, kind, at_ms, max(CASE WHEN kind = 'error' THEN at_ms + units * 60000 END) OVER (PARTITION BY k % 5 ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ev),
rs AS (SELECT provider, count(*) AS n FROM e WHERE kind IN ('view', 'click') AND at_ms < r GROUP BY 1)
SELECT x.provider, count(*) FILTER (WHERE ok) AS admitted, count(*) FILTER (WHERE NOT ok) AS refused, CAST(sum(CASE WHEN ok THEN units ELSE 0 END) AS BIGINT) AS tokens,
  count(*) FILTER (WHERE ok AND ended IS NOT NULL) AS settled, CAST(sum(CASE WHEN ok AND ended IS NOT NULL THEN units - unused ELSE 0 END) AS BIGINT) AS tokens_settled,
  count(*) FILTER (WHERE ok AND ended IS NULL) AS open_leases, coalesce(any_value(rs.n), 0) AS reset_suppressed, any_value(peak_leases) AS peak_leases
FROM x JOIN pk ON pk.provider = x.provider LEFT JOIN rs ON rs.provider = x.provider GROUP BY x.provider""")
def quota_counters(spark, d):
    from tallyline.operators.events import reset_suppressed
    from tallyline.plans.audits import quota_counters as counters

    calls, settles = _quota(spark, d)
    ok = lg.quota_admission(calls, settles, "provider", "seq", "call", "at_ms", 86400000, 20, 300)
    e = fx.events(spark, d).select((F.col("k") % 5).alias("provider"), F.col("event_id").alias("call"), "at_us", "at_ms", "kind", "units")
    reset = F.when(F.col("kind") == "error", F.col("at_ms") + F.col("units") * 60000)
    late = reset_suppressed(e, ["provider"], "at_us", ["call"], "at_ms", reset, 31)
    return counters(calls, ok, settles, late)
