"""Event-log audit over the event and attempt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog.registry import query
from tallyline.catalog.sqlviews import ATTEMPTS, DEPS, EVENTS, NUMBERED, RUNS, TASKS, w
from tallyline.functions.columns import seal
from tallyline.operators import events as ev
from tallyline.operators import resources as rs
from tallyline.operators.checks import duplicates, flagged, holds, order_breaches, set_difference, transition_breaches
from tallyline.operators.scan import rlag, running


@query("sequence_breaches", w(EVENTS) + """
, x AS (SELECT run_id, event_id, sequence, CASE WHEN event_id % 101 = 0 THEN at_ms - 86400000 ELSE at_ms END AS at_ms
        FROM ev WHERE event_id % 97 <> 0),
y AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS pos,
             lag(at_ms) OVER (PARTITION BY run_id ORDER BY sequence) AS prev FROM x)
SELECT run_id, sequence, 'non_monotonic_event_sequence' AS code FROM y WHERE sequence <> pos
UNION ALL SELECT run_id, sequence, 'non_monotonic_event_time' FROM y WHERE at_ms < prev""")
def sequence_breaches(spark, d):
    e = fx.events(spark, d).where("event_id % 97 <> 0").withColumn(
        "at_ms", F.when(F.col("event_id") % 101 == 0, F.col("at_ms") - 86400000).otherwise(F.col("at_ms"))
    )
    return ev.sequence_breaches(e, ["run_id"], "sequence", "at_ms", "event_id")


@query("late_rows", w(EVENTS) + """
, x AS (SELECT run_id, sequence, CASE WHEN event_id % 101 = 0 THEN at_ms - 86400000 ELSE at_ms END AS at_ms FROM ev),
y AS (SELECT *, max(at_ms) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      AS high_mark FROM x)
SELECT run_id, sequence, at_ms, high_mark FROM y WHERE at_ms < high_mark""")
def late_rows(spark, d):
    e = fx.events(spark, d).select(
        "run_id", "sequence", "event_id",
        F.when(F.col("event_id") % 101 == 0, F.col("at_ms") - 86400000).otherwise(F.col("at_ms")).alias("at_ms"),
    )
    return ev.late_rows(e, ["run_id"], "sequence", "at_ms", "event_id").select("run_id", "sequence", "at_ms", "high_mark")


@query("turn_order", """
WITH t AS (SELECT conv_id AS run_id, turn + 1 AS sequence, role,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
                  lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT run_id, count(*) AS turns, count(*) FILTER (WHERE sequence <> pos) AS gaps,
       count(*) FILTER (WHERE role = prev) AS repeated_roles FROM t GROUP BY run_id""")
def turn_order(spark, d):
    t = fx.turns(spark, d).select("run_id", "sequence", "role", F.col("sequence").alias("at"))
    x = running(t, ["run_id"], "sequence", {"prev": rlag(F.col("role")), "prev_seq": rlag(F.col("sequence"))})
    first = F.coalesce("prev_seq", F.lit(0)) + 1
    return x.groupBy("run_id").agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("sequence") != first).alias("gaps"),
        F.count_if(F.col("role") == F.col("prev")).alias("repeated_roles"),
    )


def _chain(spark, d):
    """Sealed, chained events with planted breaks."""
    e = fx.events(spark, d).withColumn("digest", seal(["event_id", "kind", "units"]))
    e = running(e, ["run_id"], "sequence", {"before": rlag(F.col("digest"))})
    link = F.coalesce("before", F.lit(ev.GENESIS))
    return e.withColumn(
        "previous", F.when(F.col("event_id") % 103 == 0, F.lit("f" * 64)).otherwise(link)
    ).withColumn("digest", F.when(F.col("event_id") % 107 == 0, F.lit("e" * 64)).otherwise(F.col("digest")))


CHAIN = w(EVENTS) + """
, s AS (SELECT *, sha256('{"event_id":' || event_id || ',"kind":"' || kind || '","units":' || units || '}') AS seal FROM ev),
c AS (SELECT run_id, event_id, sequence, seal,
        CASE WHEN event_id % 103 = 0 THEN repeat('f', 64)
             ELSE coalesce(lag(seal) OVER (PARTITION BY run_id ORDER BY sequence), repeat('0', 64)) END AS previous,
        CASE WHEN event_id % 107 = 0 THEN repeat('e', 64) ELSE seal END AS digest FROM s)"""


@query("chain_breaks", CHAIN + """
, y AS (SELECT *, coalesce(lag(digest) OVER (PARTITION BY run_id ORDER BY sequence), repeat('0', 64)) AS want FROM c)
SELECT run_id, sequence, 'event_chain_break' AS code FROM y WHERE previous <> want
UNION ALL SELECT run_id, sequence, 'event_digest_mismatch' FROM y WHERE digest <> seal""")
def chain_breaks(spark, d):
    return ev.chain_breaks(_chain(spark, d), ["run_id"], "sequence", "digest", "previous",
                           seal(["event_id", "kind", "units"]))


@query("cause_breaks", w(EVENTS) + """
, x AS (SELECT run_id, sequence, event_id, lag(event_id) OVER (PARTITION BY run_id ORDER BY sequence) AS cause FROM ev),
c AS (SELECT run_id, sequence, event_id, CASE WHEN event_id % 89 = 0 THEN event_id + 10000000
        WHEN event_id % 61 = 0 THEN NULL WHEN sequence = 1 AND event_id % 2 = 0 THEN event_id ELSE cause END AS cause FROM x)
SELECT run_id, sequence, 'invalid_genesis_causes' AS code FROM c WHERE sequence = 1 AND cause IS NOT NULL
UNION ALL SELECT run_id, sequence, 'missing_causal_predecessor' FROM c WHERE sequence > 1 AND cause IS NULL
UNION ALL SELECT c.run_id, c.sequence, 'invalid_event_cause' FROM c LEFT JOIN ev e ON c.run_id = e.run_id AND c.cause = e.event_id
  WHERE c.cause IS NOT NULL AND NOT coalesce(e.sequence < c.sequence, false)""")
def cause_breaks(spark, d):
    e = running(fx.events(spark, d), ["run_id"], "sequence", {"before": rlag(F.col("event_id"))})
    cause = (
        F.when(F.col("event_id") % 89 == 0, F.col("event_id") + 10000000)
        .when(F.col("event_id") % 61 == 0, F.lit(None).cast("long"))
        .when((F.col("sequence") == 1) & (F.col("event_id") % 2 == 0), F.col("event_id"))
        .otherwise(F.col("before"))
    )
    e = e.select("run_id", "sequence", "event_id", F.array_compact(F.array(cause)).alias("causes"))
    return ev.cause_breaks(e, ["run_id"], "sequence", "event_id", "causes")


@query("run_lifecycle", w(EVENTS) + """
, g AS (SELECT run_id, count(*) FILTER (WHERE kind = 'signup') AS starts,
        count(*) FILTER (WHERE kind IN ('purchase', 'error')) AS terminals,
        arg_min(kind, sequence) AS first_kind, arg_max(kind, sequence) AS last_kind FROM ev GROUP BY run_id)
SELECT *, starts = 1 AND terminals = 1 AND first_kind = 'signup' AND last_kind IN ('purchase', 'error') AS passed FROM g""")
def run_lifecycle(spark, d):
    e = fx.events(spark, d)
    return ev.lifecycle(e, ["run_id"], "sequence", "kind", "at_ms", "signup", ["purchase", "error"])


@query("event_identity_shape", w(EVENTS) + """
SELECT run_id, sequence, 'invalid_event_identity_shape' AS code FROM (
  SELECT *, CASE WHEN k % 7 <> 0 THEN k END AS task, CASE WHEN k % 5 <> 0 THEN k END AS attempt FROM ev)
WHERE (kind = 'signup' AND task IS NOT NULL) OR (kind = 'purchase' AND (task IS NULL OR attempt IS NULL))
   OR (kind = 'view' AND (task IS NULL OR attempt IS NOT NULL))""")
def event_identity_shape(spark, d):
    e = fx.events(spark, d).select(
        "run_id", "sequence", "kind", F.when(F.col("k") % 7 != 0, F.col("k")).alias("task"),
        F.when(F.col("k") % 5 != 0, F.col("k")).alias("attempt"),
    )
    shapes = {"signup": ([], ["task"]), "purchase": (["task", "attempt"], []), "view": (["task"], ["attempt"])}
    return ev.identity_shape(e, ["run_id", "sequence"], "kind", shapes)


@query("duplicate_keys", """
SELECT l_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS task_id, count(*) AS copies
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return duplicates(fx.attempts(spark, d), ["run_id", "task_id"])


@query("latest_completion", w(NUMBERED) + """
SELECT run_id, task_id, attempt, profile, end_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY attempt DESC) AS n FROM numbered
  WHERE outcome = 'completed') WHERE n = 1""")
def latest_completion(spark, d):
    return ev.latest_by(fx.numbered_attempts(spark, d), ["run_id", "task_id"], "attempt",
                        F.col("outcome") == "completed", ["profile", "end_ms"])


@query("unbacked_completions", w(EVENTS) + """
, g AS (SELECT run_id, k % 10 AS task, min(sequence) FILTER (WHERE kind = 'view') AS success_at,
               min(sequence) FILTER (WHERE kind = 'purchase') AS completed_at FROM ev GROUP BY ALL)
SELECT * FROM g WHERE completed_at IS NOT NULL AND NOT coalesce(success_at < completed_at, false)""")
def unbacked_completions(spark, d):
    e = fx.events(spark, d).withColumn("task", F.col("k") % 10)
    return ev.unbacked_completions(e, ["run_id", "task"], "sequence", "kind", "view", "purchase")


@query("backoff_breaches", w(NUMBERED) + """
, x AS (SELECT run_id, task_id, attempt, start_ms - lag(end_ms) OVER (PARTITION BY run_id, task_id ORDER BY attempt) AS gap_ms
        FROM numbered)
SELECT run_id, task_id, attempt, gap_ms, least(86400000 * CAST(1 << CAST(attempt - 2 AS INT) AS BIGINT), 604800000) AS required_ms
FROM x WHERE attempt > 1 AND gap_ms < least(86400000 * CAST(1 << CAST(attempt - 2 AS INT) AS BIGINT), 604800000)""")
def backoff_breaches(spark, d):
    return ev.backoff_breaches(fx.numbered_attempts(spark, d), ["run_id", "task_id"], "attempt", "start_ms", "end_ms",
                               86400000, 604800000)


@query("retry_jitter", w(NUMBERED) + """
SELECT run_id, task_id, attempt, CAST(CAST('0x' || substr(sha256('retry-jitter:7:' || task_id || ':' || attempt), 1, 16) AS UBIGINT)
   % 251 AS BIGINT) AS jitter_ms FROM numbered WHERE outcome = 'failed'""")
def retry_jitter(spark, d):
    a = fx.numbered_attempts(spark, d).where("outcome = 'failed'")
    return a.select("run_id", "task_id", "attempt",
                    ev.retry_jitter(7, 250, F.col("task_id"), F.col("attempt")).alias("jitter_ms"))


@query("circuit_openings", w(EVENTS) + """
, x AS (SELECT run_id, kind, at_ms, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END)
          OVER (PARTITION BY run_id ORDER BY sequence) AS failures FROM ev)
SELECT run_id, min(at_ms) AS opened_at, count(*) AS openings, max(at_ms) + 60000 AS open_until
FROM x WHERE kind = 'error' AND failures >= 5 GROUP BY run_id""")
def circuit_openings(spark, d):
    return ev.circuit_openings(fx.events(spark, d), ["run_id"], "sequence", [], F.col("kind") == "error", "at_ms", 5, 60000)


@query("reset_suppressed", w(EVENTS) + """
, x AS (SELECT k, event_id, at_ms, max(CASE WHEN kind = 'error' THEN at_ms + units * 60000 END) OVER (PARTITION BY k
          ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reset_until FROM ev)
SELECT k AS provider, event_id, at_ms, reset_until FROM x WHERE at_ms < reset_until""")
def reset_suppressed(spark, d):
    e = fx.events(spark, d).select(F.col("k").alias("provider"), "event_id", "at_us", "at_ms", "kind", "units")
    reset = F.when(F.col("kind") == "error", F.col("at_ms") + F.col("units") * 60000)
    return ev.reset_suppressed(e, ["provider"], "at_us", ["event_id"], "at_ms", reset, 31).select(
        "provider", "event_id", "at_ms", "reset_until"
    )


@query("stale_fences", w(EVENTS) + """
, x AS (SELECT run_id, sequence, CASE WHEN event_id % 73 = 0 THEN sequence // 2 ELSE sequence END AS fence FROM ev),
y AS (SELECT *, max(fence) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      AS highest_seen FROM x)
SELECT * FROM y WHERE fence < highest_seen""")
def stale_fences(spark, d):
    e = fx.events(spark, d)
    fence = F.when(F.col("event_id") % 73 == 0, F.expr("sequence div 2")).otherwise(F.col("sequence"))
    return ev.stale_fences(e.select("run_id", "sequence", fence.alias("fence")), ["run_id"], "sequence", "fence")


# Legal steps of an effect.
EFFECT_STEPS = {
    "proposed": ["prepared", "aborted"],
    "prepared": ["approved", "committed", "ambiguous", "aborted"],
    "approved": ["committed", "ambiguous", "aborted"],
    "ambiguous": ["committed", "aborted"],
    "committed": ["compensated"],
}


@query("illegal_transitions", w(EVENTS) + """
, x AS (SELECT run_id, event_id, sequence, CASE kind WHEN 'signup' THEN 'proposed' WHEN 'view' THEN 'prepared' WHEN 'click' THEN 'approved'
          WHEN 'purchase' THEN 'committed' ELSE 'ambiguous' END AS state FROM ev),
y AS (SELECT run_id, sequence, state, lag(state) OVER (PARTITION BY run_id ORDER BY sequence) AS previous_state FROM x)
SELECT run_id, sequence, previous_state, state FROM y
WHERE NOT coalesce((previous_state IS NULL AND state = 'proposed')
   OR (previous_state = 'proposed' AND state IN ('prepared', 'aborted'))
   OR (previous_state = 'prepared' AND state IN ('approved', 'committed', 'ambiguous', 'aborted'))
   OR (previous_state = 'approved' AND state IN ('committed', 'ambiguous', 'aborted'))
   OR (previous_state = 'ambiguous' AND state IN ('committed', 'aborted'))
   OR (previous_state = 'committed' AND state = 'compensated'), false)""")
def illegal_transitions(spark, d):
    k = F.col("kind")
    state = (
        F.when(k == "signup", "proposed").when(k == "view", "prepared").when(k == "click", "approved")
        .when(k == "purchase", "committed").otherwise("ambiguous")
    )
    e = fx.events(spark, d).select("run_id", "sequence", state.alias("state"))
    x = ev.previous_state(e, ["run_id"], "sequence", "state")
    return transition_breaches(x, "state", "previous_state", EFFECT_STEPS, ["proposed"]).select(
        "run_id", "sequence", "previous_state", "state"
    )


@query("replay_conflicts", w(EVENTS) + """
, r AS (SELECT event_id AS key, sequence, units FROM ev
  UNION ALL SELECT event_id, sequence + 1000000, CASE WHEN event_id % 2 = 0 THEN units ELSE units + 1 END FROM ev WHERE event_id % 83 = 0),
s AS (SELECT key, sequence, sha256('{"key":' || key || ',"units":' || units || '}') AS digest FROM r),
f AS (SELECT *, first_value(digest) OVER (PARTITION BY key ORDER BY sequence) AS fd FROM s)
SELECT key, fd AS first_digest, min(sequence) AS first_seq, count(*) FILTER (WHERE digest = fd) - 1 AS duplicates,
       count(*) FILTER (WHERE digest <> fd) AS conflicts FROM f GROUP BY key, fd""")
def replay_conflicts(spark, d):
    e = fx.events(spark, d).select(F.col("event_id").alias("key"), "sequence", "units")
    again = e.where("key % 83 = 0").select(
        "key", (F.col("sequence") + 1000000).alias("sequence"),
        F.when(F.col("key") % 2 == 0, F.col("units")).otherwise(F.col("units") + 1).alias("units"),
    )
    rows = e.unionByName(again).withColumn("digest", seal(["key", "units"]))
    return ev.replay_conflicts(rows, ["key"], "digest", "sequence")


@query("cumulative_state", w(EVENTS) + """
SELECT run_id, sequence,
  CAST(sum(CASE kind WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 WHEN 'error' THEN -1 ELSE 0 END) OVER o AS BIGINT) AS active,
  CAST(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER o AS BIGINT) AS completed,
  CAST(sum(CASE WHEN kind IN ('purchase', 'error') THEN units ELSE 0 END) OVER o AS BIGINT) AS units_so_far
FROM ev WINDOW o AS (PARTITION BY run_id ORDER BY sequence)""")
def cumulative_state(spark, d):
    k = F.col("kind")
    x = ev.cumulative_state(fx.events(spark, d), ["run_id"], "sequence", [], k == "signup",
                            k.isin("purchase", "error"), k == "purchase", ["units"], k.isin("purchase", "error"))
    return x.select("run_id", "sequence", "active", "completed", "units_so_far")


@query("growing_caps", w(EVENTS) + """
, x AS (SELECT run_id, sequence, 1000 - sequence + CASE WHEN event_id % 73 = 0 THEN 50 ELSE 0 END AS cap FROM ev)
SELECT run_id, sequence, 'cap_increased' AS code FROM (
  SELECT *, lag(cap) OVER (PARTITION BY run_id ORDER BY sequence) AS p FROM x) WHERE cap > p""")
def growing_caps(spark, d):
    extra = F.when(F.col("event_id") % 73 == 0, 50).otherwise(0)
    e = fx.events(spark, d).select("run_id", "sequence", (1000 - F.col("sequence") + extra).alias("cap"))
    return ev.growing_caps(e, ["run_id"], "sequence", ["cap"])


@query("reservation_overruns", w(NUMBERED) + """
SELECT run_id, task_id, attempt, 'tokens_over_reservation' AS code FROM numbered WHERE run_id % 79 = 0
UNION ALL SELECT run_id, task_id, attempt, 'cost_over_reservation' FROM numbered WHERE run_id % 79 = 0 AND task_id > 3""")
def reservation_overruns(spark, d):
    hit = F.col("run_id") % 79 == 0
    a = fx.numbered_attempts(spark, d).withColumns({
        "actual_tokens": F.col("tokens") + F.when(hit, 1).otherwise(0),
        "actual_cost": F.col("cost") + F.when(hit & (F.col("task_id") > 3), 1).otherwise(0),
    })
    return ev.overruns(a, ["run_id", "task_id", "attempt"],
                       {"tokens": ("actual_tokens", "tokens"), "cost": ("actual_cost", "cost")})


@query("first_overspend", w(EVENTS) + """
, x AS (SELECT run_id, sequence, CASE WHEN kind IN ('signup', 'view') THEN units ELSE 0 END AS r,
          CASE WHEN kind = 'purchase' THEN units ELSE 0 END AS a, CASE WHEN kind = 'click' THEN units // 2 ELSE 0 END AS l FROM ev),
y AS (SELECT run_id, sequence, sum(r - a - l) OVER o AS held, sum(a) OVER o AS spent FROM x WINDOW o AS (PARTITION BY run_id ORDER BY sequence)),
g AS (SELECT run_id, min(sequence) FILTER (WHERE held < 0) AS c, min(sequence) FILTER (WHERE spent + held > 1500) AS p,
             arg_max(held, sequence) AS last FROM y GROUP BY run_id)
SELECT run_id, least(c, p) AS first_breach_at, CASE WHEN c = least(c, p) THEN 'resource_conservation_violation'
   WHEN p = least(c, p) THEN 'resource_cap_exceeded' END AS code,
   CASE WHEN least(c, p) IS NULL THEN CAST(last AS BIGINT) END AS left_open FROM g""")
def first_overspend(spark, d):
    return ev.first_overspend(_movements(spark, d), ["run_id"], "sequence", "reserved", "actual", "released", "cap")


def _movements(spark, d):
    k = F.col("kind")
    zero = F.lit(0).cast("long")
    return fx.events(spark, d).select(
        "run_id", "sequence",
        F.when(k.isin("signup", "view"), F.col("units")).otherwise(zero).alias("reserved"),
        F.when(k == "purchase", F.col("units")).otherwise(zero).alias("actual"),
        F.when(k == "click", F.expr("units div 2")).otherwise(zero).alias("released"),
        F.lit(1500).cast("long").alias("cap"),
    )


@query("control_state", w(EVENTS) + """
SELECT run_id, max(sequence) FILTER (WHERE kind = 'view') AS sequence, arg_max(units, sequence) FILTER (WHERE kind = 'view') AS capacity
FROM ev WHERE sequence <= 40 GROUP BY run_id HAVING count(*) FILTER (WHERE kind = 'view') > 0""")
def control_state(spark, d):
    e = fx.events(spark, d).where("sequence <= 40").withColumn("capacity", F.col("units"))
    return ev.latest_by(e, ["run_id"], "sequence", F.col("kind") == "view", ["capacity"])


@query("control_state_timeline", w(EVENTS) + """
SELECT run_id, sequence, last_value(CASE WHEN kind = 'view' THEN units END IGNORE NULLS) OVER (PARTITION BY run_id
   ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capacity FROM ev""")
def control_state_timeline(spark, d):
    e = fx.events(spark, d).select("run_id", "sequence", "kind", "units")
    return ev.seen_before(e, ["run_id"], "sequence", F.when(F.col("kind") == "view", F.col("units")), "capacity").select(
        "run_id", "sequence", "capacity"
    )


@query("task_lifecycle", w(EVENTS) + """
, g AS (SELECT run_id, k AS task_id, count(*) FILTER (WHERE kind = 'signup') AS selected, count(*) FILTER (WHERE kind = 'view') AS started,
   count(*) FILTER (WHERE kind = 'purchase') AS completed, count(*) FILTER (WHERE kind = 'error') AS cancelled,
   count(*) FILTER (WHERE kind = 'click') AS skipped, min(sequence) FILTER (WHERE kind = 'signup') AS s,
   min(sequence) FILTER (WHERE kind = 'view') AS t, min(sequence) FILTER (WHERE kind IN ('purchase', 'error')) AS e
   FROM ev GROUP BY ALL)
SELECT run_id, task_id, selected, started, completed, cancelled, skipped,
  coalesce(selected = 1 AND started = 1 AND completed + cancelled = 1 AND skipped = 0 AND s < t AND t < e, false)
  OR (selected + started + completed + cancelled = 0 AND skipped <= 1) AS aligned FROM g""")
def task_lifecycle(spark, d):
    e = fx.events(spark, d).withColumn("task_id", F.col("k"))
    return ev.task_lifecycle(e, ["run_id", "task_id"], "sequence", "at_ms", "kind", "signup", "view", "purchase", "error", "click")


@query("dependency_order", w(TASKS, DEPS) + """
SELECT d.run_id, d.task_id, d.dep_id FROM deps d LEFT JOIN tasks c ON c.run_id = d.run_id AND c.task_id = d.task_id
LEFT JOIN tasks p ON p.run_id = d.run_id AND p.task_id = d.dep_id WHERE NOT coalesce(p.end_ms <= c.start_ms, false)""")
def dependency_order(spark, d):
    t = fx.tasks(spark, d)
    child = t.select("run_id", "task_id", "start_ms")
    parent = t.select("run_id", F.col("task_id").alias("dep_id"), "end_ms")
    x = fx.deps(spark, d).join(child, ["run_id", "task_id"], "left").join(parent, ["run_id", "dep_id"], "left")
    return x.where(~holds(F.col("end_ms") <= F.col("start_ms"))).select("run_id", "task_id", "dep_id")


@query("residual_work", w(ATTEMPTS, RUNS) + """
, t AS (SELECT run_id, task_id, bool_or(outcome = 'completed') AS done, bool_and(outcome = 'cancelled' AND optional) AS skipped,
   sum(cost) AS cost, sum(tokens) AS tokens, sum(context) AS context, (run_id + task_id) % 7 = 0 AS sealed, max(end_ms) AS fin FROM attempts GROUP BY ALL)
SELECT run_id, count(*) FILTER (WHERE NOT done AND NOT skipped AND NOT sealed) AS residual, count(*) FILTER (WHERE sealed AND NOT done) AS sealed, max(started_ms) + 3456000000 - max(fin) AS remaining_ms,
  CAST(120 - sum(CASE WHEN done OR sealed THEN tokens ELSE 0 END) AS BIGINT) AS remaining_tokens,
  max(cost_cap) - CAST(sum(CASE WHEN done OR sealed THEN cost ELSE 0 END) AS BIGINT) AS remaining_cost,
  CAST(9000 - sum(CASE WHEN done OR sealed THEN context ELSE 0 END) AS BIGINT) AS remaining_context
FROM t JOIN runs USING (run_id) GROUP BY run_id""")
def residual_work(spark, d):
    """The time is that of the run's last end; a task of seven is sealed."""
    a = fx.attempts(spark, d)
    t = a.groupBy("run_id", "task_id").agg(
        F.bool_or(F.col("outcome") == "completed").alias("done"),
        F.bool_and((F.col("outcome") == "cancelled") & F.col("optional")).alias("skipped"),
        *[F.sum(c).alias(c) for c in ("cost", "tokens", "context")])
    last = a.groupBy("run_id").agg(F.max("end_ms").alias("now_ms"))
    env = fx.runs(spark, d).join(last, "run_id").select(
        "run_id", (F.col("started_ms") + 3456000000).alias("deadline_ms"), "now_ms", F.col("cost_cap").alias("max_cost"), F.lit(120).cast("long").alias("max_tokens"),
        F.lit(9000).cast("long").alias("max_context"))
    return rs.residual_work(t, t.where("(run_id + task_id) % 7 = 0"), env, ["tokens", "cost", "context"], "now_ms")


@query("state_facts", w(EVENTS) + """
, s AS (SELECT run_id, sequence, at_ms, CAST(sum(CASE kind WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 WHEN 'error' THEN -1 ELSE 0 END) OVER o AS BIGINT) AS active,
  CAST(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER o AS BIGINT) AS completed, CAST(sum(CASE WHEN kind IN ('purchase', 'error') THEN units ELSE 0 END) OVER o AS BIGINT) AS u,
  CAST(sum(CASE WHEN kind IN ('purchase', 'error') THEN units * 3 + k % 4 ELSE 0 END) OVER o AS BIGINT) AS c FROM ev WINDOW o AS (PARTITION BY run_id ORDER BY sequence))
SELECT run_id, sequence, active, completed, u AS tokens_so_far, c AS cost_so_far, 2000 - u AS remaining_tokens, CASE WHEN run_id % 5 <> 0 THEN 5000 - c END AS remaining_cost,
  1714521600000 - at_ms AS slack_ms FROM s""")
def state_facts(spark, d):
    """Runs whose id five divides declare no cost cap."""
    k = F.col("kind")
    e = fx.events(spark, d).select(
        "run_id", "sequence", "at_ms", "kind", F.col("units").alias("tokens"), (F.col("units") * 3 + F.col("k") % 4).alias("cost"), F.lit(2000).cast("long").alias("max_tokens"),
        F.when(F.col("run_id") % 5 != 0, 5000).cast("long").alias("max_cost"), F.lit(1714521600000).cast("long").alias("deadline_ms"))
    x = ev.state_facts(e, ["run_id"], "sequence", [], k == "signup", k.isin("purchase", "error"), k == "purchase", {"tokens": "max_tokens", "cost": "max_cost"},
                       k.isin("purchase", "error"), "at_ms", "deadline_ms")
    return x.select("run_id", "sequence", "active", "completed", "tokens_so_far", "cost_so_far", "remaining_tokens", "remaining_cost", "slack_ms")


@query("control_fields", w(EVENTS) + """
SELECT run_id, k % 5 AS provider, max(sequence) FILTER (WHERE kind IN ('view', 'click', 'signup')) AS set_at, arg_max(units, sequence) FILTER (WHERE kind = 'view') AS capacity,
  arg_max(units * 10, sequence) FILTER (WHERE kind = 'click') AS slow_down, arg_max(1000 - units, sequence) FILTER (WHERE kind = 'signup') AS cost_cap
FROM ev WHERE sequence <= 40 GROUP BY ALL HAVING count(*) FILTER (WHERE kind IN ('view', 'click', 'signup')) > 0""")
def control_fields(spark, d):
    k, u = F.col("kind"), F.col("units")
    e = fx.events(spark, d).where("sequence <= 40").withColumn("provider", F.col("k") % 5)
    return ev.control_fields(e, ["run_id", "provider"], "sequence", {
        "capacity": F.when(k == "view", u), "slow_down": F.when(k == "click", u * 10), "cost_cap": F.when(k == "signup", 1000 - u)})


@query("failed_pairs", w(EVENTS) + """
SELECT run_id, k AS task_id, k % 5 AS provider, min(sequence) AS failed_at, count(*) AS failures FROM ev WHERE kind = 'error' GROUP BY ALL""")
def failed_pairs(spark, d):
    e = fx.events(spark, d).select("run_id", F.col("k").alias("task_id"), (F.col("k") % 5).alias("provider"), "sequence", "kind")
    return ev.failed_pairs(e, ["run_id", "task_id", "provider"], "sequence", F.col("kind") == "error")


@query("expected_order", """
WITH c AS (SELECT n_regionkey AS region, s_suppkey AS id, s_suppkey + CASE WHEN s_suppkey % 41 = 0 THEN 60 ELSE 0 END AS got FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 17 <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY id) AS expected_at, row_number() OVER (PARTITION BY region ORDER BY got, id) AS observed_at FROM c)
SELECT CAST(region AS BIGINT) AS region, id, expected_at, observed_at FROM p WHERE expected_at <> observed_at""")
def expected_order(spark, d):
    """Suppliers by id are the expected list of their region; some are seen late, some not at all."""
    n = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("region"))
    i = F.col("s_suppkey")
    u = fx.table(spark, d, "supplier").join(n, "s_nationkey").select("region", i.alias("id"), i.alias("want"), (i + F.when(i % 41 == 0, 60).otherwise(0)).alias("got"))
    return order_breaches(u.select("region", "id", "want"), u.where("id % 17 <> 0").select("region", "id", "got"), ["region"], "id", "want", "got")


@query("run_summary", w(EVENTS) + """
SELECT run_id, coalesce(arg_max(kind, sequence) FILTER (WHERE kind IN ('purchase', 'error')), 'running') AS state, count(*) AS events,
  count(DISTINCT k) FILTER (WHERE kind = 'purchase') AS completed_tasks,
  CAST(sum(CASE WHEN kind IN ('purchase', 'error') THEN units ELSE 0 END) AS BIGINT) AS units FROM ev GROUP BY run_id""")
def run_summary(spark, d):
    k = F.col("kind")
    return fx.events(spark, d).groupBy("run_id").agg(
        F.coalesce(F.max_by("kind", F.when(k.isin("purchase", "error"), F.col("sequence"))), F.lit("running")).alias("state"),
        F.count("*").alias("events"),
        F.countDistinct(F.when(k == "purchase", F.col("k"))).alias("completed_tasks"),
        F.sum(F.when(k.isin("purchase", "error"), F.col("units")).otherwise(0)).alias("units"),
    )


@query("dead_letters", w(NUMBERED) + """
, g AS (SELECT run_id, task_id, count(*) AS attempts, arg_max(outcome, attempt) AS last_outcome, arg_max(cost, attempt) AS c,
   bool_or(outcome = 'completed') AS done FROM numbered GROUP BY ALL)
SELECT run_id, task_id, attempts, sha256('failed cost ' || c) AS error_digest FROM g WHERE last_outcome = 'failed' AND NOT done""")
def dead_letters(spark, d):
    g = fx.numbered_attempts(spark, d).groupBy("run_id", "task_id").agg(
        F.count("*").alias("attempts"), F.max_by("outcome", "attempt").alias("last_outcome"),
        F.max_by("cost", "attempt").alias("c"), F.bool_or(F.col("outcome") == "completed").alias("done"),
    )
    return g.where((F.col("last_outcome") == "failed") & ~F.col("done")).select(
        "run_id", "task_id", "attempts", F.sha2(F.concat(F.lit("failed cost "), F.col("c").cast("string")), 256).alias("error_digest")
    )


@query("reason_counts", w(EVENTS) + """
SELECT coalesce(CASE WHEN k % 4 <> 0 THEN kind END, 'unspecified') AS reason, count(*) AS runs FROM ev GROUP BY 1""")
def reason_counts(spark, d):
    e = fx.events(spark, d)
    reason = F.coalesce(F.when(F.col("k") % 4 != 0, F.col("kind")), F.lit("unspecified"))
    return e.groupBy(reason.alias("reason")).agg(F.count("*").alias("runs"))


@query("expected_ids", """
WITH e AS (SELECT s_suppkey AS id FROM supplier),
o AS (SELECT l_suppkey + CASE WHEN l_suppkey % 89 = 0 THEN 10000000 ELSE 0 END AS id, count(*) AS n FROM lineitem
      WHERE l_suppkey % 29 <> 0 GROUP BY 1)
SELECT coalesce(e.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unknown' ELSE 'duplicate' END AS code
FROM e FULL JOIN o ON e.id = o.id WHERE o.id IS NULL OR e.id IS NULL OR n > 1""")
def expected_ids(spark, d):
    o = fx.attempts(spark, d).where("provider % 29 <> 0").select(
        (F.col("provider") + F.when(F.col("provider") % 89 == 0, 10000000).otherwise(0)).alias("id")
    )
    return set_difference(fx.providers(spark, d).select(F.col("provider").alias("id")), o, ["id"])


@query("effect_serialization", w(ATTEMPTS) + """
, x AS (SELECT run_id, task_id, provider, start_ms, end_ms, outcome <> 'completed' AS writes,
   row_number() OVER () AS rid FROM attempts WHERE start_ms < end_ms)
SELECT a.provider, a.run_id, a.task_id, a.start_ms, a.end_ms, a.writes, count(*) AS copies FROM x a WHERE EXISTS (
  SELECT 1 FROM x b WHERE b.provider = a.provider AND b.rid <> a.rid AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms
   AND (a.writes OR b.writes)) GROUP BY ALL""")
def effect_serialization(spark, d):
    from tallyline.operators.intervals import conflicting_use

    a = fx.attempts(spark, d).select(
        "provider", "run_id", "task_id", "start_ms", "end_ms", (F.col("outcome") != "completed").alias("writes")
    )
    return conflicting_use(a, ["provider"], "start_ms", "end_ms", "writes", ["run_id", "task_id"])


@query("approval_use", w(EVENTS) + """
, g AS (SELECT run_id, min(at_ms) AS not_before, min(at_ms) + 40000000 AS expires, min(k) AS scope FROM ev WHERE kind = 'signup' AND run_id % 73 <> 0 GROUP BY run_id),
c AS (SELECT run_id, event_id, at_ms, CASE WHEN k < 50 THEN (SELECT scope FROM g WHERE g.run_id = ev.run_id) ELSE k END AS scope,
      count(*) OVER (PARTITION BY run_id) AS uses FROM ev WHERE kind = 'purchase')
SELECT c.run_id, event_id, CASE WHEN not_before IS NULL THEN 'missing_approval' WHEN c.scope IS DISTINCT FROM g.scope THEN 'approval_scope_mismatch'
  WHEN expires <= not_before THEN 'empty_validity' WHEN at_ms < not_before OR at_ms >= expires THEN 'outside_validity'
  WHEN uses <> 1 THEN 'approval_reuse' END AS code FROM c LEFT JOIN g USING (run_id)""")
def approval_use(spark, d):
    e = fx.events(spark, d)
    g = e.where("kind = 'signup' and run_id % 73 <> 0").groupBy("run_id").agg(
        F.min("at_ms").alias("not_before"), (F.min("at_ms") + 40000000).alias("expires"), F.min("k").alias("scope")
    )
    c = e.where("kind = 'purchase'").select("run_id", "event_id", "at_ms", "k").join(
        g.select("run_id", F.col("scope").alias("gs")), "run_id", "left"
    ).select("run_id", "event_id", "at_ms", F.when(F.col("k") < 50, F.col("gs")).otherwise(F.col("k")).alias("scope"))
    return ev.approval_use(c, g, ["run_id"], "at_ms").select("run_id", "event_id", "code")


@query("decision_explanations", w(NUMBERED) + """
, m AS (SELECT l.*, q, max(q) OVER (PARTITION BY run_id, task_id) AS best FROM (
    SELECT n.*, p_size % 20 + 80 AS q FROM numbered n JOIN part ON profile = p_partkey) l)
SELECT run_id, task_id, attempt,
  CASE WHEN outcome = 'completed' AND q < best THEN 'degraded_profile_selection' WHEN outcome = 'completed' THEN 'profile_selection'
       WHEN outcome = 'cancelled' AND optional THEN 'optional_shed' WHEN outcome = 'cancelled' THEN 'task_cancellation' ELSE 'run_refusal' END AS action,
  CASE WHEN outcome = 'cancelled' AND optional THEN CASE WHEN attempt > 1 THEN 'dependency_skipped' ELSE 'protected_envelope_preserved' END
       WHEN outcome = 'cancelled' THEN 'run_refused'
       WHEN outcome = 'failed' THEN CASE WHEN task_id % 3 = 0 THEN 'protected_task_no_admissible_profile'
            WHEN task_id % 3 = 1 THEN 'required_dependency_skipped' ELSE 'recorded_failure' END END AS reason_code
FROM m""")
def decision_explanations(spark, d):
    from tallyline.operators.explain import explain

    n = fx.numbered_attempts(spark, d)
    q = fx.table(spark, d, "part").select(F.col("p_partkey").alias("profile"), (F.col("p_size") % 20 + 80).alias("quality"))
    x = n.join(q, ["profile"], "inner")
    best = x.groupBy("run_id", "task_id").agg(F.max("quality").alias("best_quality"))
    o, t = F.col("outcome"), F.col("task_id").cast("string")
    kind = (
        F.when(o == "completed", "profile.selected").when((o == "cancelled") & F.col("optional"), "task.skipped")
        .when(o == "cancelled", "task.cancelled").otherwise("run.failed")
    )
    reason = (
        F.when(kind == "task.skipped", F.when(F.col("attempt") > 1, "dependency skipped")
               .otherwise("protected resource or deadline envelope"))
        .when(F.col("task_id") % 3 == 0, F.concat(F.lit("protected task "), t, F.lit(" has no admissible backend plan")))
        .when(F.col("task_id") % 3 == 1, F.concat(F.lit("required task "), t, F.lit(" depends on skipped work 1")))
    )
    y = x.join(best, ["run_id", "task_id"], "inner").withColumns({"event_type": kind, "reason": reason})
    return explain(y, "event_type", "reason", "quality", "best_quality").select(
        "run_id", "task_id", "attempt", "action", "reason_code"
    )


@query("set_alignment", w(ATTEMPTS) + """
, t AS (SELECT run_id, task_id, bool_or(outcome = 'completed') AS c, bool_or(outcome = 'cancelled') AS x, bool_or(outcome = 'failed') AS f
        FROM attempts GROUP BY ALL)
SELECT run_id, bool_and(c OR x) AS all_terminal, bool_or(c AND x) AS overlap, bool_and(c OR x) AND NOT bool_or(c AND x) AS passed
FROM t GROUP BY run_id""")
def set_alignment(spark, d):
    t = fx.attempts(spark, d).groupBy("run_id", "task_id").agg(
        F.bool_or(F.col("outcome") == "completed").alias("c"), F.bool_or(F.col("outcome") == "cancelled").alias("x")
    )
    return t.groupBy("run_id").agg(
        F.bool_and(F.col("c") | F.col("x")).alias("all_terminal"), F.bool_or(F.col("c") & F.col("x")).alias("overlap"),
        (F.bool_and(F.col("c") | F.col("x")) & ~F.bool_or(F.col("c") & F.col("x"))).alias("passed"),
    )


@query("outcome_consistency", w(NUMBERED) + """
SELECT run_id, task_id, attempt, CASE WHEN outcome = 'completed' THEN 'success_shape' ELSE 'failure_shape' END AS code FROM (
  SELECT *, CASE WHEN outcome = 'completed' OR cost % 97 = 0 THEN end_ms END AS makespan,
            CASE WHEN outcome <> 'completed' OR cost % 89 = 0 THEN end_ms END AS to_failure FROM numbered)
WHERE (outcome = 'completed' AND NOT (makespan IS NOT NULL AND to_failure IS NULL))
   OR (outcome <> 'completed' AND NOT (makespan IS NULL AND to_failure IS NOT NULL))""")
def outcome_consistency(spark, d):
    ok = F.col("outcome") == "completed"
    a = fx.numbered_attempts(spark, d).withColumns({
        "makespan": F.when(ok | (F.col("cost") % 97 == 0), F.col("end_ms")),
        "to_failure": F.when(~ok | (F.col("cost") % 89 == 0), F.col("end_ms")),
    })
    return flagged(a, {
        "success_shape": ok & ~(F.col("makespan").isNotNull() & F.col("to_failure").isNull()),
        "failure_shape": ~ok & ~(F.col("makespan").isNull() & F.col("to_failure").isNotNull()),
    }, ["run_id", "task_id", "attempt"])
