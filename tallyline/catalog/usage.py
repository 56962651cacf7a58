"""Usage, caps, peaks, admission and selection over the attempt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog.registry import query
from tallyline.catalog.sqlviews import ATTEMPTS, PROFILES, RUNS, TASKS, w
from tallyline.operators import resources as rs
from tallyline.operators import selection as sel
from tallyline.operators.scan import rcount, running

PEAKS = """marks AS (
  SELECT provider, t, sum(d) AS d FROM (
    SELECT provider, start_ms AS t, 1 AS d FROM attempts WHERE start_ms < end_ms
    UNION ALL SELECT provider, end_ms, -1 FROM attempts WHERE start_ms < end_ms) GROUP BY ALL),
peaks AS (
  SELECT provider, max(level) AS peak FROM (
    SELECT provider, sum(d) OVER (PARTITION BY provider ORDER BY t) AS level FROM marks) GROUP BY provider)"""


@query("provider_load", w(ATTEMPTS, PEAKS) + """
SELECT a.provider, CAST(p.peak AS BIGINT) AS peak, a.tokens, a.cost, 1 + a.provider % 4 AS max_parallel,
       p.peak <= 1 + a.provider % 4 AS passed
FROM (SELECT provider, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost
      FROM attempts GROUP BY provider) a
JOIN peaks p USING (provider) JOIN supplier s ON s.s_suppkey = a.provider""")
def provider_load(spark, d):
    a = fx.attempts(spark, d)
    usage = rs.usage_totals(a, ["provider"], "outcome", rs.TERMINAL_ATTEMPTS, ["tokens", "cost"])
    peaks = rs.peak_concurrency(a, ["provider"], "start_ms", "end_ms")
    limits = fx.providers(spark, d).select("provider", F.col("limit").alias("max_parallel"))
    return usage.join(peaks, "provider").join(limits, "provider").withColumn(
        "passed", F.col("peak") <= F.col("max_parallel")
    )


@query("run_peak_concurrency", w(ATTEMPTS) + """
, m AS (SELECT run_id, t, sum(d) AS d FROM (
    SELECT run_id, start_ms AS t, 1 AS d FROM attempts UNION ALL SELECT run_id, end_ms, -1 FROM attempts) GROUP BY ALL)
SELECT run_id, CAST(max(level) AS BIGINT) AS peak FROM (
  SELECT run_id, sum(d) OVER (PARTITION BY run_id ORDER BY t) AS level FROM m) GROUP BY run_id""")
def run_peak_concurrency(spark, d):
    return rs.peak_concurrency(fx.attempts(spark, d), ["run_id"], "start_ms", "end_ms")


@query("usage_totals", w(ATTEMPTS) + """
SELECT run_id, CAST(sum(CASE WHEN outcome IN ('completed', 'failed') THEN tokens ELSE 0 END) AS BIGINT) AS tokens,
       CAST(sum(CASE WHEN outcome IN ('completed', 'failed') THEN cost ELSE 0 END) AS BIGINT) AS cost,
       CAST(sum(CASE WHEN outcome IN ('completed', 'failed') THEN context ELSE 0 END) AS BIGINT) AS context
FROM attempts GROUP BY run_id""")
def usage_totals(spark, d):
    return rs.usage_totals(
        fx.attempts(spark, d), ["run_id"], "outcome", ["completed", "failed"], ["tokens", "cost", "context"]
    )


@query("envelope_fit", w(ATTEMPTS, RUNS) + """
, u AS (SELECT run_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost,
               CAST(sum(context) AS BIGINT) AS context FROM attempts GROUP BY run_id)
SELECT run_id, dimension, observed, max_allowed AS "limit", observed <= max_allowed AS passed, unit FROM (
  SELECT run_id, 'tokens' AS dimension, tokens AS observed, CAST(100 AS BIGINT) AS max_allowed, 'tokens' AS unit FROM u
  UNION ALL SELECT run_id, 'cost', cost, cost_cap, 'cents' FROM u JOIN runs USING (run_id)
  UNION ALL SELECT run_id, 'context_movement', context, 9000, 'bytes' FROM u)""")
def envelope_fit(spark, d):
    u = rs.usage_totals(fx.attempts(spark, d), ["run_id"], "outcome", rs.TERMINAL_ATTEMPTS,
                        ["tokens", "cost", "context"])
    x = u.join(fx.runs(spark, d).select("run_id", "cost_cap"), "run_id").select(
        "*", F.lit(100).alias("max_tokens"), F.lit(9000).alias("max_context")
    )
    return rs.envelope_fit(x, ["run_id"], {
        "tokens": ("tokens", "max_tokens", "tokens"),
        "cost": ("cost", "cost_cap", "cents"),
        "context_movement": ("context", "max_context", "bytes"),
    })


@query("admission_status", w(ATTEMPTS, RUNS) + """
, u AS (SELECT run_id, sum(cost) AS cost, count(*) FILTER (WHERE outcome = 'cancelled' AND optional) AS skipped,
               count(*) FILTER (WHERE outcome <> 'completed' AND NOT optional) AS lost FROM attempts GROUP BY run_id)
SELECT status, count(*) AS runs FROM (
  SELECT CASE WHEN NOT (u.cost <= cost_cap AND lost = 0) THEN 'refused' WHEN skipped > 0 THEN 'degraded'
         ELSE 'feasible' END AS status FROM u JOIN runs USING (run_id)) GROUP BY status""")
def admission_status(spark, d):
    u = fx.attempts(spark, d).groupBy("run_id").agg(
        F.sum("cost").alias("cost"),
        F.count_if((F.col("outcome") == "cancelled") & F.col("optional")).alias("skipped"),
        F.count_if((F.col("outcome") != "completed") & ~F.col("optional")).alias("lost"),
    )
    x = u.join(fx.runs(spark, d), "run_id")
    ok = (F.col("cost") <= F.col("cost_cap")) & (F.col("lost") == 0)
    return x.groupBy(rs.admission(ok, F.col("skipped")).alias("status")).agg(F.count("*").alias("runs"))


@query("overflow_totals", w(ATTEMPTS) + """
, x AS (SELECT run_id, tokens, CASE WHEN task_id = 1 THEN 9223372036854775807 ELSE cost END AS cost FROM attempts),
s AS (SELECT run_id, sum(tokens) AS tokens, sum(CAST(cost AS HUGEINT)) AS cost FROM x GROUP BY run_id)
SELECT run_id, CAST(tokens AS BIGINT) AS tokens, false AS tokens_overflow,
       CASE WHEN cost <= 9223372036854775807 THEN CAST(cost AS BIGINT) END AS cost,
       cost > 9223372036854775807 AS cost_overflow FROM s""")
def overflow_totals(spark, d):
    a = fx.attempts(spark, d).withColumn(
        "cost", F.when(F.col("task_id") == 1, F.lit(9223372036854775807)).otherwise(F.col("cost"))
    )
    return rs.safe_totals(a, ["run_id"], ["tokens", "cost"])


@query("conservative_peak", w(ATTEMPTS) + """
, r AS (SELECT provider, context, row_number() OVER (PARTITION BY provider ORDER BY context DESC) AS n FROM attempts)
SELECT provider, CAST(sum(context) AS BIGINT) AS context FROM r WHERE n <= 1 + provider % 4 GROUP BY provider""")
def conservative_peak(spark, d):
    a = fx.attempts(spark, d).withColumn("slots", 1 + F.col("provider") % 4)
    return rs.conservative_peak(a, ["provider"], "context", "slots")


@query("joint_success", w(ATTEMPTS) + """
SELECT run_id, round(product(success_probability), 12) AS joint_success FROM attempts GROUP BY run_id""")
def joint_success(spark, d):
    return rs.joint_success(fx.attempts(spark, d), ["run_id"], "success_probability")


@query("retry_reservation", w(TASKS, RUNS) + """
, r AS (SELECT run_id, sum(tokens * CASE WHEN task_id % 3 = 0 THEN 1 ELSE 3 END) AS tokens,
       sum(cost * CASE WHEN task_id % 3 = 0 THEN 1 ELSE 3 END) AS cost FROM tasks GROUP BY run_id)
SELECT run_id, CAST(tokens AS BIGINT) AS tokens, CAST(cost AS BIGINT) AS cost, cost_cap, cost <= cost_cap AS passed
FROM r JOIN runs USING (run_id)""")
def retry_reservation(spark, d):
    t = fx.tasks(spark, d).withColumn("writes", F.col("task_id") % 3 == 0)
    worst = rs.retry_reservation(t, ["run_id"], ["tokens", "cost"], 3, "writes")
    return worst.join(fx.runs(spark, d).select("run_id", "cost_cap"), "run_id").withColumn(
        "passed", rs.holds(F.col("cost") <= F.col("cost_cap"))
    )


@query("protected_reserve", w(ATTEMPTS, RUNS) + """
, s AS (SELECT run_id, cost_cap,
   CAST(sum(CASE WHEN outcome = 'completed' THEN cost ELSE 0 END) AS BIGINT) AS committed,
   CAST(sum(CASE WHEN outcome <> 'completed' AND NOT optional THEN cost ELSE 0 END) AS BIGINT) AS pending_mandatory
   FROM attempts JOIN runs USING (run_id) GROUP BY ALL)
SELECT *, cost_cap - committed - pending_mandatory AS headroom, committed + pending_mandatory <= cost_cap AS admissible
FROM s""")
def protected_reserve(spark, d):
    a = fx.attempts(spark, d).withColumn("protected", ~F.col("optional"))
    x = a.join(fx.runs(spark, d).select("run_id", "cost_cap"), "run_id")
    return rs.protected_reserve(x, ["run_id"], "cost", "cost_cap", "outcome", "protected")


@query("qualified_profiles", w(PROFILES) + """
SELECT profile, variant, quality_pct, p95, cost FROM profiles
WHERE quality_pct >= 88 AND p95 <= least(CASE WHEN profile % 2 = 0 THEN 30 ELSE 60 END, 60)""")
def qualified_profiles(spark, d):
    p = fx.profiles(spark, d).select(
        "*", F.lit(88).alias("floor"), F.when(F.col("profile") % 2 == 0, 30).alias("own"), F.lit(60).alias("run_limit")
    )
    return sel.qualified(p, "quality_pct", "floor", "p95", "own", "run_limit").select(
        "profile", "variant", "quality_pct", "p95", "cost"
    )


def _asks(spark, d):
    return fx.attempts(spark, d).select("run_id", "task_id", "profile")


def _options(spark, d):
    return fx.profiles(spark, d).select(
        "profile", "variant", "quality_pct", "p95", "cost", "tokens", "context", "provider",
        (100 - F.col("quality_pct")).alias("failure"), F.col("quality_pct").alias("quality"),
        F.concat_ws("-", F.lit("v"), "variant").alias("name"),
    )


def _offers(spark, d):
    """Every profile variant a task of a run could take."""
    return _asks(spark, d).distinct().join(_options(spark, d), "profile")


OFFERS = w(ATTEMPTS, PROFILES) + """
, offers AS (SELECT DISTINCT run_id, task_id, p.* FROM (SELECT DISTINCT run_id, task_id, profile FROM attempts) a
             JOIN profiles p USING (profile) WHERE quality_pct >= 85)"""


@query("best_profile_cheapest", OFFERS + """
SELECT run_id, task_id, profile, variant, cost FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY cost, tokens, context, 100 - quality_pct,
         -quality_pct, p95, provider, 'v-' || variant, profile, variant) AS n FROM offers) WHERE n = 1""")
def best_profile_cheapest(spark, d):
    p = _options(spark, d).where("quality_pct >= 85")
    return sel.best(_asks(spark, d), ["run_id", "task_id"], sel.CHEAPEST, ["profile", "variant", "cost"], p, ["profile"])


@query("best_profile_token_first", OFFERS + """
SELECT run_id, task_id, profile, variant, tokens FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY tokens, cost, context, p95, provider,
         'v-' || variant, profile, variant) AS n FROM offers) WHERE n = 1""")
def best_profile_token_first(spark, d):
    p = _options(spark, d).where("quality_pct >= 85")
    return sel.best(_asks(spark, d), ["run_id", "task_id"], sel.TOKEN_FIRST, ["profile", "variant", "tokens"], p, ["profile"])


@query("best_profile_highest_quality", OFFERS + """
SELECT run_id, task_id, profile, variant, quality_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY -quality_pct, p95, cost, tokens, context,
         100 - quality_pct, provider, 'v-' || variant, profile, variant) AS n FROM offers) WHERE n = 1""")
def best_profile_highest_quality(spark, d):
    p = _options(spark, d).where("quality_pct >= 85")
    return sel.best(_asks(spark, d), ["run_id", "task_id"], sel.HIGHEST_QUALITY, ["profile", "variant", "quality_pct"], p, ["profile"])


@query("cheapest_qualified_total", OFFERS + """
, m AS (SELECT run_id, task_id, min(cost) AS cost, min(tokens) AS tokens FROM offers GROUP BY ALL),
b AS (SELECT run_id, sum(cost) AS cost, sum(tokens) AS tokens FROM m GROUP BY run_id),
u AS (SELECT run_id, sum(cost) AS spent FROM attempts GROUP BY run_id)
SELECT run_id, CAST(b.cost AS BIGINT) AS bound_cost, CAST(b.tokens AS BIGINT) AS bound_tokens,
       CAST(spent AS BIGINT) AS spent, CAST(spent - b.cost AS BIGINT) AS regret FROM b JOIN u USING (run_id)""")
def cheapest_qualified_total(spark, d):
    o = _offers(spark, d).where("quality_pct >= 85")
    bound = (
        o.groupBy("run_id", "task_id").agg(F.min("cost").alias("c"), F.min("tokens").alias("t"))
        .groupBy("run_id").agg(F.sum("c").alias("bound_cost"), F.sum("t").alias("bound_tokens"))
    )
    spent = fx.attempts(spark, d).groupBy("run_id").agg(F.sum("cost").alias("spent"))
    return bound.join(spent, "run_id").withColumn("regret", F.col("spent") - F.col("bound_cost"))


FAULTS = (
    {"id": "nominal-control", "kind": "control"},
    {"id": "slow-brand-7", "kind": "slowdown", "provider": "Brand#7", "num": 7, "den": 3},
    {"id": "outage-brand-3", "kind": "outage", "provider": "Brand#3"},
    {"id": "capacity-brand-5", "kind": "capacity", "provider": "Brand#5", "num": 1},
    {"id": "budget-1-75", "kind": "budget", "num": 1, "den": 75},
)


@query("what_if_profiles", w(PROFILES) + """
, f AS (SELECT unnest(['nominal-control', 'slow-brand-7', 'outage-brand-3', 'capacity-brand-5', 'budget-1-75']) AS fault)
SELECT fault, profile, variant, cost, provider,
  CASE WHEN fault = 'slow-brand-7' AND provider = 'Brand#7' THEN (p95 * 7 + 2) // 3 ELSE p95 END AS p95
FROM profiles, f WHERE NOT (fault = 'outage-brand-3' AND provider = 'Brand#3')""")
def what_if_profiles(spark, d):
    p = fx.profiles(spark, d).select("profile", "variant", "cost", "provider", "p95")
    return rs.what_if(p, FAULTS)


@query("what_if_budget", w(RUNS) + """
SELECT run_id, cost_cap, cost_cap * 1 // 75 AS cut_cap FROM runs""")
def what_if_budget(spark, d):
    return fx.runs(spark, d).select("run_id", "cost_cap", rs.cut_budget(F.col("cost_cap"), 1, 75).alias("cut_cap"))


@query("run_metrics", w(ATTEMPTS) + """
SELECT run_id, count(*) AS attempts, count(DISTINCT task_id) AS tasks,
       round(count(*) / count(DISTINCT task_id), 6) AS retry_amplification,
       CAST(sum(CASE WHEN outcome = 'cancelled' THEN tokens ELSE 0 END) AS BIGINT) AS cancelled_tokens,
       max(end_ms) - min(start_ms) AS makespan_ms
FROM attempts GROUP BY run_id""")
def run_metrics(spark, d):
    return rs.run_metrics(fx.attempts(spark, d), ["run_id"])


@query("context_amplification", """
WITH x AS (SELECT source, sha256(text) AS h, n_chars FROM documents)
SELECT source, CAST(sum(n_chars) AS BIGINT) AS moved,
       CAST((SELECT sum(n) FROM (SELECT h, max(n_chars) AS n FROM x i WHERE i.source = x.source GROUP BY h)) AS BIGINT) AS unique_bytes,
       round(sum(n_chars) / (SELECT sum(n) FROM (SELECT h, max(n_chars) AS n FROM x i WHERE i.source = x.source GROUP BY h)), 6) AS amplification
FROM x GROUP BY source""")
def context_amplification(spark, d):
    a = fx.artifacts(spark, d)
    per = a.groupBy("producer", "artifact_id").agg(F.sum("size").alias("moved"), F.max("size").alias("once"))
    return per.groupBy(F.col("producer").alias("source")).agg(
        F.sum("moved").alias("moved"),
        F.sum("once").alias("unique_bytes"),
        F.round(F.sum("moved") / F.sum("once"), 6).alias("amplification"),
    )


@query("ready_ranking", w(TASKS) + """
SELECT provider, run_id, task_id, row_number() OVER (PARTITION BY provider ORDER BY
   CASE WHEN NOT optional THEN 0 ELSE 1 END, 1000000000000 - end_ms, -(end_ms - start_ms), -cost,
   CAST(run_id AS VARCHAR) || ':' || CAST(task_id AS VARCHAR)) AS position
FROM tasks""")
def ready_ranking(spark, d):
    t = fx.tasks(spark, d).select(
        "provider", "run_id", "task_id", (~F.col("optional")).alias("protected"),
        (F.lit(1000000000000) - F.col("end_ms")).alias("slack"), (F.col("end_ms") - F.col("start_ms")).alias("rank"),
        F.col("cost").alias("value"), F.concat_ws(":", "run_id", "task_id").alias("id"),
    )
    return sel.ready_rank(t, ["provider"], "protected", "slack", "rank", "value", "id").select(
        "provider", "run_id", "task_id", "position"
    )


@query("attempt_numbers", w(ATTEMPTS) + """
SELECT run_id, task_id, start_ms, profile, row_number() OVER (PARTITION BY run_id, task_id ORDER BY start_ms, profile,
  provider, tokens, cost, success_probability, tax_cents, outcome, optional) AS attempt,
  row_number() OVER (PARTITION BY run_id, task_id ORDER BY start_ms, profile, provider, tokens, cost,
  success_probability, tax_cents, outcome, optional) <= 3 AS within_bound
FROM attempts""")
def attempt_numbers(spark, d):
    x = running(fx.attempts(spark, d), ["run_id", "task_id"], "start_ms", {"attempt": rcount()}, tie=fx.ATTEMPT_TIES)
    return x.select("run_id", "task_id", "start_ms", "profile", "attempt", (F.col("attempt") <= 3).alias("within_bound"))


@query("profile_skyline", w(PROFILES) + """
, v AS (SELECT DISTINCT provider, tokens, cost, context, quality_pct FROM profiles)
SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE a.provider = b.provider AND b.tokens <= a.tokens
  AND b.cost <= a.cost AND b.context <= a.context AND b.quality_pct >= a.quality_pct
  AND (b.tokens < a.tokens OR b.cost < a.cost OR b.context < a.context OR b.quality_pct > a.quality_pct))""")
def profile_skyline(spark, d):
    return sel.pareto(fx.profiles(spark, d), ["provider"], ["tokens", "cost", "context"], ["quality_pct"])


@query("run_skyline", w(ATTEMPTS, RUNS) + """
, u AS (SELECT DISTINCT policy, tokens, cost, good FROM (
   SELECT run_id, sum(tokens) AS tokens, sum(cost) AS cost,
     count(*) FILTER (WHERE outcome = 'completed') AS good FROM attempts GROUP BY run_id) JOIN runs USING (run_id))
SELECT policy, CAST(tokens AS BIGINT) AS tokens, CAST(cost AS BIGINT) AS cost, good FROM u a
WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.policy = b.policy AND b.tokens <= a.tokens
  AND b.cost <= a.cost AND b.good >= a.good AND (b.tokens < a.tokens OR b.cost < a.cost OR b.good > a.good))""")
def run_skyline(spark, d):
    u = fx.attempts(spark, d).groupBy("run_id").agg(
        F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"),
        F.count_if(F.col("outcome") == "completed").alias("good"),
    )
    x = u.join(fx.runs(spark, d).select("run_id", "policy"), "run_id")
    return sel.pareto(x, ["policy"], ["tokens", "cost"], ["good"])
