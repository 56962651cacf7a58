"""Statistics over trials and experiment records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog.registry import query
from tallyline.catalog.sqlviews import EVENTS, EXPERIMENT, RUNS, TRIALS, w
from tallyline.operators import stats as st
from tallyline.operators.checks import flagged

Z = "1.959963984540054"
WILSON_LOW = f"""round(CASE WHEN passes = 0 THEN 0.0 ELSE greatest(0.0, ((1.0 * passes / runs + {Z}*{Z}/(2.0*runs)) - {Z} *
  sqrt((1.0 * passes / runs) * (1 - 1.0 * passes / runs) / runs + {Z}*{Z}/(4.0*runs*runs))) / (1 + {Z}*{Z}/runs)) END, 6)"""
WILSON_HIGH = f"""round(CASE WHEN passes = runs THEN 1.0 ELSE least(1.0, ((1.0 * passes / runs + {Z}*{Z}/(2.0*runs)) + {Z} *
  sqrt((1.0 * passes / runs) * (1 - 1.0 * passes / runs) / runs + {Z}*{Z}/(4.0*runs*runs))) / (1 + {Z}*{Z}/runs)) END, 6)"""


@query("policy_summary", w(RUNS) + """
SELECT policy, count(*) AS runs, count(*) FILTER (WHERE state = 'F') AS successes,
  round(quantile_cont(cost_cap, 0.5), 6) AS median_cost FROM runs GROUP BY policy""")
def policy_summary(spark, d):
    r = fx.runs(spark, d)
    g = r.groupBy("policy").agg(F.count("*").alias("runs"), F.count_if(F.col("state") == "F").alias("successes"))
    return g.join(st.percentiles(r, ["policy"], "cost_cap", {"median_cost": 0.5}, "linear"), "policy")


@query("pass_rates", w(TRIALS) + f"""
, g AS (SELECT scenario, CAST(count(*) AS BIGINT) AS runs, count(*) FILTER (WHERE passed) AS passes FROM trials GROUP BY scenario)
SELECT *, round(passes / runs, 6) AS pass_rate, {WILSON_LOW} AS wilson_low, {WILSON_HIGH} AS wilson_high FROM g""")
def pass_rates(spark, d):
    return st.pass_rates(fx.trials(spark, d), ["scenario"], "passed")


@query("percentiles_linear", w(TRIALS) + """
SELECT seed, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.95), 6) AS p95 FROM trials GROUP BY seed""")
def percentiles_linear(spark, d):
    return st.percentiles(fx.trials(spark, d), ["seed"], "duration", {"p50": 0.5, "p95": 0.95}, "linear")


@query("percentiles_nearest", w(TRIALS) + """
, r AS (SELECT seed, duration, row_number() OVER (PARTITION BY seed ORDER BY duration) AS i, count(*) OVER (PARTITION BY seed) AS n FROM trials)
SELECT seed, max(duration) FILTER (WHERE i = greatest(1, ceil(0.5 * n))) AS p50, max(duration) FILTER (WHERE i = greatest(1, ceil(0.95::DOUBLE * n))) AS p95,
  max(duration) FILTER (WHERE i = greatest(1, ceil(0.99::DOUBLE * n))) AS p99 FROM r GROUP BY seed""")
def percentiles_nearest(spark, d):
    return st.percentiles(fx.trials(spark, d), ["seed"], "duration", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "nearest")


@query("latency_summary", w(TRIALS) + """
, r AS (SELECT scenario, duration, row_number() OVER (PARTITION BY scenario ORDER BY duration) AS i, count(*) OVER (PARTITION BY scenario) AS n FROM trials)
SELECT scenario, count(*) AS count, min(duration) AS min, CAST(sum(duration) AS BIGINT) // count(*) AS mean, max(duration) AS max,
  max(duration) FILTER (WHERE i = ceil(0.5 * n)) AS p50, max(duration) FILTER (WHERE i = ceil(0.95::DOUBLE * n)) AS p95 FROM r GROUP BY scenario""")
def latency_summary(spark, d):
    return st.latency_summary(fx.trials(spark, d), ["scenario"], "duration")


@query("pass_pow_k", w(TRIALS) + """
, g AS (SELECT seed, count(*) AS trials, count(*) FILTER (WHERE passed) AS passes FROM trials GROUP BY seed)
SELECT *, round(passes / trials, 6) AS pass_rate, round(pow(passes / trials, trials), 12) AS pass_pow_k, passes = trials AS all_k FROM g""")
def pass_pow_k(spark, d):
    return st.pass_k(fx.trials(spark, d), "seed", "passed")


DRAWS = """
, v AS (SELECT fault, tokens, row_number() OVER (PARTITION BY fault ORDER BY seed * 3 + policy) - 1 AS i,
          count(*) OVER (PARTITION BY fault) AS n FROM experiment),
b AS (SELECT unnest(range(1, 201)) AS b),
p AS (SELECT fault, b, CAST(('0x' || substr(md5('tokens:' || fault || '|' || b || '|' || i), 1, 15)) AS BIGINT) % n AS i FROM v, b),
x AS (SELECT p.fault, p.b, v.tokens FROM p JOIN v ON p.fault = v.fault AND p.i = v.i)"""


@query("bootstrap_mean", w(EXPERIMENT) + DRAWS + """
, s AS (SELECT fault, b, sum(tokens) / count(*) AS s FROM x GROUP BY ALL)
SELECT fault, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM s GROUP BY fault""")
def bootstrap_mean(spark, d):
    e = fx.experiment(spark, d).withColumn("unit", F.col("seed") * 3 + F.col("policy"))
    return st.bootstrap_ci(e, "fault", "tokens", "unit", "mean", 200, "tokens")


@query("bootstrap_p95", w(EXPERIMENT) + DRAWS + """
, s AS (SELECT fault, b, quantile_cont(tokens, 0.95) AS s FROM x GROUP BY ALL)
SELECT fault, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM s GROUP BY fault""")
def bootstrap_p95(spark, d):
    e = fx.experiment(spark, d).withColumn("unit", F.col("seed") * 3 + F.col("policy"))
    return st.bootstrap_ci(e, "fault", "tokens", "unit", "p95", 200, "tokens")


@query("bootstrap_trimmed", w(EXPERIMENT) + DRAWS + """
, r AS (SELECT fault, b, tokens, row_number() OVER (PARTITION BY fault, b ORDER BY tokens) AS i, count(*) OVER (PARTITION BY fault, b) AS n FROM x),
s AS (SELECT fault, b, sum(tokens) / count(*) AS s FROM r WHERE i > n // 10 AND i <= n - n // 10 GROUP BY ALL)
SELECT fault, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM s GROUP BY fault""")
def bootstrap_trimmed(spark, d):
    """A statistic of the caller: the mean without a tenth at either end."""
    e = fx.experiment(spark, d).withColumn("unit", F.col("seed") * 3 + F.col("policy"))
    return st.bootstrap(e, ["fault"], "tokens", "unit", 200, F.concat_ws(":", F.lit("tokens"), "fault"), st.trimmed_mean(0.1), merge=True)


@query("bootstrap_poisson", w(EXPERIMENT) + f"""
, b AS (SELECT unnest(range(1, 201)) AS b),
u AS (SELECT fault, b, tokens, CAST(('0x' || substr(md5('tokens:' || fault || '|' || b || '|' || (seed * 3 + policy)), 1, 15)) AS BIGINT) AS u FROM experiment, b),
x AS (SELECT *, len(list_filter({st.POISSON_STEPS}, lambda t: t <= u)) AS w FROM u),
s AS (SELECT fault, b, sum(w * tokens) / sum(w) AS s FROM x WHERE w > 0 GROUP BY ALL)
SELECT fault, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM s GROUP BY fault""")
def bootstrap_poisson(spark, d):
    """The interval of the mean, each trial held a Poisson number of times."""
    e = fx.experiment(spark, d).withColumn("unit", F.col("seed") * 3 + F.col("policy"))
    return st.bootstrap(e, ["fault"], "tokens", "unit", 200, F.concat_ws(":", F.lit("tokens"), "fault"), weights=st.poisson_weights)


PAIRED = w(EXPERIMENT) + """
, pd AS (SELECT c.seed, c.fault, c.policy, CAST(c.success AS BIGINT) - CAST(b.success AS BIGINT) AS success_delta,
  CASE WHEN c.success AND b.success THEN c.makespan - b.makespan END AS success_makespan_delta,
  CASE WHEN c.success AND b.success THEN c.tokens - b.tokens END AS success_tokens_delta,
  CASE WHEN NOT c.success AND NOT b.success THEN c.makespan - b.makespan END AS failure_makespan_delta
  FROM experiment c JOIN experiment b ON c.seed = b.seed AND c.fault = b.fault AND b.policy = 0 WHERE c.policy <> 0)"""


def _paired(spark, d):
    return st.paired(fx.experiment(spark, d), ["seed", "fault"], "policy", 0, "success", ["makespan", "tokens"], ["makespan"])


@query("paired_deltas", PAIRED + " SELECT * FROM pd")
def paired_deltas(spark, d):
    return _paired(spark, d)


@query("paired_delta_summary", PAIRED + """
, v AS (SELECT fault, policy, fault || '/' || policy AS k, success_tokens_delta AS x, row_number() OVER (PARTITION BY fault, policy ORDER BY seed) - 1 AS i,
   count(*) OVER (PARTITION BY fault, policy) AS n FROM pd WHERE success_tokens_delta IS NOT NULL),
q AS (SELECT k, b, CAST(('0x' || substr(md5('delta:' || k || '|' || b || '|' || i), 1, 15)) AS BIGINT) % n AS i FROM v, (SELECT unnest(range(1, 201)) AS b)),
s AS (SELECT q.k, q.b, sum(v.x) / count(*) AS s FROM q JOIN v ON v.k = q.k AND v.i = q.i GROUP BY ALL),
e AS (SELECT k, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM s GROUP BY k),
g AS (SELECT fault, policy, k, count(*) AS pairs, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS p50 FROM v GROUP BY ALL)
SELECT fault, policy, pairs, mean, p50, low, high FROM g JOIN e USING (k)""")
def paired_delta_summary(spark, d):
    return st.delta_summary(_paired(spark, d), ["fault", "policy"], "success_tokens_delta", "seed", 200, "delta")


@query("design_gaps", w(EXPERIMENT) + """
, x AS (SELECT seed, CASE WHEN seed % 31 = 0 AND policy = 1 THEN 'odd-' || fault ELSE fault END AS fault, policy FROM experiment
        WHERE NOT (seed % 29 = 0 AND policy = 2 AND fault = 'view')
        UNION ALL SELECT seed, fault, policy FROM experiment WHERE seed % 37 = 0 AND policy = 0),
g AS (SELECT seed, fault, policy, count(*) AS n FROM x GROUP BY ALL),
grid AS (SELECT seed, fault, policy FROM (SELECT DISTINCT seed FROM x), (SELECT unnest(['signup','purchase','error','view','click']) AS fault),
         (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS policy))
SELECT coalesce(a.seed, g.seed) AS seed, coalesce(a.fault, g.fault) AS fault, coalesce(a.policy, g.policy) AS policy,
  CASE WHEN g.n IS NULL THEN 'missing' WHEN a.seed IS NULL THEN 'unknown' ELSE 'duplicate' END AS code
FROM grid a FULL JOIN g ON a.seed = g.seed AND a.fault = g.fault AND a.policy = g.policy WHERE a.seed IS NULL OR n IS NULL OR n > 1""")
def design_gaps(spark, d):
    e = fx.experiment(spark, d).select("seed", "fault", "policy")
    kept = e.where("not (seed % 29 = 0 and policy = 2 and fault = 'view')").withColumn(
        "fault", F.when((F.col("seed") % 31 == 0) & (F.col("policy") == 1), F.concat(F.lit("odd-"), "fault")).otherwise(F.col("fault"))
    )
    x = kept.unionByName(e.where("seed % 37 = 0 and policy = 0"))
    return st.design_gaps(x, "seed", {"fault": ["signup", "purchase", "error", "view", "click"], "policy": [0, 1, 2]})


@query("design_witnesses", w(EXPERIMENT) + """
SELECT seed, fault, count(DISTINCT CASE WHEN seed % 41 = 0 THEN policy ELSE 0 END) AS identities, count(DISTINCT policy) AS policies,
  count(DISTINCT CASE WHEN seed % 41 = 0 THEN policy ELSE 0 END) = 1 AND count(DISTINCT policy) = 3 AS passed FROM experiment GROUP BY ALL""")
def design_witnesses(spark, d):
    e = fx.experiment(spark, d).withColumn("ident", F.when(F.col("seed") % 41 == 0, F.col("policy")).otherwise(0))
    return st.witnesses(e, ["seed", "fault"], ["ident"], "policy", [0, 1, 2])


@query("binding_conditions", w(EXPERIMENT) + """
SELECT fault, policy, bool_or(success) AS any_pass, bool_and(success) AS all_pass, bool_or(success) AND NOT bool_and(success) AS binding
FROM experiment GROUP BY ALL""")
def binding_conditions(spark, d):
    return st.binding(fx.experiment(spark, d), ["fault", "policy"], "success")


def _nearest(column: str, q: float) -> str:
    return f"list_sort(list({column}) FILTER (WHERE {column} IS NOT NULL))[greatest(1, CAST(ceil({q}::DOUBLE * count({column})) AS BIGINT))]"


def _trial_sql(key: str) -> str:
    times = [("duration", q) for q in (50, 95, 99)] + [("recovery", q) for q in (50, 95, 99)] + [("direct", 50), ("overhead", 50)]
    ranked = ", ".join(f"{_nearest(c, q / 100)} AS p{q}_{c}" for c, q in times)
    return f"""{key}, count(*) AS trials, count(*) FILTER (WHERE passed) AS passes, round(count(*) FILTER (WHERE passed) / count(*), 6) AS pass_rate,
  round(pow(count(*) FILTER (WHERE passed) / count(*), count(*)), 12) AS pass_pow_k, bool_and(passed) AS all_k, {ranked},
  CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(effects) AS BIGINT) AS effects, CAST(sum(duplicates) AS BIGINT) AS duplicates"""


@query("trial_summary", w(TRIALS) + f" SELECT {_trial_sql('seed')} FROM trials GROUP BY seed")
def trial_summary(spark, d):
    return st.trial_summary(fx.trials(spark, d), "seed")


@query("survival_report", w(TRIALS) + f"""
, u AS (SELECT * FROM trials UNION ALL SELECT * REPLACE (NULL AS scenario) FROM trials)
SELECT {_trial_sql('scenario')} FROM u GROUP BY scenario""")
def survival_report(spark, d):
    from tallyline.plans.reports import survival_report as report

    return report(fx.trials(spark, d))


@query("slo_classification", w(EVENTS) + """
, r AS (SELECT event_id, CASE WHEN kind IN ('signup', 'purchase') THEN 'passed' WHEN kind = 'error' THEN 'error' ELSE 'refused' END AS outcome,
   CASE WHEN kind = 'signup' THEN 'proposed' ELSE 'none' END AS effect_state, k % 11 = 0 AS calls, CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS effects,
   k % 17 <> 0 AS deadline_passed, k % 3 = 0 AS recorded FROM ev),
s AS (SELECT *, NOT calls AND effects = 0 AND ((outcome = 'passed' AND effect_state = 'proposed') OR (outcome = 'refused' AND effect_state = 'none')) AS guard FROM r)
SELECT event_id, guard AS guardrail_passed, outcome = 'refused' AND guard AS safe_refusal, outcome = 'passed' AND deadline_passed AND guard AS slo_passed,
  recorded <> (outcome = 'passed' AND deadline_passed AND guard) AS inconsistent FROM s""")
def slo_classification(spark, d):
    k = F.col("kind")
    e = fx.events(spark, d).select(
        "event_id", F.when(k.isin("signup", "purchase"), "passed").when(k == "error", "error").otherwise("refused").alias("outcome"),
        F.when(k == "signup", "proposed").otherwise("none").alias("effect_state"), (F.col("k") % 11 == 0).alias("calls"),
        F.when(F.col("k") % 13 == 0, 1).otherwise(0).alias("effects"), (F.col("k") % 17 != 0).alias("deadline_passed"),
        (F.col("k") % 3 == 0).alias("recorded"),
    )
    guard, refusal = st.classify_safety(F.col("outcome"), F.col("effect_state"), F.col("calls"), F.col("effects"), F.lit(0))
    slo = (F.col("outcome") == "passed") & F.col("deadline_passed") & guard
    return e.select("event_id", guard.alias("guardrail_passed"), refusal.alias("safe_refusal"), slo.alias("slo_passed"),
                    (F.col("recorded") != slo).alias("inconsistent"))


@query("balanced_order", """
WITH s AS (SELECT DISTINCT user_id AS sample, event_type AS system FROM events),
b AS (SELECT sample, system, row_number() OVER (PARTITION BY sample ORDER BY md5('rotate:' || system), system) - 1 AS base,
        count(*) OVER (PARTITION BY sample) AS n FROM s),
t AS (SELECT *, CASE WHEN (sample // n) % 2 = 1 THEN n - 1 - base ELSE base END AS turned FROM b)
SELECT 0 AS block, sample, system, ((turned - sample) % n + n) % n AS position FROM t""")
def balanced_order(spark, d):
    s = fx.table(spark, d, "events").select(F.lit(0).cast("long").alias("block"), F.col("user_id").alias("sample"),
                                            F.col("event_type").alias("system")).distinct()
    return st.balanced_order(s, "block", "sample", "system", "rotate")


@query("experiment_summary", w(EXPERIMENT) + f"""
, g AS (SELECT fault, policy, CAST(count(*) AS BIGINT) AS runs, count(*) FILTER (WHERE success) AS passes,
   round(quantile_cont(makespan, 0.5) FILTER (WHERE success), 6) AS success_p50_makespan,
   round(quantile_cont(tokens, 0.95) FILTER (WHERE success), 6) AS success_p95_tokens,
   round(quantile_cont(makespan, 0.5) FILTER (WHERE NOT success), 6) AS failure_p50_makespan FROM experiment GROUP BY ALL)
SELECT *, round(passes / runs, 6) AS pass_rate, {WILSON_LOW} AS wilson_low, {WILSON_HIGH} AS wilson_high,
  passes > 0 AND passes < runs AS binding FROM g""")
def experiment_summary(spark, d):
    from tallyline.plans.reports import experiment_summary as report

    return report(fx.experiment(spark, d))


def _intervals(source: str) -> str:
    """``source``: k, seed, x.  Values, p50 and p95 per k with intervals of 50 resamples, in ``sums``."""
    return f"""v AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY seed) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM {source}),
qs AS (SELECT s, k, b, CAST(('0x' || substr(md5(s || ':' || k || '|' || b || '|' || i), 1, 15)) AS BIGINT) % n AS i
  FROM v, (SELECT unnest(range(1, 51)) AS b), (SELECT unnest(['p50', 'p95', 'delta']) AS s)),
es AS (SELECT qs.s, qs.k, qs.b, coalesce(quantile_cont(v.x, 0.5) FILTER (WHERE qs.s = 'p50'), quantile_cont(v.x, 0.95) FILTER (WHERE qs.s = 'p95'), sum(v.x) / count(*)) AS e FROM qs JOIN v ON v.k = qs.k AND v.i = qs.i GROUP BY ALL),
ends AS (SELECT k, {", ".join(f"round(quantile_cont(e, {q}) FILTER (WHERE s = '{s}'), 6) AS {s}_{n}" for s in ("p50", "p95", "delta") for n, q in (("low", 0.025), ("high", 0.975)))} FROM es GROUP BY k),
sums AS (SELECT k, count(*) AS "values", round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95 FROM v GROUP BY k)"""


@query("experiment_metrics", w(EXPERIMENT) + f"""
, l AS (SELECT fault, policy, seed, unnest(['success_makespan', 'success_tokens', 'success_cost', 'success_context', 'time_to_failure']) AS measure,
   unnest([CASE WHEN success THEN makespan END, CASE WHEN success THEN tokens END, CASE WHEN success THEN cost END, CASE WHEN success THEN context END, CASE WHEN NOT success THEN makespan END]) AS x FROM experiment),
src AS (SELECT fault || '/' || policy || '/' || measure AS k, * FROM l WHERE x IS NOT NULL), {_intervals('src')}
SELECT DISTINCT fault, policy, measure, "values", p50, p95, p50_low, p50_high, p95_low, p95_high FROM src JOIN sums USING (k) JOIN ends USING (k)""")
def experiment_metrics(spark, d):
    from tallyline.plans.reports import experiment_metrics as report

    return report(fx.experiment(spark, d), 50)


@query("experiment_reasons", w(EXPERIMENT) + """
SELECT fault, policy, coalesce(reason, 'unspecified') AS reason, count(*) AS runs FROM experiment WHERE NOT success GROUP BY ALL""")
def experiment_reasons(spark, d):
    from tallyline.plans.reports import experiment_reasons as report

    return report(fx.experiment(spark, d))


@query("experiment_deltas", w(EXPERIMENT) + f"""
, pr AS (SELECT c.*, c.success AND b.success AS pass2, NOT c.success AND NOT b.success AS fail2, CAST(c.success AS BIGINT) - CAST(b.success AS BIGINT) AS ds, c.makespan - b.makespan AS dm,
   c.tokens - b.tokens AS dt, c.cost - b.cost AS dc, c.context - b.context AS dx FROM experiment c JOIN experiment b ON c.seed = b.seed AND c.fault = b.fault AND b.policy = 0 WHERE c.policy <> 0),
l AS (SELECT fault, policy, seed, unnest(['success_delta', 'success_makespan_delta', 'success_tokens_delta', 'success_cost_delta', 'success_context_delta', 'failure_makespan_delta']) AS measure,
   unnest([ds, CASE WHEN pass2 THEN dm END, CASE WHEN pass2 THEN dt END, CASE WHEN pass2 THEN dc END, CASE WHEN pass2 THEN dx END, CASE WHEN fail2 THEN dm END]) AS x FROM pr),
src AS (SELECT fault || '/' || policy || '/' || measure AS k, * FROM l WHERE x IS NOT NULL), {_intervals('src')}
SELECT DISTINCT fault, policy, measure, "values" AS pairs, mean, p50, delta_low AS low, delta_high AS high FROM src JOIN sums USING (k) JOIN ends USING (k)""")
def experiment_deltas(spark, d):
    from tallyline.plans.reports import experiment_deltas as report

    return report(fx.experiment(spark, d), 0, 50)


@query("benchmark_summary", w(EVENTS) + f"""
, r AS (SELECT kind AS system, run_id AS seed, CASE WHEN sequence = 1 THEN 'warmup' ELSE 'measured' END AS phase, max(units) AS duration, bool_and(k % 5 <> 0) AS slo,
   CASE WHEN bool_or(k % 7 = 0) THEN 'refused' WHEN bool_or(k % 11 = 0) THEN 'error' ELSE 'passed' END AS outcome, bool_and(k % 13 <> 0) AS guardrail,
   bool_or(k % 7 = 0) AND bool_and(k % 13 <> 0) AS safe, count(*) FILTER (WHERE k % 17 = 0) AS bad FROM ev GROUP BY ALL),
m AS (SELECT * FROM r WHERE phase = 'measured'),
g AS (SELECT system, CAST(count(*) AS BIGINT) AS runs, count(*) FILTER (WHERE slo) AS passes, count(*) FILTER (WHERE outcome = 'refused') AS refusals, count(*) FILTER (WHERE safe) AS safe_refusals,
   count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE bad > 0) AS unsafe_runs, count(*) FILTER (WHERE guardrail) AS guardrail_passes FROM m GROUP BY system),
pd AS (SELECT c.system, c.seed, b.duration - c.duration AS x FROM m c JOIN m b ON c.seed = b.seed AND b.system = 'view' WHERE c.slo AND b.slo AND c.system <> 'view'),
src AS (SELECT system AS k, seed, duration AS x FROM m WHERE slo),
dd AS (SELECT system AS k, x, row_number() OVER (PARTITION BY system ORDER BY seed) - 1 AS i, count(*) OVER (PARTITION BY system) AS n FROM pd),
dq AS (SELECT k, b, CAST(('0x' || substr(md5('delta:' || k || '|' || b || '|' || i), 1, 15)) AS BIGINT) % n AS i FROM dd, (SELECT unnest(range(1, 51)) AS b)),
de AS (SELECT dq.k, dq.b, sum(dd.x) / count(*) AS e FROM dq JOIN dd ON dd.k = dq.k AND dd.i = dq.i GROUP BY ALL),
dn AS (SELECT k, round(quantile_cont(e, 0.025), 6) AS delta_low, round(quantile_cont(e, 0.975), 6) AS delta_high FROM de GROUP BY k),
ds AS (SELECT k, count(*) AS pairs, round(avg(x), 6) AS mean_delta, round(quantile_cont(x, 0.5), 6) AS p50_delta FROM dd GROUP BY k), {_intervals('src')}
SELECT system, runs, passes, refusals, safe_refusals, errors, unsafe_runs, guardrail_passes, round(passes / runs, 6) AS pass_rate, {WILSON_LOW} AS wilson_low, {WILSON_HIGH} AS wilson_high,
  round(guardrail_passes / runs, 6) AS guardrail_rate, {WILSON_LOW.replace("passes", "guardrail_passes")} AS guardrail_low, {WILSON_HIGH.replace("passes", "guardrail_passes")} AS guardrail_high,
  (SELECT count(*) FROM r WHERE r.system = g.system AND phase = 'warmup') AS warmups, p50, p95, p50_low, p50_high, p95_low, p95_high,
  CASE WHEN system <> 'view' THEN coalesce(pairs, 0) END AS eligible_pairs, CASE WHEN system <> 'view' THEN runs - coalesce(pairs, 0) END AS excluded_pairs, mean_delta, p50_delta, dn.delta_low, dn.delta_high
FROM g LEFT JOIN sums ON sums.k = system LEFT JOIN ends ON ends.k = system LEFT JOIN ds ON ds.k = system LEFT JOIN dn ON dn.k = system""")
def benchmark_summary(spark, d):
    from tallyline.plans.reports import benchmark_summary as report

    k = F.col("k")
    refused, guarded = F.bool_or(k % 7 == 0), F.bool_and(k % 13 != 0)
    r = fx.events(spark, d).groupBy(
        F.col("kind").alias("system"), F.col("run_id").alias("seed"), F.when(F.col("sequence") == 1, "warmup").otherwise("measured").alias("phase")).agg(
        F.max("units").alias("duration"), F.bool_and(k % 5 != 0).alias("slo"), F.when(refused, "refused").when(F.bool_or(k % 11 == 0), "error").otherwise("passed").alias("outcome"),
        guarded.alias("guardrail"), (refused & guarded).alias("safe_refusal"), F.count_if(k % 17 == 0).alias("unauthorized"))
    return report(r, "view", 50)


@query("load_gates", w(EVENTS) + """
SELECT run_id, count(*) FILTER (WHERE kind <> 'error') AS accepted, count(DISTINCT k) AS unique_ids, count(*) AS proposed,
  count(*) FILTER (WHERE kind = 'purchase') AS committed,
  count(*) FILTER (WHERE kind <> 'error') >= 50 AND count(DISTINCT k) = count(*) AND count(*) FILTER (WHERE kind = 'purchase') = 0 AS passed
FROM ev GROUP BY run_id""")
def load_gates(spark, d):
    k = F.col("kind")
    g = fx.events(spark, d).groupBy("run_id").agg(
        F.count_if(k != "error").alias("accepted"), F.countDistinct("k").alias("unique_ids"), F.count("*").alias("proposed"),
        F.count_if(k == "purchase").alias("committed"),
    )
    return g.withColumn("passed", (F.col("accepted") >= 50) & (F.col("unique_ids") == F.col("proposed")) & (F.col("committed") == 0))


@query("coverage_floors", """
WITH g AS (SELECT l_suppkey AS report, count(*) AS measured, count(*) FILTER (WHERE l_returnflag = 'N') AS covered FROM lineitem GROUP BY ALL),
h AS (SELECT report, CASE WHEN report % 19 = 0 THEN measured + 1 ELSE covered END AS covered, measured FROM g)
SELECT report, 'covered_above_measured' AS code FROM h WHERE covered > measured
UNION ALL SELECT report, 'below_floor' FROM h WHERE 100.0 * covered / measured + 1e-12 < 33.0""")
def coverage_floors(spark, d):
    g = fx.attempts(spark, d).groupBy(F.col("provider").alias("report")).agg(
        F.count("*").alias("measured"), F.count_if(F.col("outcome") == "completed").alias("covered")
    )
    g = g.withColumn("covered", F.when(F.col("report") % 19 == 0, F.col("measured") + 1).otherwise(F.col("covered")))
    return flagged(g, {
        "covered_above_measured": F.col("covered") > F.col("measured"),
        "below_floor": 100.0 * F.col("covered") / F.col("measured") + 1e-12 < 33.0,
    }, ["report"])
