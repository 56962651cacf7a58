"""Composite reports over runs and their tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog.graphs import RANKS, RW, _down
from tallyline.catalog.evidence import FACILITIES, _allocations, _facilities, _routes
from tallyline.catalog.registry import ORACLES, query
from tallyline.catalog.sqlviews import ARTIFACTS, ATTEMPTS, DEPS, EVENTS, RUNS, TASKS, w
from tallyline.operators.scan import rcount, running
from tallyline.plans import conservation as cv
from tallyline.plans.audits import PLAN_CHECKS
from tallyline.session import dealt, in_place

L = F.lit
DEADLINE = 40 * 86_400_000


def _schedule(spark, d):
    """Entries relative to their run's first start, and run rows over them."""
    t = dealt(fx.tasks(spark, d), "run_id")  # seven tasks of a run at most
    first = t.groupBy("run_id").agg(F.min("start_ms").alias("z"))
    e = t.join(first, "run_id").select(
        "run_id", "task_id", L("p").alias("backend"), "provider", (F.col("start_ms") - F.col("z")).alias("start_ms"), (F.col("end_ms") - F.col("z")).alias("end_ms"),
        L("completed").alias("outcome"), "optional", "tokens", "cost", "context", L(0.99).alias("probability"))
    cap = fx.runs(spark, d).select("run_id", F.col("cost_cap").alias("max_cost"))
    n = F.count("*")
    runs = e.groupBy("run_id").agg(
        F.max("end_ms").alias("makespan"), F.sum("tokens").alias("total_tokens"), (F.sum("cost") + F.when(F.first("run_id") % 71 == 0, 1).otherwise(0)).alias("total_cost"),
        F.sum("context").alias("total_context"), (F.pow(L(0.99), n) + F.when(F.first("run_id") % 89 == 0, 0.1).otherwise(0.0)).alias("success_probability")).join(cap, "run_id")
    runs = runs.select("*", (F.col("run_id") % 67 != 0).alias("success"), L(0).cast("long").alias("model_bound"), L(DEADLINE).cast("long").alias("deadline_ms"), L(300).alias("max_tokens"),
                       L(10**9).alias("max_context"), L(3).cast("long").alias("max_parallelism"), L(0.95).alias("success_floor"))
    return e, runs


@query("conservation_report", w(TASKS, RUNS, DEPS) + """
, e AS (SELECT *, start_ms - min(start_ms) OVER (PARTITION BY run_id) AS s, end_ms - min(start_ms) OVER (PARTITION BY run_id) AS f FROM tasks),
g AS (SELECT run_id, count(*) AS n, max(f) AS makespan, sum(tokens) AS tokens, sum(cost) AS cost, max(cost_cap) AS cap, run_id % 67 <> 0 AS success FROM e JOIN runs USING (run_id) GROUP BY run_id),
m AS (SELECT run_id, provider, t, sum(v) AS v FROM (SELECT run_id, provider, s AS t, 1 AS v FROM e UNION ALL SELECT run_id, provider, f, -1 FROM e) GROUP BY ALL),
pk AS (SELECT run_id, provider, max(l) AS pk FROM (SELECT run_id, provider, sum(v) OVER (PARTITION BY run_id, provider ORDER BY t) AS l FROM m) GROUP BY ALL),
mw AS (SELECT run_id, t, sum(v) AS v FROM m GROUP BY ALL), pw AS (SELECT run_id, max(l) AS pk FROM (SELECT run_id, sum(v) OVER (PARTITION BY run_id ORDER BY t) AS l FROM mw) GROUP BY ALL),
conc AS (SELECT run_id FROM pw WHERE pk > 3 UNION SELECT run_id FROM pk WHERE pk > least(1 + provider % 4, 3)),
dep AS (SELECT DISTINCT d.run_id FROM deps d JOIN e c ON c.run_id = d.run_id AND c.task_id = d.task_id JOIN e p ON p.run_id = d.run_id AND p.task_id = d.dep_id WHERE p.f > c.s),
ser AS (SELECT DISTINCT a.run_id FROM e a JOIN e b ON a.run_id = b.run_id AND a.task_id < b.task_id AND a.task_id % 3 = b.task_id % 3 AND a.s < b.f AND b.s < a.f AND (a.task_id % 2 = 0 OR b.task_id % 2 = 0)),
late AS (SELECT DISTINCT run_id FROM e WHERE f > 3456000000),
c AS (SELECT unnest(['entry-identity','entry-shape','profile-integrity','task-deadlines','event-order','event-identity','run-lifecycle','task-lifecycle','skip-integrity','dependency-order',
  'successful-run-completeness','resource-accounting','resource-caps','modeled-reliability','concurrency-caps','effect-serialization','model-bound','run-deadline']) AS "check")
SELECT run_id, "check", CASE "check" WHEN 'entry-shape' THEN run_id % 101 <> 0 WHEN 'profile-integrity' THEN run_id % 61 <> 0 WHEN 'task-deadlines' THEN run_id NOT IN (SELECT run_id FROM late)
  WHEN 'event-order' THEN run_id % 73 <> 0 WHEN 'event-identity' THEN run_id % 103 <> 0 WHEN 'task-lifecycle' THEN run_id % 79 <> 0 WHEN 'skip-integrity' THEN run_id % 83 <> 0
  WHEN 'dependency-order' THEN run_id NOT IN (SELECT run_id FROM dep) WHEN 'resource-accounting' THEN run_id % 71 <> 0 WHEN 'resource-caps' THEN tokens <= 300 AND cost <= cap
  WHEN 'modeled-reliability' THEN run_id % 89 <> 0 AND NOT (success AND n > 5) WHEN 'concurrency-caps' THEN run_id NOT IN (SELECT run_id FROM conc)
  WHEN 'effect-serialization' THEN run_id NOT IN (SELECT run_id FROM ser) WHEN 'model-bound' THEN NOT success WHEN 'run-deadline' THEN NOT (success AND makespan > 3456000000) ELSE true END AS passed
FROM g, c""")
def conservation_report(spark, d):
    e, runs = _schedule(spark, d)
    profiles = e.select("run_id", "task_id", L("p").alias("name"), "provider", (F.col("end_ms") - F.col("start_ms")).alias("p95"), "tokens",
                        (F.col("cost") + F.when(F.col("run_id") % 61 == 0, 1).otherwise(0)).alias("cost"), "context", L(0.9).alias("quality"), L(0.01).alias("failure"))
    tasks = e.select("run_id", "task_id", "optional", L(0.5).alias("min_quality"), L(None).cast("long").alias("deadline_ms"), F.concat(L("r"), (F.col("task_id") % 3).cast("string")).alias("resource"), (F.col("task_id") % 2 == 0).alias("writes"))
    marks = F.array(*[F.struct(L(k).alias("kind"), F.col(c).alias("at"), L(o).alias("o")) for k, c, o in
                      (("profile.selected", "start_ms", 1), ("task.started", "start_ms", 2), ("task.completed", "end_ms", 3))])
    own = e.select("run_id", "task_id", F.explode(marks).alias("m")).select("run_id", "task_id", "m.*")
    least = e.groupBy("run_id").agg(F.min("task_id").alias("least"))
    own = own.join(least, "run_id").where(~((F.col("run_id") % 79 == 0) & (F.col("task_id") == F.col("least")) & (F.col("kind") == "profile.selected"))).drop("least")
    ends = F.when(F.col("success"), "run.completed").otherwise("run.failed")
    bounds = runs.select("run_id", F.explode(F.array(F.struct(L(None).cast("long").alias("task_id"), L("run.started").alias("kind"), L(0).cast("long").alias("at"), L(0).alias("o")),
                                                     F.struct(F.when(F.col("run_id") % 103 == 0, 1).cast("long").alias("task_id"), ends.alias("kind"), F.col("makespan").alias("at"), L(9).alias("o")))).alias("m")).select("run_id", "m.*")
    log = running(dealt(own.unionByName(bounds), "run_id"), ["run_id"], "at", {"sequence": rcount()}, tie=["o", "task_id"])
    log = log.withColumn("sequence", F.col("sequence") + F.when(F.col("run_id") % 73 == 0, 1).otherwise(0)).drop("o")
    skipped = least.where("run_id % 83 = 0").select("run_id", F.col("least").alias("task_id"))
    entries = e.withColumn("optional", F.when(F.col("run_id") % 101 == 0, ~F.col("optional")).otherwise(F.col("optional")))
    with in_place(spark):
        return cv.conservation_report(runs, tasks, profiles, fx.deps(spark, d), entries, log, skipped, fx.providers(spark, d).select("provider", "limit"))


@query("preflight_report", RW(TASKS, RUNS, DEPS) + RANKS + """
, b AS (SELECT run_id, max(len) AS bound FROM walk GROUP BY run_id),
g AS (SELECT run_id, count(*) AS n, max(end_ms) - min(start_ms) AS makespan, sum(tokens) AS tokens, sum(cost) AS cost, sum(context) AS context, max(cost_cap) AS cap, run_id % 67 <> 0 AS ok,
  count(*) FILTER (WHERE optional AND tokens % 5 = 0) AS skipped FROM tasks JOIN runs USING (run_id) GROUP BY run_id)
SELECT run_id, CASE WHEN NOT ok THEN 'refused' WHEN skipped > 0 THEN 'degraded' ELSE 'feasible' END AS status, bound, u.c AS "constraint",
  CASE u.c WHEN 'deadline' THEN ok AND makespan <= 3456000000 WHEN 'tokens' THEN tokens <= 100 WHEN 'cost' THEN cost <= cap WHEN 'context_movement' THEN context <= 9000
   WHEN 'modeled_success_probability' THEN ok AND n <= 5 ELSE ok END AS passed, u.unit
FROM g JOIN b USING (run_id), (VALUES ('deadline', 'ms'), ('tokens', 'tokens'), ('cost', 'micro-USD'), ('context_movement', 'bytes'), ('modeled_success_probability', 'independent-profile probability'), ('required_work', 'state')) u(c, unit)""")
def preflight_report(spark, d):
    from tallyline.operators import graph as gr

    t = fx.tasks(spark, d)
    path = gr.critical_path(t.select("run_id", F.col("task_id").alias("node"), (F.col("end_ms") - F.col("start_ms")).alias("w")), _down(spark, d), ["run_id"], "w")
    g = t.groupBy("run_id").agg((F.max("end_ms") - F.min("start_ms")).alias("makespan"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("context").alias("context"),
                                F.pow(L(0.99), F.count("*")).alias("probability"), F.count_if(F.col("optional") & (F.col("tokens") % 5 == 0)).alias("skipped"))
    x = g.join(fx.runs(spark, d).select("run_id", F.col("cost_cap").alias("max_cost")), "run_id").join(path, "run_id").select(
        "*", F.col("critical_path").alias("bound"), (F.col("run_id") % 67 != 0).alias("success"), L(DEADLINE).alias("deadline_ms"), L(100).alias("max_tokens"), L(9000).alias("max_context"), L(0.95).alias("success_floor"))
    return cv.preflight(x)


@query("physical_admission", RW(TASKS, DEPS) + """
, loc AS (SELECT run_id, task_id, CASE WHEN run_id % 37 = 0 THEN NULL ELSE ((context + tokens) * 8000 + 999) // 1000 END AS mv, provider % 50 AS rtt FROM tasks),
wk AS (SELECT run_id, task_id, mv, mv + rtt AS bo FROM loc UNION SELECT d.run_id, d.dep_id, wk.mv + l.mv, wk.bo + l.mv + l.rtt FROM wk JOIN deps d ON d.run_id = wk.run_id AND d.task_id = wk.task_id
  JOIN loc l ON l.run_id = d.run_id AND l.task_id = d.dep_id),
p AS (SELECT run_id, CAST(max(mv) AS BIGINT) AS mv, CAST(max(bo) AS BIGINT) AS bo FROM wk GROUP BY run_id),
r AS (SELECT run_id, tokens, cost, row_number() OVER (PARTITION BY run_id ORDER BY tokens DESC) AS a, row_number() OVER (PARTITION BY run_id ORDER BY cost DESC) AS b FROM tasks),
k AS (SELECT run_id, sum(tokens) FILTER (WHERE a <= 3) AS mem, sum(cost) FILTER (WHERE b <= 3) AS vram FROM r GROUP BY run_id),
g AS (SELECT run_id, sum(tokens) * 10 AS cpu, sum(context) AS ctx, sum(tokens) AS tok, count(*) AS n, max(provider % 50) AS rtt FROM tasks GROUP BY run_id),
x AS (SELECT * FROM g JOIN k USING (run_id) JOIN p USING (run_id))
SELECT run_id, dimension, CAST(observed AS BIGINT) AS observed, CAST(lim AS BIGINT) AS "limit", coalesce(CASE WHEN dimension = 'transport_bandwidth_defined' THEN observed IS NOT NULL ELSE observed <= lim END, false) AS passed, unit FROM (
  SELECT run_id, 'cpu_time' AS dimension, cpu AS observed, 1500 AS lim, 'units' AS unit FROM x UNION ALL SELECT run_id, 'storage_read', ctx, 9000, 'units' FROM x
  UNION ALL SELECT run_id, 'storage_write', 0, 0, 'units' FROM x UNION ALL SELECT run_id, 'network_ingress', ctx, 12000, 'units' FROM x UNION ALL SELECT run_id, 'network_egress', tok, 200, 'units' FROM x
  UNION ALL SELECT run_id, 'egress_cost', n, 4, 'units' FROM x UNION ALL SELECT run_id, 'peak_memory', mem, 120, 'units' FROM x UNION ALL SELECT run_id, 'peak_vram', vram, 20000000, 'units' FROM x
  UNION ALL SELECT run_id, 'bandwidth', mem, CASE WHEN run_id % 37 = 0 THEN 0 ELSE 1000 END, 'bits-per-second' FROM x UNION ALL SELECT run_id, 'network_rtt', rtt, 45, 'milliseconds' FROM x
  UNION ALL SELECT run_id, 'transport_rtt_deadline_lower_bound', bo, 100000, 'milliseconds' FROM x UNION ALL SELECT run_id, 'transport_bandwidth_defined', mv, 100000, 'milliseconds' FROM x)""")
def physical_admission(spark, d):
    t = fx.tasks(spark, d)
    z = L(0).cast("long")
    s = t.select("run_id", "task_id", (F.col("tokens") * 10).alias("cpu_time"), F.col("context").alias("storage_read"), z.alias("storage_write"), F.col("context").alias("network_ingress"),
                 F.col("tokens").alias("network_egress"), L(1).cast("long").alias("egress_cost"), F.col("tokens").alias("peak_memory"), F.col("cost").alias("peak_vram"), F.col("tokens").alias("bandwidth"),
                 (F.col("provider") % 50).alias("rtt"))
    caps = {"cpu_time": 1500, "storage_read": 9000, "storage_write": 0, "network_ingress": 12000, "network_egress": 200, "egress_cost": 4, "peak_memory": 120, "peak_vram": 20000000, "rtt": 45}
    e = t.select("run_id").distinct().select("run_id", L(3).cast("long").alias("parallelism"), F.when(F.col("run_id") % 37 == 0, 0).otherwise(1000).cast("long").alias("available_bandwidth"), L(100000).alias("deadline_ms"),
                                             *[L(v).alias(f"max_{k}") for k, v in caps.items()])
    return cv.physical_admission(s, e, _down(spark, d))


@query("run_ledger_checks", w(EVENTS) + """
, x AS (SELECT run_id, sequence, event_id - CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS ident, kind, units, CASE WHEN event_id % 79 = 0 THEN units + 1 ELSE units END AS actual FROM ev WHERE event_id % 211 <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS pos FROM x),
g AS (SELECT run_id, bool_and(sequence = pos) AS c, count(*) FILTER (WHERE kind = 'signup') AS starts, count(*) FILTER (WHERE kind = 'error') AS ends,
  bool_and(kind <> 'purchase' OR actual <= units) AS res, sum(CASE WHEN kind = 'purchase' THEN actual ELSE 0 END) AS used, count(*) = count(DISTINCT ident) AS uniq FROM p GROUP BY run_id)
SELECT run_id, u.c AS "check", CASE u.c WHEN 'contiguous-sequences' THEN g.c WHEN 'unique-event-ids' THEN uniq WHEN 'single-run-start' THEN starts = 1 WHEN 'single-terminal-state' THEN ends = 1
  WHEN 'per-attempt-reservations' THEN res WHEN 'run-envelope' THEN used <= 500 WHEN 'manifest-binding' THEN starts >= 1 AND run_id % 7 <> 0 ELSE true END AS passed
FROM g, (SELECT unnest(['contiguous-sequences', 'unique-event-ids', 'run-identity', 'single-run-start', 'manifest-binding', 'single-terminal-state', 'per-attempt-reservations', 'run-envelope']) AS c) u""")
def run_ledger_checks(spark, d):
    from tallyline.plans.audits import run_ledger_checks as checks

    i = F.col("event_id")
    e = fx.events(spark, d).where("event_id % 211 <> 0").select(
        "run_id", F.col("run_id").alias("recorded_run"), "sequence", (i - F.when(i % 97 == 0, 1).otherwise(0)).alias("event_id"), "kind", F.col("units").alias("reserved"),
        F.when(i % 79 == 0, F.col("units") + 1).otherwise(F.col("units")).alias("actual"), F.when(F.col("run_id") % 7 == 0, "other").otherwise("m").alias("manifest"))
    runs = e.select("run_id").distinct().select("run_id", L("m").alias("manifest"), L(500).alias("cap"))
    return checks(e, runs, "signup", ["error"], ["purchase"])


@query("alert_checks", """
WITH o AS (SELECT o_orderkey AS i FROM orders)
SELECT i AS plan_id, 'numeric_facts_differ' AS code FROM o WHERE i % 31 = 0 UNION ALL SELECT i, 'spanish_boundary_missing' FROM o WHERE i % 37 = 0 UNION ALL SELECT i, 'alert_language_tags' FROM o WHERE i % 41 = 0
UNION ALL SELECT i, 'external_targets' FROM o WHERE i % 43 = 0 UNION ALL SELECT i, 'not_a_simulation_draft' FROM o WHERE i % 47 = 0 UNION ALL SELECT i, 'disclaimer_changed' FROM o WHERE i % 53 = 0""")
def alert_checks(spark, d):
    return cv.alert_checks(_plans(spark, d), "plan_id", "fictional")


def _plans(spark, d):
    i = F.col("o_orderkey")
    n = (i + 10).cast("string")
    return fx.table(spark, d, "orders").select(
        i.alias("plan_id"), F.concat(L("Simulation only: move "), n, L(" people by 007 routes.")).alias("english"),
        F.concat(F.when(i % 37 == 0, L("Aviso: ")).otherwise(L("Solo simulación: ")), L("mover "), F.when(i % 31 == 0, F.concat(n, L("0"))).otherwise(n), L(" personas por 7 rutas.")).alias("spanish"),
        L("en").alias("english_tag"), F.when(i % 41 == 0, "fr").otherwise("es").alias("spanish_tag"), F.when(i % 47 == 0, "published").otherwise("simulation_draft").alias("disposition"),
        L(False).alias("attempted"), F.when(i % 43 == 0, F.array(L("x"))).otherwise(F.array().cast("array<string>")).alias("targets"), F.when(i % 53 == 0, "real").otherwise("fictional").alias("disclaimer"))


@query("citation_checks", w(ARTIFACTS) + """
, f AS (SELECT doc_id, created <= 500 AND 500 <= fresh_until AS fresh FROM artifacts),
e AS (SELECT doc_id AS a, doc_id + 1 AS b FROM artifacts WHERE doc_id % 6 = 0 UNION SELECT doc_id + 1, doc_id FROM artifacts WHERE doc_id % 6 = 0),
c AS (SELECT DISTINCT user_id AS plan_id, event_id % 1000 AS ref FROM events)
SELECT plan_id, ref, 'stale_citation' AS code FROM c JOIN f ON doc_id = ref WHERE NOT fresh
UNION ALL SELECT plan_id, ref, 'fresh_contradiction' FROM c JOIN f ON doc_id = ref WHERE EXISTS (SELECT 1 FROM e JOIN f g ON g.doc_id = e.b WHERE e.a = ref AND g.fresh)""")
def citation_checks(spark, d):
    return cv.citation_checks(*_cited(spark, d), L(500))


def _cited(spark, d):
    a = fx.artifacts(spark, d)
    i = F.col("doc_id")
    ev = a.select(i.alias("ref"), "created", "fresh_until", F.when(i % 6 == 0, F.array(i + 1)).otherwise(F.array().cast("array<bigint>")).alias("contradicts"))
    c = fx.table(spark, d, "events").select(F.col("user_id").alias("plan_id"), (F.col("event_id") % 1000).alias("ref"))
    return c, ev


@query("plan_validation", w(ATTEMPTS, FACILITIES) + f"""
, al AS (SELECT provider AS shelter_id, sum(tokens) AS people, sum(CASE WHEN optional AND task_id = 7 THEN tokens ELSE 0 END) AS acc FROM attempts GROUP BY 1),
rt AS (SELECT profile AS route_id, provider AS shelter_id, tokens, CASE WHEN profile % 3 = 0 THEN 1 ELSE 0 END AS acc FROM attempts WHERE profile % 500 <> 0),
rv AS (SELECT c_nationkey AS h, count(*) AS n FROM customer GROUP BY 1),
u AS (SELECT n_regionkey AS region, s_suppkey AS item, CAST(floor(s_acctbal) AS BIGINT) AS want FROM supplier JOIN nation ON n_nationkey = s_nationkey),
dq AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY want, item) AS good FROM u WHERE item % 50 <> 0),
dp AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY rank, item) AS pos FROM (SELECT *, CASE WHEN item % 23 = 0 THEN good + 2 ELSE good END AS rank FROM dq)),
ct AS (SELECT user_id AS plan_id, event_id % 1000 AS ref, count(*) AS n FROM events GROUP BY ALL), rq AS (SELECT DISTINCT user_id AS plan_id, user_id % 1000 AS ref FROM events),
al9 AS ({ORACLES["alert_checks"]}),
r AS (SELECT '{PLAN_CHECKS[0]}' AS "check", count(*) FILTER (WHERE o_orderkey % 61 = 0) + count(*) FILTER (WHERE o_orderkey % 53 = 0) AS n FROM orders
  UNION ALL SELECT '{PLAN_CHECKS[1]}', count(*) FROM ({ORACLES["capacity_breaches"]})
  UNION ALL SELECT '{PLAN_CHECKS[1]}', count(*) FILTER (WHERE h % 7 = 0) + count(*) FILTER (WHERE n > 50 + h % 3) FROM rv
  UNION ALL SELECT '{PLAN_CHECKS[1]}', CASE WHEN sum(people) <> 5000 THEN 1 ELSE 0 END FROM al
  UNION ALL SELECT '{PLAN_CHECKS[2]}', count(*) FROM (SELECT route_id FROM rt GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT '{PLAN_CHECKS[2]}', count(*) FROM ({ORACLES["route_breaches"]}) WHERE route_id % 500 <> 0
  UNION ALL SELECT '{PLAN_CHECKS[2]}', count(*) FROM ({ORACLES["demand_conservation"]})
  UNION ALL SELECT '{PLAN_CHECKS[3]}', count(*) FROM ({ORACLES["closed_routes"]}) WHERE route_id IN (SELECT route_id FROM rt)
  UNION ALL SELECT '{PLAN_CHECKS[4]}', (SELECT count(*) FROM u WHERE item % 50 = 0) + count(*) FILTER (WHERE rank <> pos) + count(*) FILTER (WHERE pos <> good) FROM dp
  UNION ALL SELECT '{PLAN_CHECKS[5]}', count(*) FILTER (WHERE o_orderkey % 67 = 0) + count(*) FILTER (WHERE o_orderkey % 71 = 0) + count(*) FILTER (WHERE o_orderkey % 73 = 0) + count(*) FILTER (WHERE o_orderkey % 79 = 0) FROM orders
  UNION ALL SELECT '{PLAN_CHECKS[5]}', CASE WHEN sum(acc) <> 40 THEN 1 ELSE 0 END FROM al UNION ALL SELECT '{PLAN_CHECKS[5]}', CASE WHEN sum(acc) <> 40 THEN 1 ELSE 0 END FROM rt
  UNION ALL SELECT '{PLAN_CHECKS[6]}', count(*) FROM al9 WHERE code IN ('alert_language_tags', 'numeric_facts_differ')
  UNION ALL SELECT '{PLAN_CHECKS[7]}', count(*) FROM ({ORACLES["citation_checks"]})
  UNION ALL SELECT '{PLAN_CHECKS[7]}', (SELECT count(*) FROM rq ANTI JOIN ct ON ct.plan_id = rq.plan_id AND ct.ref = rq.ref) + count(*) FILTER (WHERE n > 1) + count(*) FILTER (WHERE ref NOT IN (SELECT doc_id FROM documents)) FROM ct
  UNION ALL SELECT '{PLAN_CHECKS[8]}', count(*) FROM al9 WHERE code NOT IN ('alert_language_tags', 'numeric_facts_differ'))
SELECT "check", CAST(sum(n) AS BIGINT) AS findings, sum(n) = 0 AS passed FROM r GROUP BY 1""")
def plan_validation(spark, d):
    """Orders as plans; suppliers as shelters and utilities, nations as hospitals, parts as routes."""
    from tallyline.plans.audits import BOUNDARY
    from tallyline.plans.audits import plan_validation as report

    i, s = F.col("plan_id"), F.col("s_suppkey")
    disclaimer = f"{BOUNDARY}: no real place."
    boundary = F.when(F.col("disclaimer") == "fictional", disclaimer).otherwise(F.col("disclaimer"))
    plans = _plans(spark, d).withColumns({
        "scenario": F.when(i % 61 == 0, "other").otherwise("storm"), "disclaimer": boundary, "screen_reader": i % 67 != 0, "plain_language": i % 71 != 0,
        "nonvisual": i % 73 != 0, "tags": F.when(i % 79 == 0, F.array(L("en"))).otherwise(F.array(L("es"), L("en")))})
    region = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("long").alias("region"))
    utilities = fx.table(spark, d, "supplier").join(region, "s_nationkey").select("region", s.alias("item"), F.floor("s_acctbal").cast("long").alias("want"))
    ranked = running(utilities.where("item % 50 <> 0"), ["region"], "want", {"rank": rcount()}, tie=["item"])
    n = F.col("n_nationkey").cast("long")
    none = L(0).cast("long")
    cited, evidence = _cited(spark, d)
    return report({
        "plans": plans, "allocations": _allocations(spark, d), "shelters": _facilities(spark, d), "routes": _routes(spark, d),
        "hospitals": fx.table(spark, d, "nation").select(
            n.alias("hospital_id"), F.when(n % 7 == 0, "closed").otherwise("open").alias("status"), (n % 3 + 60).alias("capacity"), L(10).cast("long").alias("occupied"),
            none.alias("accessible_capacity"), none.alias("accessible_occupied")),
        "reservations": fx.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("hospital_id")).agg(F.count("*").alias("people"), F.max(none).alias("accessible")),
        "assignments": fx.attempts(spark, d).where("profile % 500 <> 0").select(
            F.col("profile").alias("route_id"), F.col("provider").alias("shelter_id"), F.col("tokens").alias("passengers"), F.when(F.col("profile") % 3 == 0, 1).otherwise(0).cast("long").alias("accessible")),
        "closures": fx.providers(spark, d).where("provider % 3 = 0").select((F.col("provider") % 40).alias("segment")),
        "utilities": utilities, "priorities": ranked.select("region", "item", (F.col("rank") + F.when(F.col("item") % 23 == 0, 2).otherwise(0)).alias("rank")),
        "evidence": evidence, "citations": cited, "required": fx.table(spark, d, "events").select(F.col("user_id").alias("plan_id"), (F.col("user_id") % 1000).alias("ref")),
    }, "storm", disclaimer, 5000, 40, ["en", "es"], L(500))
