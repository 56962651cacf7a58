"""Conservation, preflight, physical admission and plan-validation reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import integer_multiset, is_fresh
from tallyline.operators import graph as gr
from tallyline.operators import resources as rs
from tallyline.operators.checks import holds
from tallyline.operators.intervals import conflicting_use
from tallyline.operators.scan import rcount, rlag, running
from tallyline.plans.audits import model_bounds
from tallyline.session import BLOCK, by_size, dealt, durable, in_place

RUN = "run_id"

# The named checks of a conservation report.
CHECKS = (
    "entry-identity", "entry-shape", "profile-integrity", "task-deadlines", "event-order", "event-identity", "run-lifecycle",
    "task-lifecycle", "skip-integrity", "dependency-order", "successful-run-completeness", "resource-accounting", "resource-caps",
    "modeled-reliability", "concurrency-caps", "effect-serialization", "model-bound", "run-deadline",
)
TASK_KINDS = ("profile.selected", "task.started", "task.completed", "task.cancelled", "task.skipped")
RUN_KINDS = ("run.started", "run.completed", "run.failed")


def _failed(df: DataFrame, check: str, bad: Column) -> DataFrame:
    return df.where(holds(bad)).select(RUN, F.lit(check).alias("check")).distinct()


def conservation_report(runs: DataFrame, tasks: DataFrame, profiles: DataFrame, deps: DataFrame, entries: DataFrame, events: DataFrame,
                        skipped: DataFrame, limits: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (run, check): passed (R2).

    Runs of at most ``block`` rows in all tables are dealt by run once and checked where they lie, others are joined and scanned
    by finer keys than the run.

    ``runs``: run_id, success, makespan, total_tokens, total_cost, total_context, success_probability, model_bound,
    deadline_ms, max_tokens, max_cost, max_context, max_parallelism, success_floor.  ``tasks``: run_id, task_id, optional,
    min_quality, deadline_ms, resource, writes.  ``profiles``: run_id, task_id, name, provider, p95, tokens, cost, context,
    quality, failure.  ``deps``: run_id, task_id, dep_id.  ``entries``: run_id, task_id, backend, provider, start_ms, end_ms,
    outcome, optional, tokens, cost, context, probability.  ``events``: run_id, sequence, at, kind, task_id.  ``skipped``:
    run_id, task_id.  ``limits``: provider, limit.
    """
    tables = [runs, tasks, profiles, deps, entries, events, skipped]
    small, big = by_size(tables, RUN, block)
    with in_place(runs.sparkSession):
        out = durable(_conservation(*[dealt(x, RUN) for x in small], limits, lambda df: dealt(df, RUN)))
    return out if big is None else out.unionByName(_conservation(*big, limits, durable))


def _conservation(runs: DataFrame, tasks: DataFrame, profiles: DataFrame, deps: DataFrame, entries: DataFrame, events: DataFrame,
                  skipped: DataFrame, limits: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keep`` makes a stage table."""
    T = [RUN, "task_id"]
    known = tasks.select(*T, F.lit(True).alias("k"))
    counted = entries.groupBy(*T).agg(F.count("*").alias("n")).join(known, T, "left")
    fails = [_failed(counted, "entry-identity", F.col("k").isNull() | (F.col("n") > 1))]

    r = runs.select(RUN, "makespan", F.col("deadline_ms").alias("run_deadline"))
    t = tasks.select(*T, F.col("optional").alias("t_optional"), "min_quality", F.col("deadline_ms").alias("t_deadline"), "resource", "writes")
    e = keep(entries.join(t, T).join(r, RUN, "left"))
    fails.append(_failed(e, "entry-shape", (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms")) | (F.col("end_ms") > F.col("makespan"))
                         | ~F.col("outcome").isin("completed", "cancelled") | (F.col("optional") != F.col("t_optional"))))
    p = profiles.groupBy(*T, F.col("name").alias("backend"), "provider").agg(
        F.count("*").alias("n"), *[F.max(c).alias(f"p_{c}") for c in ("p95", "tokens", "cost", "context", "quality", "failure")])
    m = e.join(p, [*T, "backend", "provider"], "left")
    span = F.col("end_ms") - F.col("start_ms")
    took = F.when(F.col("outcome") == "completed", span == F.col("p_p95")).otherwise(span <= F.col("p_p95"))
    same = (
        (F.col("p_quality") >= F.col("min_quality")) & (F.col("tokens") == F.col("p_tokens")) & (F.col("cost") == F.col("p_cost"))
        & (F.col("context") == F.col("p_context")) & (F.abs(1 - F.col("p_failure") - F.col("probability")) <= 1e-9 * F.greatest(F.abs("probability"), F.lit(1e-3))) & took
    )
    fails.append(_failed(m, "profile-integrity", ~holds((F.col("n") == 1) & same)))
    due = F.least(F.coalesce("t_deadline", "run_deadline"), F.col("run_deadline"))
    fails.append(_failed(e, "task-deadlines", (F.col("outcome") == "completed") & (F.col("end_ms") > due)))

    o = running(events, [RUN], "sequence", {"pos": rcount(), "before": rlag(F.col("at"))}, tie=["kind"])
    fails.append(_failed(o, "event-order", (F.col("sequence") != F.col("pos")) | (F.col("at") < F.col("before")) | (F.col("at") < 0)))
    i = events.join(known, T, "left")
    kind = F.col("kind")
    fails.append(_failed(i, "event-identity", ~kind.isin(*TASK_KINDS, *RUN_KINDS) | (kind.isin(*TASK_KINDS) & F.col("k").isNull())
                         | (kind.isin(*RUN_KINDS) & F.col("task_id").isNotNull())))

    n = lambda v: F.count_if(kind == v)
    life = events.groupBy(RUN).agg(n("run.started").alias("s"), n("run.completed").alias("c"), n("run.failed").alias("f"), F.min_by("kind", "sequence").alias("first"),
                                   F.max_by("kind", "sequence").alias("last"), F.min_by("at", "sequence").alias("t0"), F.max_by("at", "sequence").alias("t1"))
    life = runs.join(life, RUN, "left")
    good = F.col("success")
    ends = F.when(good, (F.col("c") == 1) & (F.col("f") == 0) & (F.col("last") == "run.completed")).otherwise(
        (F.col("f") == 1) & (F.col("c") == 0) & (F.col("last") == "run.failed"))
    fails.append(_failed(life, "run-lifecycle", ~holds((F.col("s") == 1) & (F.col("first") == "run.started") & (F.col("t0") == 0) & ends & (F.col("t1") == F.col("makespan")))))

    at = lambda v, c: F.max(F.when(kind == v, F.col(c)))
    g = events.where(kind.isin(*TASK_KINDS)).join(known, T, "left_semi").groupBy(*T).agg(
        *[n(k).alias(a) for k, a in zip(TASK_KINDS, ("sel", "sta", "com", "can", "ski"), strict=True)],
        at("profile.selected", "sequence").alias("q1"), at("task.started", "sequence").alias("q2"), at("task.started", "at").alias("t_start"),
        F.max(F.when(kind.isin("task.completed", "task.cancelled"), F.struct("sequence", "at", "kind"))).alias("end"))
    single = e.groupBy(*T).agg(F.count("*").alias("n"), F.max(F.struct("start_ms", "end_ms", "outcome")).alias("e")).where("n = 1")
    x = tasks.select(*T).join(single, T, "left").join(g, T, "left").na.fill(0, ["sel", "sta", "com", "can", "ski"])
    own = F.when(F.col("e.outcome") == "completed", "task.completed").otherwise("task.cancelled")
    aligned = (
        (F.col("sel") == 1) & (F.col("sta") == 1) & (F.col("com") + F.col("can") == 1) & (F.col("ski") == 0) & (F.col("end.kind") == own)
        & (F.col("q1") < F.col("q2")) & (F.col("q2") < F.col("end.sequence")) & (F.col("t_start") == F.col("e.start_ms")) & (F.col("end.at") == F.col("e.end_ms"))
    )
    idle = (F.col("sel") + F.col("sta") + F.col("com") + F.col("can") == 0) & (F.col("ski") <= 1)
    fails.append(_failed(x, "task-lifecycle", ~holds(F.when(F.col("e").isNotNull(), aligned).otherwise(idle))))

    up = deps.select(RUN, F.col("task_id").alias("src"), F.col("dep_id").alias("dst"))
    guard = gr.closure(up, tasks.where("not optional").select(RUN, F.col("task_id").alias("node")), [RUN])
    guard = keep(guard.select(RUN, F.col("node").alias("task_id"), F.lit(True).alias("guarded")))
    s = skipped.groupBy(*T).agg(F.count("*").alias("times"))
    y = x.join(s, T, "full_outer").join(guard, T, "left").join(known, T, "left")
    told, ran = F.col("times").isNotNull(), F.col("e").isNotNull()
    fails.append(_failed(y, "skip-integrity", (F.col("times") > 1) | (told != (F.coalesce("ski", F.lit(0)) > 0)) | (told & (F.col("guarded").isNotNull() | F.col("k").isNull() | ran))))

    one = single.select(*T, F.col("e.start_ms").alias("start_ms"), F.col("e.end_ms").alias("end_ms"), F.col("e.outcome").alias("outcome"))
    parent = one.select(RUN, F.col("task_id").alias("dep_id"), F.col("end_ms").alias("p_end"), F.col("outcome").alias("p_out"))
    d = deps.join(one, T).join(parent, [RUN, "dep_id"], "left")
    fails.append(_failed(d, "dependency-order", ~holds((F.col("p_out") == "completed") & (F.col("p_end") <= F.col("start_ms")))))

    z = y.join(runs.select(RUN, "success"), RUN)
    finished = F.col("e.outcome") == "completed"
    fails.append(_failed(z, "successful-run-completeness", F.col("success") & F.col("k").isNotNull() & (
        (F.col("guarded").isNotNull() & ~holds(finished)) | (F.coalesce("can", F.lit(0)) > 0) | ~(holds(finished) | told))))

    u = entries.groupBy(RUN).agg(F.sum("tokens").alias("u_tokens"), F.sum("cost").alias("u_cost"), F.sum("context").alias("u_context"), F.product("probability").alias("u_p"))
    u = runs.join(u, RUN, "left").na.fill(0, ["u_tokens", "u_cost", "u_context"]).na.fill(1.0, ["u_p"])
    three = ("tokens", "cost", "context")
    fails.append(_failed(u, "resource-accounting", reduce(lambda a, b: a | b, [F.col(f"u_{c}") != F.col(f"total_{c}") for c in three])))
    fails.append(_failed(u, "resource-caps", reduce(lambda a, b: a | b, [F.col(f"u_{c}") > F.col(f"max_{c}") for c in three])))
    fails.append(_failed(u, "modeled-reliability", (F.abs(F.col("u_p") - F.col("success_probability")) > F.greatest(F.lit(1e-12), 1e-9 * F.col("u_p")))
                         | (good & (F.col("u_p") < F.col("success_floor")))))
    slots = runs.select(RUN, "max_parallelism")
    whole = rs.peak_concurrency(e, [RUN], "start_ms", "end_ms").join(slots, RUN)
    each = rs.peak_concurrency(e, [RUN, "provider"], "start_ms", "end_ms").join(slots, RUN).join(limits, "provider", "left")
    usable = F.least(F.coalesce("limit", "max_parallelism"), F.col("max_parallelism"))
    fails.append(_failed(whole.select(RUN, (F.col("peak") > F.col("max_parallelism")).alias("b")).unionByName(each.select(RUN, (F.col("peak") > usable).alias("b"))),
                         "concurrency-caps", F.col("b")))
    clash = conflicting_use(e.where("resource is not null and resource <> ''"), [RUN, "resource"], "start_ms", "end_ms", "writes", ["task_id"])
    fails.append(clash.select(RUN, F.lit("effect-serialization").alias("check")).distinct())
    down = deps.select(RUN, F.col("dep_id").alias("src"), F.col("task_id").alias("dst"))
    timed = one.join(entries.groupBy(*T).agg(F.min("provider").alias("provider")), T).join(slots, RUN).select(
        *T, "provider", (F.col("end_ms") - F.col("start_ms")).alias("duration"), F.col("max_parallelism").alias("parallelism"))
    b = runs.join(model_bounds(timed, down, limits), RUN, "left")
    fails.append(_failed(b, "model-bound", good & ~holds((F.coalesce("bound", F.lit(0)) == F.col("model_bound")) & (F.col("model_bound") <= F.col("makespan")))))
    fails.append(_failed(runs, "run-deadline", good & (F.col("makespan") > F.col("deadline_ms"))))

    failed = reduce(DataFrame.unionByName, fails).distinct().withColumn("bad", F.lit(True))
    grid = runs.select(RUN, F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("check"))
    return grid.join(failed, [RUN, "check"], "left").select(RUN, "check", F.col("bad").isNull().alias("passed"))


def preflight(runs: DataFrame) -> DataFrame:
    """Constraint rows and status of each run's projected schedule.

    ``runs``: run_id, success, skipped, makespan, deadline_ms, tokens, max_tokens, cost, max_cost, context, max_context,
    probability, success_floor, bound.
    """
    ok = F.col("success")
    row = lambda name, passed, unit: F.struct(F.lit(name).alias("constraint"), holds(passed).alias("passed"), F.lit(unit).alias("unit"))
    rows = F.array(
        row("deadline", ok & (F.col("makespan") <= F.col("deadline_ms")), "ms"), row("tokens", F.col("tokens") <= F.col("max_tokens"), "tokens"),
        row("cost", F.col("cost") <= F.col("max_cost"), "micro-USD"), row("context_movement", F.col("context") <= F.col("max_context"), "bytes"),
        row("modeled_success_probability", ok & (F.col("probability") >= F.col("success_floor")), "independent-profile probability"),
        row("required_work", ok, "state"),
    )
    x = runs.withColumn("status", rs.admission(ok, F.col("skipped")))
    return x.select(RUN, "status", "bound", F.explode(rows).alias("c")).select(RUN, "status", "bound", "c.*")


ADDITIVE = ("cpu_time", "storage_read", "storage_write", "network_ingress", "network_egress", "egress_cost")
PEAK = ("peak_memory", "peak_vram", "bandwidth")


def physical_admission(selected: DataFrame, envelopes: DataFrame, down: DataFrame) -> DataFrame:
    """Physical constraint rows per run (R5); an overflowed or undefined value never passes.

    ``selected``: run_id, task_id, the additive and peak dimensions, rtt; ``envelopes``: run_id, parallelism, max_<dim>,
    available_bandwidth, max_rtt, deadline_ms; ``down``: run_id, src (dependency), dst.
    """
    selected, envelopes = durable(selected), durable(envelopes)
    totals = rs.safe_totals(selected, [RUN], ADDITIVE).select(RUN, *ADDITIVE)
    x = envelopes.join(totals, RUN, "left")
    slotted = selected.join(envelopes.select(RUN, "parallelism"), RUN)
    for dim in PEAK:
        x = x.join(rs.conservative_peak(slotted, [RUN], dim, "parallelism"), RUN, "left")
    x = x.join(selected.groupBy(RUN).agg(F.max("rtt").alias("rtt")), RUN, "left")
    size = F.try_add(F.col("network_ingress"), F.col("network_egress"))
    local = selected.join(envelopes.select(RUN, "available_bandwidth"), RUN).withColumn("move", gr.transfer_ms(size, F.col("available_bandwidth")))
    nodes = durable(local.select(RUN, F.col("task_id").alias("node"), "move", F.try_add(F.col("move"), F.col("rtt")).alias("both")))
    for w, name in (("move", "transport_ms"), ("both", "transport_rtt_ms")):
        path = gr.critical_path(nodes.select(RUN, "node", w), down, [RUN], w)
        x = x.join(path.withColumnRenamed("critical_path", name), RUN, "left")
    dims = {d: (d, f"max_{d}", "units") for d in (*ADDITIVE, "peak_memory", "peak_vram")}
    dims |= {"bandwidth": ("bandwidth", "available_bandwidth", "bits-per-second"), "network_rtt": ("rtt", "max_rtt", "milliseconds"),
             "transport_rtt_deadline_lower_bound": ("transport_rtt_ms", "deadline_ms", "milliseconds")}
    fit = rs.envelope_fit(x, [RUN], dims)
    defined = x.select(RUN, F.lit("transport_bandwidth_defined").alias("dimension"), F.col("transport_ms").alias("observed"),
                       F.col("deadline_ms").cast("long").alias("limit"), F.col("transport_ms").isNotNull().alias("passed"), F.lit("milliseconds").alias("unit"))
    return fit.unionByName(defined)


def alert_checks(plans: DataFrame, ident: str, disclaimer: str) -> DataFrame:
    """Bilingual alert and publication boundary of plans (R10, text part).

    ``plans``: english, spanish, english_tag, spanish_tag, disposition, attempted, targets, disclaimer.
    """
    from tallyline.operators.checks import flagged

    blank = lambda c: F.trim(F.col(c)) == ""
    return flagged(plans, {
        "alert_body_missing": blank("english") | blank("spanish"),
        "alert_language_tags": (F.col("english_tag") != "en") | (F.col("spanish_tag") != "es"),
        "numeric_facts_differ": integer_multiset(F.col("english")) != integer_multiset(F.col("spanish")),
        "not_a_simulation_draft": F.col("disposition") != "simulation_draft",
        "publication_attempted": F.col("attempted"),
        "external_targets": F.size("targets") > 0,
        "english_boundary_missing": ~F.upper("english").contains("SIMULATION ONLY"),
        "spanish_boundary_missing": ~F.upper("spanish").contains("SOLO SIMULACIÓN"),
        "disclaimer_changed": F.col("disclaimer") != disclaimer,
    }, [ident])


def citation_checks(citations: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """Cited evidence that is stale or meets fresh contradicting evidence (R10, J4 variant).

    ``citations``: plan_id, ref; ``evidence``: ref, created, fresh_until, contradicts (array).
    """
    fresh = evidence.select("ref", is_fresh(F.col("created"), F.col("fresh_until"), as_of).alias("fresh"))
    said = evidence.select("ref", F.explode("contradicts").alias("other"))
    edges = said.unionByName(said.select(F.col("other").alias("ref"), F.col("ref").alias("other"))).where("ref <> other").distinct()
    live = edges.join(fresh.where("fresh").select(F.col("ref").alias("other")), "other", "left_semi").groupBy("ref").agg(F.count("*").alias("against"))
    from tallyline.operators.checks import flagged

    x = citations.distinct().join(fresh, "ref").join(live, "ref", "left")
    return flagged(x, {"stale_citation": ~F.col("fresh"), "fresh_contradiction": F.col("against") > 0}, ["plan_id", "ref"])
