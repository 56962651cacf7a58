"""Composite audits built from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import IDENTIFIER, is_fresh
from tallyline.operators.checks import dangling, duplicates, flagged, holds, set_difference

# The label of artifacts that are data and no authority, names of the text and plan checks.
UNTRUSTED = "untrusted-evidence-data"
TEXT_CHECKS = (
    "input-contract", "citation-support-controlled-facts", "key-fact-number-unit-consistency", "bilingual-structured-fact-equivalence",
    "cited-artifact-freshness", "url-protocol-host-allowlist", "authority-taint-separation", "declared-render-accessibility-structural-only",
)
PLAN_CHECKS = (
    "structural-fixture-identity-and-simulation-boundary", "structural-capacity-and-demand-arithmetic", "structural-route-linkage-and-capacity",
    "structural-modeled-closure-intersection", "structural-utility-priority-list-integrity", "declared-accessibility-fields-structural-only",
    "bilingual-numeric-parity-structural-only", "citation-ids-freshness-conflicts-no-entailment", "declared-publication-boundary-not-external-state",
)
BOUNDARY = "FICTIONAL SIMULATION"
BODY_CODES = ("alert_body_missing", "alert_language_tags", "numeric_facts_differ")


def artifact_table_audit(artifacts: DataFrame) -> DataFrame:
    """Address equals content, parents exist, one producer per content.

    ``artifacts``: doc_id, text, producer, artifact_id, content, parent.
    """
    wrong = artifacts.where(F.col("artifact_id") != F.sha2("text", 256)).select("doc_id", F.lit("address_mismatch").alias("code"))
    lost = dangling(artifacts.select("doc_id", "parent"), "parent", artifacts.select(F.col("doc_id").alias("id")), "id")
    per = artifacts.groupBy("content", "producer").agg(F.min("doc_id").alias("doc_id"))
    split = per.groupBy("content").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")
    return (
        wrong.unionByName(lost.select("doc_id", F.lit("missing_parent").alias("code")))
        .unionByName(split.select("doc_id", F.lit("conflicting_copies").alias("code")))
    )


def check_report(checks: dict[str, Sequence[DataFrame]]) -> DataFrame:
    """One row per check: the rows of its tables of findings, and whether there are none."""
    parts = [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, tables in checks.items() for f in tables]
    return reduce(DataFrame.unionByName, parts).groupBy("check").agg(F.sum("n").alias("findings")).withColumn("passed", F.col("findings") == 0)


def identity_findings(table: DataFrame, ident: str, may_be_empty: bool = True) -> list[DataFrame]:
    """Malformed ids, well-formed ids that repeat and, if so asked, an empty table."""
    ids = table.select(F.col(ident).cast("string").alias("id"))
    well = holds(F.col("id").rlike(IDENTIFIER))
    found = [ids.where(~well), duplicates(ids.where(well), ["id"])]
    return found if may_be_empty else [*found, ids.agg(F.count("*").alias("n")).where("n = 0")]


def text_safety_report(t: dict[str, DataFrame], schemes: Sequence[str], issuers: Sequence[str], capabilities: Sequence[str], as_of: Column) -> DataFrame:
    """The eight text-safety checks with their findings.

    ``t``: artifacts (doc_id, text, created, fresh_until, trust), claims (claim_id, cited, quote, subject, predicate, value, unit,
    language, statement), pairs (pair_id, left_id, right_id), grants and actions as in ``policy``, urls (url_id, url), hosts (host)
    and pages (page_id, html).  A NULL field never passes the check that reads it.
    """
    from tallyline.operators import policy as pol
    from tallyline.operators import text as tx

    artifacts, claims, grants, actions = t["artifacts"], t["claims"], t["grants"], t["actions"]
    support = tx.citation_support(claims, artifacts.select("doc_id", "text"), controlled=True).where("code <> 'supported'")
    fresh = artifacts.select("doc_id", is_fresh(F.col("created"), F.col("fresh_until"), as_of).alias("fresh"))
    cited = claims.select(F.col("cited").alias("doc_id")).distinct()
    signed = claims.withColumn("signature", F.struct("subject", "predicate", "value", "unit"))
    names = [[c for c in values] for values in (issuers, capabilities)]
    policy = sum(not v or len(set(v)) != len(v) for v in names)
    refs = artifacts.select(F.col("doc_id").alias("ref"))
    contract = [f for table, ident, empty in (("artifacts", "doc_id", False), ("claims", "claim_id", False), ("pairs", "pair_id", False),
                                              ("grants", "grant_id", True), ("actions", "action_id", True)) for f in identity_findings(t[table], ident, empty)]
    found = (
        contract,
        [support],
        [tx.fact_breaches(claims)],
        [tx.pair_breaches(t["pairs"], signed, "en", "es")],
        [cited.join(fresh, "doc_id", "left").where(~holds(F.col("fresh")))],
        [tx.url_policy(t["urls"], ["url_id"], "url", schemes, t["hosts"])],
        [pol.grant_breaches(grants, issuers, capabilities, as_of), pol.action_breaches(actions, grants, refs, capabilities),
         artifacts.where(~holds(F.col("trust") == UNTRUSTED)), refs.join(grants.select(F.col("grant_id").alias("ref")), "ref", "left_semi").distinct(),
         artifacts.sparkSession.range(policy)],
        [tx.accessibility_breaches(tx.page_facts(t["pages"], "page_id", "html"), "page_id")],
    )
    return check_report(dict(zip(TEXT_CHECKS, found)))


def plan_validation(t: dict[str, DataFrame], scenario: str, disclaimer: str, demand: int, accessible_demand: int, tags: Sequence[str], as_of: Column) -> DataFrame:
    """The nine plan checks with their findings.

    ``t``: plans (plan_id, scenario, the alert columns of ``conservation.alert_checks``, screen_reader, plain_language, nonvisual,
    tags), allocations and reservations (key, people, accessible) over shelters and hospitals, assignments (route_id, shelter_id,
    passengers, accessible) over routes, closures (segment), utilities (region, item, order columns from ``want`` on), priorities
    (region, item, rank), evidence (ref, created, fresh_until, contradicts), citations and required (plan_id, ref).
    """
    from tallyline.operators import evidence as evd
    from tallyline.operators import policy as pol
    from tallyline.plans.conservation import alert_checks, citation_checks

    plans, alloc, routed = t["plans"], t["allocations"], t["assignments"]
    alerts = alert_checks(plans, "plan_id", disclaimer)
    fixtures = (("shelters", "shelter_id"), ("routes", "route_id"), ("hospitals", "hospital_id"), ("utilities", "item"), ("evidence", "ref"))
    total = lambda df, c, want: df.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n")).where(F.col("n") != want)
    crossing = pol.closed_routes(t["routes"], t["closures"]).join(routed.select("route_id").distinct(), "route_id", "left_semi")
    ranks = t["priorities"].join(t["utilities"].select("region", "item", "want"), ["region", "item"])
    attested = flagged(plans, {
        "screen_reader": ~holds(F.col("screen_reader")), "plain_language": ~holds(F.col("plain_language")), "nonvisual": ~holds(F.col("nonvisual")),
        "missing_tags": F.size(F.array_except(F.array(*[F.lit(x) for x in tags]), "tags")) > 0,
    }, ["plan_id"])
    found = (
        [plans.where(~holds(F.col("scenario") == scenario)), plans.where(~holds(F.col("disclaimer").contains(BOUNDARY))),
         *[duplicates(t[name].select(F.col(c).alias("id")), ["id"]) for name, c in fixtures]],
        [pol.capacity_breaches(alloc, t["shelters"], "shelter_id"), pol.capacity_breaches(t["reservations"], t["hospitals"], "hospital_id"), total(alloc, "people", demand)],
        [duplicates(routed, ["route_id"]), pol.route_breaches(routed, t["routes"]), pol.conservation(alloc, routed, "shelter_id", "people", "passengers")],
        [crossing],
        [set_difference(t["utilities"], t["priorities"], ["region", "item"]), pol.priority_breaches(ranks, ["want", "item"], "region", "item", "rank")],
        [attested, total(alloc, "accessible", accessible_demand), total(routed, "accessible", accessible_demand)],
        [alerts.where(F.col("code").isin(*BODY_CODES))],
        [citation_checks(t["citations"], t["evidence"], as_of), evd.claim_citation_gaps(t["required"], t["citations"], t["evidence"], ["plan_id"], "ref")],
        [alerts.where(~F.col("code").isin(*BODY_CODES))],
    )
    return check_report(dict(zip(PLAN_CHECKS, found)))


def model_bounds(tasks: DataFrame, down: DataFrame, limits: DataFrame) -> DataFrame:
    """Lower bound of a run: critical path, work over slots, provider work over its limit.

    ``tasks``: run_id, task_id, duration, provider, parallelism; ``down``: run_id, src (dependency), dst.
    """
    from tallyline.operators import graph as gr
    from tallyline.operators import resources as rs

    nodes = tasks.select("run_id", F.col("task_id").alias("node"), "duration")
    path = gr.critical_path(nodes, down, ["run_id"], "duration")
    work = rs.work_bounds(tasks, ["run_id"], "duration", "provider", limits, "parallelism")
    return path.join(work, "run_id").withColumn("bound", F.greatest("critical_path", "work_bound", "provider_bound"))


def quota_counters(calls: DataFrame, admitted: DataFrame, settles: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Counters of a quota replay per provider.

    ``calls``: provider, seq, call, tokens; ``admitted``: provider, call, admitted; ``settles``: provider, seq, call, unused;
    ``suppressed``: provider, call of calls made before a declared reset.  A lease runs from an admitted call to its first
    settlement, and stays open without one; settlements of calls that were refused count nothing.
    """
    from tallyline.operators import resources as rs

    on = ["provider", "call"]
    done = settles.groupBy(*on).agg(F.min(F.struct("seq", "unused")).alias("__end"))
    late = suppressed.select(*on).distinct().withColumn("__late", F.lit(True))
    x = calls.join(admitted.select(*on, "admitted"), on).join(done, on, "left").join(late, on, "left")
    ok, ended = F.col("admitted"), F.col("__end").isNotNull()
    g = x.groupBy("provider").agg(
        F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("refused"), F.sum(F.when(ok, F.col("tokens")).otherwise(0)).alias("tokens"),
        F.count_if(ok & ended).alias("settled"), F.sum(F.when(ok & ended, F.col("tokens") - F.col("__end.unused")).otherwise(0)).alias("tokens_settled"),
        F.count_if(ok & ~ended).alias("open_leases"), F.count_if("__late").alias("reset_suppressed"))
    end = F.coalesce(F.col("__end.seq"), F.lit(2**62))
    p = rs.peak_concurrency(x.where(ok).select("provider", "seq", end.alias("until")), ["provider"], "seq", "until").withColumnRenamed("peak", "peak_leases")
    return g.join(p, "provider", "left")


def run_ledger_checks(events: DataFrame, runs: DataFrame, start: str, terminal, attempts) -> DataFrame:
    """Eight named checks of each run's control ledger.

    ``events``: run_id, recorded_run, sequence, event_id, kind, reserved, actual, manifest; ``runs``: run_id, manifest, cap.
    """
    from tallyline.operators.scan import rcount, running

    k = F.col("kind")
    x = running(events, ["run_id"], "sequence", {"pos": rcount()}, tie=["event_id"])
    used = k.isin(list(attempts))
    ids = events.groupBy("run_id", "event_id").agg(F.count("*").alias("n")).groupBy("run_id").agg((F.max("n") == 1).alias("unique"))
    g = x.groupBy("run_id").agg(
        F.bool_and(F.col("sequence") == F.col("pos")).alias("contiguous"), F.bool_and(F.col("recorded_run") == F.col("run_id")).alias("own"),
        F.count_if(k == start).alias("starts"), F.count_if(k.isin(list(terminal))).alias("ends"), F.min_by("manifest", F.when(k == start, F.col("sequence"))).alias("said"),
        F.bool_and(~used | (F.col("actual") <= F.col("reserved"))).alias("reserved"), F.sum(F.when(used, F.col("actual")).otherwise(0)).alias("used"),
    ).join(ids, "run_id").join(runs, "run_id")
    checks = {
        "contiguous-sequences": F.col("contiguous"), "unique-event-ids": F.col("unique"), "run-identity": F.col("own"), "single-run-start": F.col("starts") == 1,
        "manifest-binding": F.col("said") == F.col("manifest"), "single-terminal-state": F.col("ends") == 1, "per-attempt-reservations": F.col("reserved"),
        "run-envelope": F.col("used") <= F.col("cap"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check"), holds(c).alias("passed")) for n, c in checks.items()])
    return g.select("run_id", F.explode(rows).alias("c")).select("run_id", "c.*")
