"""Contract, port, capability, authority, gate and plan checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import DIGEST, INT64_MAX, scoped_key
from tallyline.operators.checks import flagged, holds, violations
from tallyline.operators.scan import rcount, running

# Ranks of the capability levels, effect kinds that write, page actions.
CANCELLATION = {"none": 0, "cooperative": 1, "hard": 2}
CHECKPOINT = {"none": 0, "receipt": 1, "resumable": 2}
USAGE = {"none": 0, "estimated": 1, "provider_reported": 2}
FLOATING_VERSIONS = ("latest", "current", "default", "*", "unknown", "unversioned")
SECRET_KEYS = (
    "api_key", "apikey", "access_token", "refresh_token", "password", "secret", "client_secret", "credential",
    "credentials", "authorization",
)
WRITES = ("idempotent_write", "reversible_write", "irreversible_write")
MUTATIONS = ("click", "execute_script", "select", "submit", "type", "upload")
READS = ("inspect",)


def task_contract_checks(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row checks of task contracts and their effects."""
    kind = F.col("effect_kind")
    return violations(tasks, {
        "self_dependency": ~F.array_contains("dependencies", F.col("task_id")),
        "negative_value": F.col("value") >= 0,
        "quality_out_of_range": F.col("min_quality").between(0, 1),
        "nonpositive_deadline": F.col("deadline_ms").isNull() | (F.col("deadline_ms") > 0),
        "no_profile": F.size("profiles") > 0,
        "repeated_profile": F.size(F.array_distinct(F.transform("profiles", lambda p: F.struct(p["name"], p["provider"])))) == F.size("profiles"),
        "no_profile_at_quality_floor": (F.size("profiles") == 0) | F.exists("profiles", lambda p: p["quality"] >= F.col("min_quality")),
        "effect_without_resource": (kind == "pure") | (F.coalesce("resource", F.lit("")) != ""),
        "write_without_key": ~kind.isin("idempotent_write", "irreversible_write") | (F.coalesce("idempotency_key", F.lit("")) != ""),
        "reversible_without_compensation": (kind != "reversible_write") | (F.coalesce("compensation", F.lit("")) != ""),
        "irreversible_without_approval": (kind != "irreversible_write") | F.col("requires_approval"),
    }, keys)


def profile_contract_checks(profiles: DataFrame, keys: Sequence[str], physical: Sequence[str] = ()) -> DataFrame:
    """Row checks of backend profiles."""
    checks = {
        "unnamed_profile": (F.col("name") != "") & (F.col("provider") != ""),
        "bad_duration": (F.col("p50") >= 0) & (F.col("p95") >= F.col("p50")),
        "negative_resource": (F.col("tokens") >= 0) & (F.col("cost") >= 0) & (F.col("context") >= 0),
        "quality_out_of_range": F.col("quality").between(0, 1),
        "failure_out_of_range": F.col("failure").between(0, 1),
        "bad_snapshot_digest": F.col("snapshot_digest").isNull() | F.col("snapshot_digest").rlike(DIGEST),
    }
    checks |= {f"bad_{p}": F.col(p).between(0, INT64_MAX) for p in physical}
    return violations(profiles, checks, keys)


def envelope_checks(envelopes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row checks of run envelopes; ``provider_limits`` is an array of (provider, limit)."""
    return violations(envelopes, {
        "nonpositive_deadline": F.col("deadline_ms") > 0,
        "negative_budget": (F.col("max_tokens") >= 0) & (F.col("max_cost") >= 0) & (F.col("max_context") >= 0),
        "nonpositive_parallelism": F.col("max_parallelism") > 0,
        "floor_out_of_range": F.col("success_floor").between(0, 1),
        "bad_provider_limit": F.forall("provider_limits", lambda p: (p["provider"] != "") & (p["limit"] > 0)),
        "repeated_provider_limit": F.size(F.array_distinct(F.transform("provider_limits", lambda p: p["provider"]))) == F.size("provider_limits"),
    }, keys)


def port_contract_checks(ports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row checks of ports and uniqueness of their names per task and direction.

    ``ports``: keys, direction (in / out), port, source_task, source_port, type.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    inward = F.col("direction") == "in"
    own = violations(ports, {
        "unknown_direction": F.col("direction").isin("in", "out"),
        "unnamed_port": said("port"),
        "untyped_port": said("type"),
        "unbound_input": ~inward | (F.col("source_task").isNotNull() & said("source_port")),
    }, [*keys, "direction", "port"])
    twice = ports.groupBy(*keys, "direction", "port").agg(F.count("*").alias("n")).where("n > 1")
    return own.unionByName(twice.select(*keys, "direction", "port", F.lit("repeated_port").alias("code")))


def requirement_checks(needs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row checks of adapter requirements: known levels, non-negative hidden retries."""
    return violations(needs, {
        "unknown_cancellation": F.col("cancellation").isin(list(CANCELLATION)),
        "unknown_checkpoint": F.col("checkpoint").isin(list(CHECKPOINT)),
        "unknown_usage": F.col("usage").isin(list(USAGE)),
        "missing_flag": F.col("streaming").isNotNull() & F.col("fencing").isNotNull(),
        "negative_hidden_retries": F.col("hidden_retries") >= 0,
    }, keys)


def port_breaches(inputs: DataFrame, outputs: DataFrame, tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Consumer ports against producer ports, first problem by precedence.

    ``inputs``: run_id, task_id, port, source_task, source_port, type; ``outputs``: run_id, task_id, port, type.
    """
    known = tasks.select("run_id", F.col("task_id").alias("source_task"), F.lit(True).alias("__known"))
    direct = deps.select("run_id", "task_id", F.col("dep_id").alias("source_task"), F.lit(True).alias("__direct"))
    made = outputs.select("run_id", F.col("task_id").alias("source_task"), F.col("port").alias("source_port"),
                          F.col("type").alias("__type"), F.lit(True).alias("__made"))
    x = (
        inputs.join(known, ["run_id", "source_task"], "left")
        .join(direct, ["run_id", "task_id", "source_task"], "left")
        .join(made, ["run_id", "source_task", "source_port"], "left")
    )
    code = (
        F.when(F.col("__known").isNull(), "missing_producer").when(F.col("__direct").isNull(), "not_a_direct_dependency")
        .when(F.col("__made").isNull(), "missing_producer_port").when(~F.col("type").eqNullSafe(F.col("__type")), "incompatible_type")
    )
    return x.select("run_id", "task_id", "port", code.alias("code")).where("code is not null")


def profile_match(entries: DataFrame, declared: DataFrame, on: Sequence[str], ident: Sequence[str],
                  measures: Sequence[str]) -> DataFrame:
    """Each schedule entry matches exactly one declared profile, with equal measures."""
    d = declared.groupBy(*on).agg(F.count("*").alias("__n"), *[F.min(m).alias(f"__{m}") for m in measures])
    x = entries.join(d, on, "left")
    same = F.lit(True)
    for m in measures:
        same = same & F.col(m).eqNullSafe(F.col(f"__{m}"))
    code = F.when(F.coalesce("__n", F.lit(0)) != 1, "backend").when(~same, "profile")
    return x.select(*ident, code.alias("code")).where("code is not null")


def _rank(col: str, ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), F.col(col))


def capability_breaches(needs: DataFrame, adapters: DataFrame, on: Sequence[str], ident: Sequence[str]) -> DataFrame:
    """Declared adapter capability against the task requirement."""
    a = adapters.select(*on, *[F.col(c).alias(f"a_{c}") for c in (
        "provider", "cancellation", "checkpoint", "streaming", "usage", "effects", "fencing", "hidden_retries")], F.lit(True).alias("__a"))
    x = needs.join(a, on, "left")
    have = F.col("__a").isNotNull()
    return flagged(x, {
        "no_manifest": ~have,
        "provider_mismatch": have & (F.col("provider") != F.col("a_provider")),
        "cancellation_insufficient": have & (_rank("a_cancellation", CANCELLATION) < _rank("cancellation", CANCELLATION)),
        "checkpoint_insufficient": have & (_rank("a_checkpoint", CHECKPOINT) < _rank("checkpoint", CHECKPOINT)),
        "streaming_unsupported": have & F.col("streaming") & ~F.col("a_streaming"),
        "usage_insufficient": have & (_rank("a_usage", USAGE) < _rank("usage", USAGE)),
        "fencing_unsupported": have & F.col("fencing") & ~F.col("a_fencing"),
        "hidden_retries_exceeded": have & (F.col("a_hidden_retries") > F.col("hidden_retries")),
        "effect_undeclared": have & ~F.array_contains("a_effects", F.col("effect_kind")),
    }, ident)


def grant_breaches(grants: DataFrame, issuers: Sequence[str], capabilities: Sequence[str], as_of: Column) -> DataFrame:
    """Grants against the authority policy."""
    caps = F.array(*[F.lit(c) for c in capabilities])
    return flagged(grants, {
        "issuer_not_allowed": ~holds(F.col("issuer").isin(list(issuers))),
        "no_capabilities": F.size("capabilities") <= 0,
        "repeated_capability": F.size(F.array_distinct("capabilities")) != F.size("capabilities"),
        "capability_outside_policy": F.size(F.array_except("capabilities", caps)) > 0,
        "derived_from_evidence": F.size("derived_from") > 0,
        "not_valid_at_time": ~holds((F.col("issued") <= as_of) & (as_of <= F.col("expires"))),
    }, ["grant_id"])


def action_breaches(actions: DataFrame, grants: DataFrame, evidence: DataFrame, capabilities: Sequence[str]) -> DataFrame:
    """Proposed actions against grants and evidence; evidence is never an authority.

    ``actions``: action_id, kind, capability, grant_id, evidence (array); ``evidence``: ref.
    """
    g = grants.select("grant_id", F.col("capabilities").alias("__caps"))
    known = evidence.select(F.col("ref").alias("grant_id"), F.lit(True).alias("__data")).distinct()
    x = actions.join(g, ["grant_id"], "left").join(known, ["grant_id"], "left")
    own = flagged(x, {
        "unknown_kind": ~holds(F.col("kind").isin("tool", "effect")),
        "capability_outside_policy": ~holds(F.col("capability").isin(list(capabilities))),
        "evidence_used_as_authority": F.col("__data").isNotNull(),
        "no_grant": F.col("__caps").isNull(),
        "capability_not_granted": F.col("__caps").isNotNull() & ~F.array_contains("__caps", F.col("capability")),
    }, ["action_id"])
    refs = actions.select("action_id", F.explode("evidence").alias("ref")).distinct()
    lost = refs.join(evidence.select("ref").distinct(), ["ref"], "left_anti").select("action_id").distinct()
    return own.unionByName(lost.select("action_id", F.lit("unknown_evidence").alias("code")))


def page_action_breaches(intents: DataFrame, observations: DataFrame) -> DataFrame:
    """Page-action proposals: known observations, no observation as authority, writes fully declared (P10)."""
    obs = observations.select(F.col("observation_id").alias("grant_id"), F.lit(True).alias("__o")).distinct()
    x = intents.join(obs, ["grant_id"], "left")
    mut = F.col("mutates")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    own = flagged(x, {
        "action_outside_vocabulary": ~holds(F.col("action").isin([*MUTATIONS, *READS])),
        "not_a_proposal": (F.col("state") != "proposed") | F.col("executed"),
        "no_authority_grant": empty("grant_id"),
        "observation_used_as_authority": F.col("__o").isNotNull(),
        "mutation_flag_conflict": mut & ~F.col("action").isin(list(MUTATIONS)),
        "write_not_classified": mut & ~F.col("effect_kind").isin(list(WRITES)),
        "write_without_key": mut & empty("idempotency_key"),
        "reversible_without_compensation": mut & (F.col("effect_kind") == "reversible_write") & empty("compensation"),
        "irreversible_without_approval": mut & (F.col("effect_kind") == "irreversible_write") & ~F.col("requires_approval"),
        "read_inconsistent": ~mut & (~F.col("action").isin(list(READS)) | (F.col("effect_kind") != "read")),
    }, ["intent_id"])
    refs = intents.select("intent_id", F.explode("observations").alias("observation_id")).distinct()
    lost = refs.join(observations.select("observation_id").distinct(), ["observation_id"], "left_anti")
    return own.unionByName(lost.select("intent_id", F.lit("unknown_observation").alias("code")).distinct())


def gate_breaches(gates: DataFrame, artifacts: DataFrame, commit: str) -> DataFrame:
    """Gate records: commit bound, pass needs evidence, every reference exists."""
    own = flagged(gates, {
        "commit_mismatch": F.col("commit") != commit,
        "pass_without_evidence": (F.col("status") == "pass") & (F.size("evidence") <= 0),
        "evidence_not_sorted_unique": F.array_sort(F.array_distinct("evidence")) != F.col("evidence"),
    }, ["gate_id"])
    refs = gates.select("gate_id", F.explode("evidence").alias("ref")).distinct()
    lost = refs.join(artifacts.select("ref").distinct(), ["ref"], "left_anti").select("gate_id").distinct()
    return own.unionByName(lost.select("gate_id", F.lit("missing_artifact").alias("code")))


def attestation_readiness(attestations: DataFrame, artifacts: DataFrame, gate_refs: DataFrame,
                          rules: dict[str, dict], genuine: Sequence[str], as_of: Column, max_age: int) -> DataFrame:
    """Per required kind: is there a genuine, available, fresh attestation bound to its gate's evidence.

    ``gate_refs``: gate_id, ref, one row per evidence reference; ``rules``: kind -> {"gate": id,
    "availability": [...], "classification": [...]}.
    """
    rows = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(r["gate"]).alias("gate_id"),
                 F.array(*[F.lit(a) for a in r["availability"]]).alias("avail"),
                 F.array(*[F.lit(c) for c in r.get("classification", genuine)]).alias("classes"))
        for k, r in rules.items()
    ])
    spark = attestations.sparkSession
    need = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    bound = gate_refs.select("gate_id", "ref").distinct().withColumn("__bound", F.lit(True))
    a = artifacts.select("ref", F.col("classification").alias("__class"))
    x = attestations.join(F.broadcast(need), "kind")
    x = x.join(a, ["ref"], "left").join(bound, ["gate_id", "ref"], "left")
    age = as_of - F.col("observed")
    ok = (
        F.array_contains("classes", F.col("classification")) & (F.col("classification") == F.col("__class"))
        & F.array_contains("avail", F.col("availability")) & age.between(0, max_age) & F.col("__bound")
    )
    seen = x.groupBy("kind").agg(F.bool_or(holds(ok)).alias("ready"))
    return need.select("kind").join(seen, "kind", "left").select("kind", F.coalesce("ready", F.lit(False)).alias("ready"))


def completion_breaches(completions: DataFrame, profiles: DataFrame, effects: DataFrame, on: Sequence[str],
                        dims: Sequence[str]) -> DataFrame:
    """Recorded outputs against profile usage or effect intent, key derived from its scope."""
    p = profiles.select(*on, *[F.col(m).alias(f"p_{m}") for m in dims], F.lit(True).alias("__p"))
    e = effects.select(*on, F.col("resource").alias("e_resource"), F.col("idempotency_key").alias("e_key"), F.lit(True).alias("__e"))
    x = completions.join(p, on, "left").join(e, on, "left")
    fits = F.col("__p").isNotNull()
    for m in dims:
        fits = fits & (F.col(f"reserved_{m}") == F.col(f"p_{m}")) & (F.col(f"actual_{m}") <= F.col(f"p_{m}"))
    want = scoped_key(*on, "declared_key")
    intent = F.col("__e").isNotNull() & (F.col("e_resource") == F.col("resource")) & (F.col("e_key") == want)
    code = (
        F.when((F.col("kind") == "fixture_output") & ~holds(fits), "usage_violates_profile")
        .when((F.col("kind") == "effect_intent") & ~F.col("writes"), "unsupported_kind")
        .when((F.col("kind") == "effect_intent") & ~holds(intent), "effect_violates_contract")
        .when(~F.col("kind").isin("fixture_output", "effect_intent"), "unsupported_kind")
    )
    return x.select(*on, code.alias("code")).where("code is not null")


def pending_effects(completions: DataFrame, effects: DataFrame, on: Sequence[str]) -> DataFrame:
    """Completed write tasks whose intent is not yet committed or compensated."""
    e = effects.select(*on, F.col("state").alias("effect_state"))
    x = completions.where("writes").join(e, on, "left")
    return x.where(~holds(F.col("effect_state").isin("committed", "compensated")))


def capacity_breaches(plan: DataFrame, facilities: DataFrame, key: str) -> DataFrame:
    """Plan rows against facility status and free capacity."""
    f = facilities.select(key, F.col("status").alias("__s"), F.greatest(F.lit(0), F.col("capacity") - F.col("occupied")).alias("__free"),
                          F.greatest(F.lit(0), F.col("accessible_capacity") - F.col("accessible_occupied")).alias("__afree"))
    p = plan.groupBy(key).agg(F.count("*").alias("__n"), F.sum("people").alias("people"), F.sum("accessible").alias("accessible"))
    x = p.join(f, key, "left")
    known = F.col("__s").isNotNull()
    return flagged(x, {
        "repeated_allocation": F.col("__n") > 1,
        "unknown_facility": ~known,
        "negative_allocation": F.least("people", "accessible") < 0,
        "accessible_above_total": F.col("accessible") > F.col("people"),
        "closed_facility": known & (F.col("__s") != "open"),
        "capacity_exceeded": known & (F.col("people") > F.col("__free")),
        "accessible_capacity_exceeded": known & (F.col("accessible") > F.col("__afree")),
    }, [key])


def route_breaches(assignments: DataFrame, routes: DataFrame) -> DataFrame:
    """Route assignments against route status, destination and capacity."""
    r = routes.select("route_id", F.col("status").alias("__s"), F.col("destination").alias("__d"), F.col("capacity").alias("__c"))
    x = assignments.join(r, ["route_id"], "left")
    known = F.col("__s").isNotNull()
    return flagged(x, {
        "unknown_route": ~known,
        "route_not_open": known & (F.col("__s") != "open"),
        "destination_mismatch": known & (F.col("__d") != F.col("shelter_id")),
        "route_capacity_exceeded": known & (F.col("passengers") > F.col("__c")),
    }, ["route_id", "shelter_id"]).distinct()


def conservation(allocations: DataFrame, routed: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Keys where the two sums differ."""
    a = allocations.groupBy(key).agg(F.sum(left).alias("allocated"))
    b = routed.groupBy(key).agg(F.sum(right).alias("routed"))
    x = a.join(b, key, "full_outer").select(key, F.coalesce("allocated", F.lit(0)).alias("allocated"), F.coalesce("routed", F.lit(0)).alias("routed"))
    return x.where("allocated <> routed")


def closed_routes(routes: DataFrame, closures: DataFrame) -> DataFrame:
    """Routes crossing a closed segment, with the number of closed segments."""
    segs = routes.select("route_id", F.explode("segments").alias("segment")).distinct()
    hit = segs.join(closures.select("segment").distinct(), ["segment"], "left_semi")
    return hit.groupBy("route_id").agg(F.count("*").alias("closed_segments"))


def priority_breaches(declared: DataFrame, expected_order: Sequence[str], group: str, item: str, rank: str) -> DataFrame:
    """Declared ranks must be 1..n and follow the expected order.

    ``expected_order`` starts with one integer column; later ones break ties.
    """
    n = running(declared, [group], rank, {"__pos": rcount()}, tie=[item])
    x = running(n, [group], expected_order[0], {"__want": rcount()}, tie=list(expected_order[1:]))
    return flagged(x, {
        "rank_not_consecutive": F.col(rank) != F.col("__pos"),
        "rank_out_of_order": F.col("__pos") != F.col("__want"),
    }, [group, item])


def snapshot_checks(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profile-snapshot document checks on the nested columns."""
    c = F.col
    checks = {
        "floating_version": ~F.lower(c("identity.version")).isin(["", *FLOATING_VERSIONS]),
        "currency": c("pricing.currency") == "USD",
        "negative_price": (c("pricing.input_price") >= 0) & (c("pricing.output_price") >= 0),
        "nonpositive_quota": (c("quota.rpm") >= 1) & (c("quota.tpm") >= 1) & (c("quota.concurrency") >= 1) & (c("quota.window_ms") >= 1),
        "observed_without_samples": (c("metrics.provenance") != "observed") | (c("metrics.sample_count") > 0),
        "estimated_with_samples": (c("metrics.provenance") != "estimated") | (c("metrics.sample_count") == 0),
        "p95_below_p50": c("metrics.latency_p95") >= c("metrics.latency_p50"),
        "quality_ppm_out_of_range": c("metrics.quality_ppm").between(0, 1_000_000),
        "source_follows_snapshot": c("metrics.sampled_at") <= c("snapshot_at"),
        "source_stale": c("snapshot_at") - c("metrics.sampled_at") <= c("max_age_s"),
        "window_above_31_days": (c("valid_until") >= c("snapshot_at")) & (c("valid_until") - c("snapshot_at") <= 31 * 86400),
        "placement_region": c("placement.domain_region") == c("placement.region"),
        "placement_provider": c("placement.domain_provider") == c("identity.provider"),
        "secret_like_key": F.forall("keys", lambda k: ~F.lower(k).isin(list(SECRET_KEYS))),
    }
    return violations(snapshots, checks, keys)
