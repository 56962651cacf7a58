"""One tampered field per run, and the code each must raise."""

import pytest
from pyspark.sql import functions as F

from tallyline.catalog import fixtures as fx
from tallyline.catalog import whole
from tallyline.plans.whole_run import verify_whole_run

L = F.lit
C = F.col


@pytest.fixture(scope="module")
def tables(spark, sf):
    real = fx.tasks
    ids = [r.run_id for r in real(spark, sf).groupBy("run_id").count().where("count >= 3").orderBy("run_id").limit(60).collect()]
    whole.fx.tasks = lambda s, d: real(s, d).where(C("run_id").isin(ids))
    try:
        return ids, whole.sealed_tables(spark, sf)
    finally:
        whole.fx.tasks = real


def tampers():
    C = F.col
    return {
        "event_digest_mismatch": ("events", "event_id", C("pos") == 2, L("zz")),
        "event_chain_break": ("events", "previous", C("pos") == 3, L("f" * 64)),
        "non_monotonic_event_time": ("events", "at", C("pos") == 4, L(1).cast("long")),
        "non_monotonic_event_sequence": ("events", "sequence", C("pos") == 2, L(9).cast("long")),
        "event_run_identity_mismatch": ("events", "recorded_run", C("pos") == 2, L(-1).cast("long")),
        "invalid_event_cause": ("events", "causes", C("pos") == 2, F.array(L("nope"))),
        "missing_causal_predecessor": ("events", "causes", C("pos") == 2, F.array().cast("array<string>")),
        "noncanonical_reference_order": ("events", "evidence", C("pos") == 2, F.array(L("b"), L("a"))),
        "invalid_run_lifecycle": ("events", "event_type", C("event_type") == "run.started", L("run.failed")),
        "invalid_event_identity_shape": ("events", "effect_id", C("event_type") == "task.completed", L("e9")),
        "illegal_output_event": ("events", "outputs", C("event_type") == "task.attempt_started", F.array(L("x"))),
        "duplicate_event_id": ("events", "event_id", L(True), L("same")),
        "invalid_task_causality": ("events", "causes", C("event_type") == "task.completed", C("evidence")),
        "missing_task_output": ("events", "outputs", C("event_type") == "task.completed", F.array().cast("array<string>")),
        "resource_conservation_violation": ("events", "resources", C("pos") == 3, C("resources").withField("actual", C("resources.actual").withField("tokens", L(10**7).cast("long")))),
        "resource_leak": ("events", "resources", C("pos") == 3, C("resources").withField("actual", C("resources.actual").withField("tokens", L(0).cast("long")))),
        "artifact_record_digest_mismatch": ("artifacts", "record_digest", C("pos") == 1, L("0")),
        "invalid_artifact_payload": ("artifacts", "payload_base64", C("pos") == 1, L("*")),
        "noncanonical_artifact_payload": ("artifacts", "payload_base64", C("pos") == 1, L("YR==")),
        "artifact_integrity_failure": ("artifacts", "payload_sha256", C("pos") == 1, L("0")),
        "artifact_producer_mismatch": ("artifacts", "producer_event", C("pos") == 1, L("0")),
        "artifact_time_causality": ("artifacts", "created", C("pos") == 1, L(-1).cast("long")),
        "missing_artifact_parent": ("artifacts", "parents", C("pos") == 1, F.array(L("gone"))),
        "noncanonical_artifact_set": ("artifacts", "pos", L(True), -C("pos")),
        "stale_or_future_evidence": ("artifacts", "fresh_until", L(True), L(1).cast("long")),
        "claim_record_digest_mismatch": ("claims", "record_digest", C("pos") == 1, L("0")),
        "claim_integrity_failure": ("claims", "statement", C("pos") == 1, L("other")),
        "unsupported_claim": ("claims", "evidence", C("pos") == 1, F.array().cast("array<string>")),
        "missing_claim_producer": ("claims", "producer_event", C("pos") == 1, L("0")),
        "claim_time_causality": ("claims", "created", C("pos") == 1, L(-1).cast("long")),
        "missing_claim_evidence": ("claims", "evidence", C("pos") == 1, F.array(L("gone"))),
        "missing_conflicting_claim": ("claims", "contradicts", C("pos") == 1, F.array(L("gone"))),
        "context_validation_mismatch": ("obligations", "validation_event", C("pos") == 1, L("0")),
        "context_obligation_unsatisfied": ("obligations", "satisfied", C("pos") == 1, L(False)),
        "context_evidence_missing": ("obligations", "evidence", C("pos") == 1, F.array().cast("array<string>")),
        "missing_context_evidence": ("obligations", "evidence", C("pos") == 1, F.array(L("gone"))),
        "context_run_identity_mismatch": ("obligations", "recorded_run", C("pos") == 1, L(-1).cast("long")),
        "approval_event_mismatch": ("approvals", "grant_event", L(True), L("0")),
        "approval_scope_mismatch": ("approvals", "scope_digest", L(True), L("0")),
        "unregistered_approval_event": ("approvals", "approval_id", L(True), L("ap2")),
        "orphan_or_reused_approval": ("approvals", "effect_id", L(True), L("e2")),
        "missing_effect_payload": ("effects", "payload_ref", L(True), L("gone")),
        "effect_proposal_mismatch": ("effects", "proposed_event", L(True), L("0")),
        "unregistered_effect_event": ("effects", "effect_id", L(True), L("e2")),
        "irreversible_effect_without_approval": ("effects", "approval_id", L(True), L(None).cast("string")),
        "effect_state_mismatch": ("effects", "terminal_state", L(True), L("proposed")),
        "effect_terminal_mismatch": ("effects", "terminal_state", L(True), L("aborted")),
        "effect_commit_binding": ("effects", "commit_event", L(True), L(None).cast("string")),
        "envelope_digest_mismatch": ("identity", "envelope", L(True), C("envelope").withField("policy_digest", L("q"))),
        "run_envelope_identity_mismatch": ("identity", "envelope_digest", L(True), L("0")),
        "replay_identity_mismatch": ("witness", "w", L(True), C("w").withField("graph_digest", L("0"))),
        "replay_witness_binding_mismatch": ("witness", "w", L(True), C("w").withField("event_count", L(1).cast("long"))),
        "replay_witness_digest_mismatch": ("witness", "w", L(True), C("w").withField("witness_digest", L("0"))),
    }


def test_each_tamper_raises_its_code(tables):
    ids, t = tables
    t = dict(t)
    TAMPER = tampers()
    plan = dict(zip(TAMPER, ids))
    for code, (table, column, where, value) in TAMPER.items():
        hit = (C("run_id") == plan[code]) & where
        t[table] = t[table].withColumn(column, F.when(hit, value).otherwise(C(column)))
    found = {}
    for r in verify_whole_run(t).select("run_id", "code").distinct().collect():
        found.setdefault(r.run_id, set()).add(r.code)
    missing = {c: sorted(found.get(i, ())) for c, i in plan.items() if c not in found.get(i, ())}
    assert not missing, missing
    assert not set(found) - set(plan.values())
