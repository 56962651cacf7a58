"""Why a run did what its log says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.checks import holds

# Action by event type, and the rules each action rests on.
ACTIONS = {
    "run.started": "run_start",
    "profile.selected": "profile_selection",
    "task.started": "dispatch_admitted",
    "task.completed": "task_completion",
    "task.skipped": "optional_shed",
    "task.cancelled": "task_cancellation",
    "run.completed": "run_completion",
    "run.failed": "run_refusal",
}
RULES = {
    "run_start": ["ENVELOPE_DECLARED", "GRAPH_VALIDATED", "POLICY_RECORDED"],
    "profile_selection": ["PROFILE_ENTRY_MATCH", "QUALITY_FLOOR_MET", "RESOURCE_LIMITS_RECORDED"],
    "degraded_profile_selection": [
        "PROFILE_ENTRY_MATCH", "QUALITY_FLOOR_MET", "QUALITY_DELTA_RECORDED", "RESOURCE_LIMITS_RECORDED",
    ],
    "dispatch_admitted": ["DEPENDENCIES_COMPLETED", "DISPATCH_ENTRY_MATCH", "PROFILE_PRECEDES_DISPATCH"],
    "task_completion": ["COMPLETION_TIME_MATCH", "DISPATCH_TERMINAL_PAIR"],
    "optional_shed": ["NO_DISPATCH_FOR_SKIPPED_TASK", "OPTIONAL_WORK_SHED"],
    "task_cancellation": ["CANCELLATION_TIME_MATCH", "DISPATCH_TERMINAL_PAIR", "RUN_REFUSAL_CANCELLATION"],
    "run_completion": ["REQUIRED_WORK_COMPLETED", "RUN_LIMITS_RECORDED", "RUN_TOTALS_MATCH_ENTRIES"],
    "run_refusal": ["RUN_REFUSAL_RECORDED", "RUN_TERMINAL_EVENT_MATCH", "RUN_TOTALS_MATCH_ENTRIES"],
}


def explain(events: DataFrame, kind: str, reason: str, quality: str, best_quality: str) -> DataFrame:
    """Append ``action``, ``reason_code`` and ``rules`` to every event."""
    k, r = F.col(kind), F.col(reason)
    literal = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    degraded = (k == "profile.selected") & holds(F.col(quality) < F.col(best_quality))
    action = F.when(degraded, "degraded_profile_selection").otherwise(F.element_at(literal, k))
    skipped = (
        F.when(r == "dependency skipped", "dependency_skipped")
        .when(r == "protected resource or deadline envelope", "protected_envelope_preserved")
        .otherwise("recorded_skip")
    )
    failed = (
        F.when(r.startswith("protected task ") & r.endswith(" has no admissible backend plan"),
               "protected_task_no_admissible_profile")
        .when(r.startswith("required task ") & r.contains(" depends on skipped work "), "required_dependency_skipped")
        .when(r == "run deadline exceeded", "run_deadline_exceeded")
        .when(r.startswith("scheduler deadlock"), "scheduler_deadlock")
        .otherwise("recorded_failure")
    )
    code = (
        F.when(k == "task.skipped", skipped).when(k == "task.cancelled", "run_refused").when(k == "run.failed", failed)
    )
    rules = F.create_map(
        *[x for a, names in RULES.items() for x in (F.lit(a), F.array(*[F.lit(n) for n in names]))]
    )
    out = events.withColumns({"action": action, "reason_code": code})
    extra = F.array_compact(F.array(
        F.when(F.col("reason_code").isNotNull(), F.concat(F.lit("REASON."), F.upper("reason_code"))),
        F.when(F.col("reason_code") == "dependency_skipped", F.lit("SKIPPED_DEPENDENCY_PROPAGATION")),
    ))
    return out.withColumn("rules", F.concat(F.element_at(rules, F.col("action")), extra))
