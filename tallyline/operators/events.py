"""Event-log audit: order, chains, lifecycles, idempotency, retry and control state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import backoff_ms, sorted_unique
from tallyline.operators.checks import flagged, holds
from tallyline.operators.scan import rcount, rlag, rlast, rmax, rsum, running

GENESIS = "0" * 64


def sequence_breaches(events: DataFrame, keys: Sequence[str], seq: str, at: str, tie: str) -> DataFrame:
    """Rows whose sequence is not their position, or whose time goes backwards."""
    x = running(events, keys, seq, {"__pos": rcount(), "__prev": rlag(F.col(at))}, tie=[tie])
    return flagged(
        x,
        {
            "non_monotonic_event_sequence": F.col(seq) != F.col("__pos"),
            "non_monotonic_event_time": F.col(at) < F.col("__prev"),
        },
        [*keys, seq],
    )


def late_rows(events: DataFrame, keys: Sequence[str], seq: str, at: str, tie: str) -> DataFrame:
    """Rows older than the newest time seen before them in their key (batch twin of X4)."""
    x = running(events, keys, seq, {"high_mark": rmax(F.col(at), inclusive=False)}, tie=[tie])
    return x.where(F.col(at) < F.col("high_mark"))


def chain_breaks(events: DataFrame, keys: Sequence[str], seq: str, digest: str, previous: str,
                 recomputed: Column | None = None) -> DataFrame:
    """Rows whose recorded previous digest is not the digest before them, or whose own seal fails."""
    x = running(events, keys, seq, {"__prev": rlag(F.col(digest))})
    flags = {"event_chain_break": ~F.col(previous).eqNullSafe(F.coalesce("__prev", F.lit(GENESIS)))}
    if recomputed is not None:
        flags["event_digest_mismatch"] = ~F.col(digest).eqNullSafe(recomputed)
    return flagged(x, flags, [*keys, seq])


def cause_breaks(events: DataFrame, keys: Sequence[str], seq: str, ident: str, causes: str) -> DataFrame:
    """Causes must be sorted and unique, absent on the first event only, and earlier in the run."""
    shape = flagged(
        events,
        {
            "noncanonical_reference_order": ~sorted_unique(F.col(causes)),
            "invalid_genesis_causes": (F.col(seq) == 1) & (F.size(causes) > 0),
            "missing_causal_predecessor": (F.col(seq) > 1) & (F.size(causes) == 0),
        },
        [*keys, seq],
    )
    links = events.select(*keys, seq, F.explode(causes).alias(ident))
    known = events.groupBy(*keys, ident).agg(F.min(seq).alias("__at"))
    bad = links.join(known, [*keys, ident], "left").where(~holds(F.col("__at") < F.col(seq)))
    return shape.unionByName(bad.select(*keys, seq, F.lit("invalid_event_cause").alias("code")))


def lifecycle(events: DataFrame, keys: Sequence[str], seq: str, kind: str, at: str, start: str,
              terminal: Sequence[str]) -> DataFrame:
    """Exactly one start, first; exactly one terminal, last."""
    k = F.col(kind)
    g = events.groupBy(*keys).agg(
        F.count_if(k == start).alias("starts"),
        F.count_if(k.isin(list(terminal))).alias("terminals"),
        F.min_by(kind, seq).alias("first_kind"),
        F.max_by(kind, seq).alias("last_kind"),
        F.min_by(at, seq).alias("first_at"),
    )
    ok = (
        (F.col("starts") == 1) & (F.col("terminals") == 1) & (F.col("first_kind") == start)
        & F.col("last_kind").isin(list(terminal))
    )
    return g.select(*keys, "starts", "terminals", "first_kind", "last_kind", holds(ok).alias("passed"))


def identity_shape(events: DataFrame, keys: Sequence[str], kind: str, shapes: dict[str, tuple[Sequence[str], Sequence[str]]],
                   ) -> DataFrame:
    """Required and forbidden identity columns by event kind."""
    ok = F.lit(True)
    for value, (required, forbidden) in shapes.items():
        cond = F.lit(True)
        for c in required:
            cond = cond & F.col(c).isNotNull()
        for c in forbidden:
            cond = cond & F.col(c).isNull()
        ok = ok & ((F.col(kind) != value) | cond)
    return flagged(events, {"invalid_event_identity_shape": ~holds(ok)}, keys)


def latest_by(events: DataFrame, keys: Sequence[str], seq: str, when: Column, keep: Sequence[str]) -> DataFrame:
    """Latest matching row per key, as one partial aggregate."""
    top = F.max_by(F.struct(*keep), seq).alias("__t")
    return events.where(when).groupBy(*keys).agg(F.max(seq).alias(seq), top).select(*keys, seq, "__t.*")


def unbacked_completions(events: DataFrame, keys: Sequence[str], seq: str, kind: str, success: str,
                         completed: str) -> DataFrame:
    """Completions without an earlier success of the same attempt (W8); keys include task and attempt."""
    g = events.groupBy(*keys).agg(
        F.min(F.when(F.col(kind) == success, F.col(seq))).alias("success_at"),
        F.min(F.when(F.col(kind) == completed, F.col(seq))).alias("completed_at"),
    )
    return g.where(F.col("completed_at").isNotNull() & ~holds(F.col("success_at") < F.col("completed_at")))


def backoff_breaches(attempts: DataFrame, keys: Sequence[str], number: str, start: str, end: str, base: int,
                     ceiling: int) -> DataFrame:
    """Retries that began before the exponential backoff was over."""
    x = running(attempts, keys, number, {"__ended": rlag(F.col(end))})
    need = backoff_ms(F.col(number) - 1, base, ceiling)
    x = x.where(F.col(number) > 1).select(
        *keys, number, (F.col(start) - F.col("__ended")).alias("gap_ms"), need.alias("required_ms")
    )
    return x.where(~holds(F.col("gap_ms") >= F.col("required_ms")))


def retry_jitter(seed: int, jitter: int, task: Column, attempt: Column) -> Column:
    """Deterministic jitter offset in [0, jitter] from a seeded digest of (task, attempt)."""
    text = F.concat_ws(":", F.lit("retry-jitter"), F.lit(seed).cast("string"), task.cast("string"), attempt.cast("string"))
    draw = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (draw % F.lit(jitter + 1)).cast("long")


def circuit_openings(attempts: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], failure: Column,
                     at: str, threshold: int, cooldown_ms: int) -> DataFrame:
    """Rows at or past the failure threshold open the circuit until the cooldown ends."""
    x = running(attempts, keys, order, {"failures": rcount(failure)}, tie=tie)
    g = x.where(holds(failure) & (F.col("failures") >= threshold)).groupBy(*keys).agg(
        F.min(at).alias("opened_at"), F.count("*").alias("openings"), F.max(at).alias("__last")
    )
    return g.select(*keys, "opened_at", "openings", (F.col("__last") + cooldown_ms).alias("open_until"))


def reset_suppressed(calls: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str], at: str,
                     reset_at: Column, bits: int) -> DataFrame:
    """Calls made before the latest declared reset of their provider."""
    x = running(calls, keys, order, {"reset_until": rmax(reset_at, inclusive=False)}, tie=tie, bits=bits)
    return x.where(F.col(at) < F.col("reset_until"))


def stale_fences(writes: DataFrame, keys: Sequence[str], seq: str, fence: str) -> DataFrame:
    """Writes carrying a token below one already seen."""
    x = running(writes, keys, seq, {"highest_seen": rmax(F.col(fence), inclusive=False)})
    return x.where(F.col(fence) < F.col("highest_seen"))


def previous_state(events: DataFrame, keys: Sequence[str], seq: str, state: str) -> DataFrame:
    return running(events, keys, seq, {"previous_state": rlag(F.col(state))})


def replay_conflicts(rows: DataFrame, key: Sequence[str], digest: str, seq: str) -> DataFrame:
    """Per idempotency key: repeats of the first content and rows with other content.

    Copies are counted per (key, content) first, so a key with many copies shuffles one row per content.
    """
    per = rows.groupBy(*key, digest).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    g = per.groupBy(*key).agg(
        F.min_by(digest, "first_seq").alias("first_digest"),
        F.min("first_seq").alias("first_seq"),
        F.sum("n").alias("__all"),
        F.min_by("n", "first_seq").alias("__same"),
    )
    return g.select(
        *key, "first_digest", "first_seq", (F.col("__same") - 1).alias("duplicates"),
        (F.col("__all") - F.col("__same")).alias("conflicts"),
    )


def cumulative_state(events: DataFrame, keys: Sequence[str], seq: str, tie: Sequence[str], opens: Column, closes: Column,
                     completes: Column, measures: Sequence[str], charged: Column) -> DataFrame:
    """State after each event: active, completed, and usage charged so far."""
    specs = {
        "active": rsum(F.when(holds(opens), 1).when(holds(closes), -1).otherwise(0).cast("long")),
        "completed": rcount(completes),
    }
    specs |= {f"{m}_so_far": rsum(F.when(holds(charged), F.col(m)).otherwise(0)) for m in measures}
    return running(events, keys, seq, specs, tie=tie)


def state_facts(events: DataFrame, keys: Sequence[str], seq: str, tie: Sequence[str], opens: Column, closes: Column, completes: Column,
                caps: dict[str, str], charged: Column, at: str, deadline: str) -> DataFrame:
    """State after each event with what is left of every cap and of the time.

    ``caps`` maps a measure column to the column of its cap.  What is left is NULL where the cap is, and negative past it.
    """
    x = cumulative_state(events, keys, seq, tie, opens, closes, completes, list(caps), charged)
    left = {f"remaining_{m}": F.try_subtract(F.col(cap), F.col(f"{m}_so_far")) for m, cap in caps.items()}
    return x.withColumns({**left, "slack_ms": F.try_subtract(F.col(deadline), F.col(at))})


def control_fields(events: DataFrame, keys: Sequence[str], seq: str, fields: dict[str, Column]) -> DataFrame:
    """Latest known value of every control field per key, NULL where none was set.

    ``fields`` maps a name to a column that is non-null on the rows that set it.  One partial aggregate; a key without any
    such row has no row.
    """
    known = [F.max_by(c, F.when(c.isNotNull(), F.col(seq))).alias(n) for n, c in fields.items()]
    set_at = F.greatest(*[F.max(F.when(c.isNotNull(), F.col(seq))) for c in fields.values()]) if len(fields) > 1 else F.max(
        F.when(next(iter(fields.values())).isNotNull(), F.col(seq)))
    return events.groupBy(*keys).agg(set_at.alias("set_at"), *known).where(F.col("set_at").isNotNull())


def failed_pairs(events: DataFrame, pair: Sequence[str], seq: str, failed: Column) -> DataFrame:
    """The set of pairs, such as (run, task, provider), that failed, with the first failure (W23); a row per pair."""
    return events.where(holds(failed)).groupBy(*pair).agg(F.min(seq).alias("failed_at"), F.count("*").alias("failures"))


def growing_caps(events: DataFrame, keys: Sequence[str], seq: str, caps: Sequence[str]) -> DataFrame:
    """Cap changes that raise a dimension."""
    x = running(events, keys, seq, {f"__p_{c}": rlag(F.col(c)) for c in caps})
    return flagged(x, {f"{c}_increased": F.col(c) > F.col(f"__p_{c}") for c in caps}, [*keys, seq])


def overruns(attempts: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Attempts whose actual use is above the reservation."""
    return flagged(attempts, {f"{d}_over_reservation": F.col(a) > F.col(r) for d, (a, r) in pairs.items()}, keys)


def first_overspend(events: DataFrame, keys: Sequence[str], seq: str, reserved: str, actual: str, released: str,
                    cap: str) -> DataFrame:
    """First conservation or cap breach per run, and what is left open at the end.

    The running sums are exact up to the first breach; ``ledgers.conservation_rows`` lists every one.
    """
    used = F.col(actual) + F.col(released)
    x = running(
        events, keys, seq,
        {"__res": rsum(F.col(reserved)), "__used": rsum(used), "__spent": rsum(F.col(actual))},
    )
    held = F.col("__res") - F.col("__used")
    g = x.groupBy(*keys).agg(
        F.min(F.when(held < 0, F.col(seq))).alias("conservation_at"),
        F.min(F.when(F.col("__spent") + held > F.col(cap), F.col(seq))).alias("cap_at"),
        F.max_by(held, seq).alias("left_open"),
    )
    first = F.least("conservation_at", "cap_at")
    return g.select(
        *keys, first.alias("first_breach_at"),
        F.when(F.col("conservation_at") == first, "resource_conservation_violation")
        .when(F.col("cap_at") == first, "resource_cap_exceeded").alias("code"),
        F.when(first.isNull(), F.col("left_open")).alias("left_open"),
    )


def seen_before(events: DataFrame, keys: Sequence[str], seq: str, value: Column, name: str) -> DataFrame:
    """Latest non-null value before or at each row."""
    return running(events, keys, seq, {name: rlast(value)})


def task_lifecycle(events: DataFrame, keys: Sequence[str], seq: str, at: str, kind: str, selected: str, started: str,
                   completed: str, cancelled: str, skipped: str) -> DataFrame:
    """One row per task: counts of its events and whether they are aligned."""
    k = F.col(kind)
    n = lambda v: F.count_if(k == v)
    first = lambda v: F.min(F.when(k == v, F.col(seq)))
    g = events.groupBy(*keys).agg(
        n(selected).alias("selected"), n(started).alias("started"), n(completed).alias("completed"),
        n(cancelled).alias("cancelled"), n(skipped).alias("skipped"),
        first(selected).alias("__sel"), first(started).alias("__sta"),
        F.min(F.when(k.isin(completed, cancelled), F.col(seq))).alias("__end"),
    )
    ran = (
        (F.col("selected") == 1) & (F.col("started") == 1) & (F.col("completed") + F.col("cancelled") == 1)
        & (F.col("skipped") == 0) & (F.col("__sel") < F.col("__sta")) & (F.col("__sta") < F.col("__end"))
    )
    idle = (F.col("selected") + F.col("started") + F.col("completed") + F.col("cancelled") == 0) & (F.col("skipped") <= 1)
    return g.select(*keys, "selected", "started", "completed", "cancelled", "skipped",
                    (holds(ran) | holds(idle)).alias("aligned"))


def approval_use(commits: DataFrame, grants: DataFrame, on: Sequence[str], at: str) -> DataFrame:
    """Commit against its grant: present, scope equal, inside [not_before, expires), used once.

    ``grants`` carries ``not_before``, ``expires`` and ``scope``, one row per grant; commits carry ``scope``.
    """
    uses = commits.groupBy(*on).agg(F.count("*").alias("__uses"))
    g = grants.select(*on, "not_before", "expires", F.col("scope").alias("__scope")).join(uses, list(on))
    x = commits.join(g, on, "left")
    t = F.col(at)
    return x.withColumn(
        "code",
        F.when(F.col("not_before").isNull(), "missing_approval")
        .when(~F.col("scope").eqNullSafe(F.col("__scope")), "approval_scope_mismatch")
        .when(F.col("expires") <= F.col("not_before"), "empty_validity")
        .when((t < F.col("not_before")) | (t >= F.col("expires")), "outside_validity")
        .when(F.col("__uses") != 1, "approval_reuse"),
    ).drop("not_before", "expires", "__scope", "__uses")
