"""Usage accounting, caps, peaks and admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import ceil_div, int_div
from tallyline.operators.checks import holds
from tallyline.operators.scan import peak, rsum, running

TERMINAL_ATTEMPTS = ("completed", "failed", "cancelled")


def usage_totals(
    events: DataFrame, keys: Sequence[str], kind: str, terminal: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Usage summed from terminal attempt rows only (A10)."""
    done = F.col(kind).isin(list(terminal))
    return events.groupBy(*keys).agg(*[F.sum(F.when(done, F.col(m)).otherwise(0)).alias(m) for m in measures])


def envelope_fit(usage: DataFrame, keys: Sequence[str], dims: dict[str, tuple[str, str, str]]) -> DataFrame:
    """One row per (key, dimension): observed, limit, passed, unit (P5).

    ``dims`` maps a dimension to (observed column, limit column, unit); an unknown observation,
    such as an overflowed total, never passes.
    """
    rows = [
        F.struct(
            F.lit(name).alias("dimension"),
            F.col(obs).cast("long").alias("observed"),
            F.col(cap).cast("long").alias("limit"),
            holds(F.col(obs) <= F.col(cap)).alias("passed"),
            F.lit(unit).alias("unit"),
        )
        for name, (obs, cap, unit) in dims.items()
    ]
    return usage.select(*keys, F.explode(F.array(*rows)).alias("c")).select(*keys, "c.*")


def admission(success: Column, skipped: Column) -> Column:
    """feasible / degraded / refused."""
    return F.when(~holds(success), "refused").when(skipped > 0, "degraded").otherwise("feasible")


def safe_totals(df: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Additive totals; NULL total with its overflow flag where int64 is exceeded."""
    aggs = []
    for d in dims:
        aggs += [F.try_sum(d).alias(d), (F.try_sum(d).isNull() & (F.count(d) > 0)).alias(f"{d}_overflow")]
    return df.groupBy(*keys).agg(*aggs)


def peak_concurrency(attempts: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Most intervals open at once; zero-length ones are ignored, ends sort before starts."""
    points = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col(end).alias("at"), F.lit(-1).cast("long").alias("d")),
    )
    marks = attempts.where(F.col(start) < F.col(end)).select(*keys, F.explode(points).alias("p"))
    return peak(marks.select(*keys, "p.at", "p.d"), keys, "at", "d")


def conservative_peak(df: DataFrame, keys: Sequence[str], dim: str, slots: str) -> DataFrame:
    """Sum of the ``slots`` largest values per key, NULL on overflow.

    Values are counted first, so a key costs one row per distinct value, scanned in chunks.
    """
    counted = df.groupBy(*keys, slots, dim).agg(F.count("*").alias("__n")).withColumn("__o", -F.col(dim))
    ranked = running(counted, keys, "__o", {"__before": rsum(F.col("__n"), inclusive=False)})
    taken = F.greatest(F.lit(0), F.least(F.col("__n"), F.col(slots) - F.col("__before")))
    return ranked.groupBy(*keys).agg(
        F.when(F.count_if((taken > 0) & F.try_multiply(taken, F.col(dim)).isNull()) == 0,
               F.try_sum(F.try_multiply(taken, F.col(dim)))).alias(dim)
    )


def joint_success(df: DataFrame, keys: Sequence[str], probability: str) -> DataFrame:
    """Product of independent success probabilities, rounded to 12 places."""
    return df.groupBy(*keys).agg(F.round(F.product(probability), 12).alias("joint_success"))


def work_bounds(tasks: DataFrame, keys: Sequence[str], duration: str, provider: str, limits: DataFrame,
                parallelism: str) -> DataFrame:
    """ceil(work / parallelism) and the largest ceil(provider work / usable limit) per run (A15, group part).

    ``limits``: (provider, limit), one row per provider.
    """
    per = tasks.groupBy(*keys, parallelism, provider).agg(F.sum(duration).alias("__work"))
    joined = per.join(limits, provider, "left")
    usable = F.least(F.coalesce(F.col("limit"), F.col(parallelism)), F.col(parallelism))
    return joined.groupBy(*keys).agg(
        ceil_div(F.sum("__work"), F.max(parallelism)).alias("work_bound"),
        F.max(ceil_div(F.col("__work"), usable)).alias("provider_bound"),
    )


def retry_reservation(tasks: DataFrame, keys: Sequence[str], dims: Sequence[str], max_attempts: int,
                      writes: str) -> DataFrame:
    """Worst-case reservation: usage times the attempt bound, once for write tasks; NULL = overflow."""
    times = F.when(F.col(writes), 1).otherwise(max_attempts).cast("long")
    aggs = []
    for d in dims:
        scaled = F.try_multiply(F.col(d), times)
        total = F.when(F.count_if(scaled.isNull()) == 0, F.try_sum(scaled))
        aggs.append(total.alias(d))
    return tasks.groupBy(*keys).agg(*aggs)


def protected_reserve(tasks: DataFrame, keys: Sequence[str], use: str, cap: str, state: str,
                      protected: str) -> DataFrame:
    """What optional work may still use: cap - committed - pending mandatory (T5)."""
    committed = F.sum(F.when(F.col(state) == "completed", F.col(use)).otherwise(0))
    pending = F.sum(F.when((F.col(state) != "completed") & F.col(protected), F.col(use)).otherwise(0))
    return tasks.groupBy(*keys, cap).agg(
        committed.alias("committed"),
        pending.alias("pending_mandatory"),
        (F.col(cap) - committed - pending).alias("headroom"),
        (committed + pending <= F.col(cap)).alias("admissible"),
    )


def what_if(profiles: DataFrame, faults: Sequence[dict]) -> DataFrame:
    """Every profile under every declared fault (P7); an outage drops its profiles.

    Faults are a short declared list carried as literals, so no join is needed.  Keys: ``id``, ``kind``
    (control / slowdown / outage / capacity / budget), optional ``provider``, ``num``, ``den``.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(f["id"]).alias("fault"),
                F.lit(f["kind"]).alias("kind"),
                F.lit(f.get("provider")).cast("string").alias("hit"),
                F.lit(f.get("num", 1)).cast("long").alias("num"),
                F.lit(f.get("den", 1)).cast("long").alias("den"),
            )
            for f in faults
        ]
    )
    x = profiles.select("*", F.explode(rows).alias("f"))
    hit = holds(F.col("f.hit") == F.col("provider"))
    slow = (F.col("f.kind") == "slowdown") & hit
    num, den = F.col("f.num"), F.col("f.den")
    return x.where(~((F.col("f.kind") == "outage") & hit)).select(
        F.col("f.fault").alias("fault"),
        *[c for c in profiles.columns if c != "p95"],
        F.when(slow, ceil_div(F.col("p95") * num, den)).otherwise(F.col("p95")).alias("p95"),
    )


def cut_budget(cap: Column, num: int, den: int) -> Column:
    """Integer ratio of a cap, rounded down."""
    return int_div(cap * F.lit(num).cast("long"), F.lit(den).cast("long"))


def run_metrics(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Retry amplification, cancelled work, context amplification (A26, group part)."""
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.countDistinct("task_id").alias("tasks"),
        F.round(F.count("*") / F.countDistinct("task_id"), 6).alias("retry_amplification"),
        F.sum(F.when(F.col("outcome") == "cancelled", F.col("tokens")).otherwise(0)).alias("cancelled_tokens"),
        (F.max("end_ms") - F.min("start_ms")).alias("makespan_ms"),
    )


def residual_work(tasks: DataFrame, sealed: DataFrame, envelopes: DataFrame, measures: Sequence[str], now: str) -> DataFrame:
    """Work that is neither completed, skipped nor sealed, and what is left of the envelope, per run.

    ``tasks``: run_id, task_id, done, skipped, measures (what the task has used); ``sealed``: run_id, task_id of write intents
    that must not run again; ``envelopes``: run_id, deadline_ms, ``now`` and max_<measure>.  Completed and sealed tasks are
    charged.  What is left is negative past a cap, NULL where the cap is; runs without tasks have no row.
    """
    s = sealed.select("run_id", "task_id", F.lit(True).alias("__sealed")).distinct()
    x = tasks.join(s, ["run_id", "task_id"], "left")
    closed, skipped = holds(F.col("done")) | F.col("__sealed").isNotNull(), holds(F.col("skipped"))
    g = x.groupBy("run_id").agg(
        F.count_if(~closed & ~skipped).alias("residual"), F.count_if(F.col("__sealed").isNotNull() & ~holds(F.col("done"))).alias("sealed"),
        *[F.sum(F.when(closed, F.col(m)).otherwise(0)).alias(f"__{m}") for m in measures])
    return g.join(envelopes, "run_id").select(
        "run_id", "residual", "sealed", F.try_subtract(F.col("deadline_ms"), F.col(now)).alias("remaining_ms"),
        *[F.try_subtract(F.col(f"max_{m}"), F.col(f"__{m}")).alias(f"remaining_{m}") for m in measures])
