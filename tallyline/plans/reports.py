"""Composite reports built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators import stats as st


def survival_report(trials: DataFrame) -> DataFrame:
    """Trial summary per scenario and, with a NULL scenario, over all trials (R8, A16); columns as in ``stats.trial_summary``."""
    both = trials.withColumn("__g", F.explode(F.array(F.struct("scenario"), F.struct(F.lit(None).cast("string").alias("scenario")))))
    x = both.select(*[c for c in trials.columns if c != "scenario"], F.coalesce("__g.scenario", F.lit("\0all")).alias("__s"))
    g = st.trial_summary(x, "__s")
    return g.select(F.when(F.col("__s") != "\0all", F.col("__s")).alias("scenario"), *[c for c in g.columns if c != "__s"])


def experiment_summary(records: DataFrame) -> DataFrame:
    """Pass rate, intervals and success/failure percentiles per (fault, policy)."""
    keys = ["fault", "policy"]
    ok, bad = records.where("success"), records.where("not success")
    g = st.pass_rates(records, keys, "success")
    return (
        g.withColumn("binding", (F.col("passes") > 0) & (F.col("passes") < F.col("runs")))
        .join(st.percentiles(ok, keys, "makespan", {"success_p50_makespan": 0.5}, "linear"), keys, "left")
        .join(st.percentiles(ok, keys, "tokens", {"success_p95_tokens": 0.95}, "linear"), keys, "left")
        .join(st.percentiles(bad, keys, "makespan", {"failure_p50_makespan": 0.5}, "linear"), keys, "left")
    )


def _long(df: DataFrame, keep, measures: dict) -> DataFrame:
    """One row per (row, measure); ``measures`` maps a name to a column that is NULL where it does not apply."""
    named = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("long").alias("value")) for m, c in measures.items()])
    return df.select(*keep, F.explode(named).alias("__x")).select(*keep, "__x.*").where("value is not null")


def experiment_metrics(records: DataFrame, resamples: int) -> DataFrame:
    """p50 and p95 with intervals of the measures of passing runs and of the time to failure, per (fault, policy).

    ``records``: fault, policy, seed, success, makespan, tokens, cost, context; a (fault, policy) has a seed once.
    """
    ok = F.col("success")
    measures = {f"success_{m}": F.when(ok, F.col(m)) for m in ("makespan", "tokens", "cost", "context")}
    measures["time_to_failure"] = F.when(~ok, F.col("makespan"))
    return st.metric_summary(_long(records, ["fault", "policy", "seed"], measures), ["fault", "policy", "measure"], "value", "seed", resamples)


def experiment_reasons(records: DataFrame) -> DataFrame:
    """Failing runs per (fault, policy, reason); a run without a reason counts as unspecified."""
    reason = F.coalesce("reason", F.lit("unspecified")).alias("reason")
    return records.where("not success").groupBy("fault", "policy", reason).agg(F.count("*").alias("runs"))


def experiment_deltas(records: DataFrame, baseline, resamples: int) -> DataFrame:
    """Comparison minus baseline per (fault, policy, measure), with mean, median and interval."""
    m = ["makespan", "tokens", "cost", "context"]
    p = st.paired(records, ["seed", "fault"], "policy", baseline, "success", m, ["makespan"])
    names = ["success_delta", *[f"success_{x}_delta" for x in m], "failure_makespan_delta"]
    x = _long(p, ["seed", "fault", "policy"], {n: F.col(n) for n in names})
    return st.delta_summary(x, ["fault", "policy", "measure"], "value", "seed", resamples, "delta")


def benchmark_summary(records: DataFrame, baseline: str, resamples: int) -> DataFrame:
    """Per system: outcomes, pass and guardrail rates, latency of passing runs, paired delta of the baseline minus it.

    ``records``: system, seed, phase (warmup / measured), duration, slo, outcome (passed / refused / error), guardrail,
    safe_refusal, unauthorized.  Warm-ups are counted and take no part in anything else; a pair needs two passing runs.
    """
    m = records.where("phase = 'measured'")
    ok = m.where("slo")
    out = F.col("outcome")
    g = m.groupBy("system").agg(
        F.count("*").alias("runs"), F.count_if("slo").alias("passes"), F.count_if(out == "refused").alias("refusals"), F.count_if("safe_refusal").alias("safe_refusals"),
        F.count_if(out == "error").alias("errors"), F.count_if(F.col("unauthorized") > 0).alias("unsafe_runs"), F.count_if("guardrail").alias("guardrail_passes"))
    low, high = st.wilson(F.col("passes"), F.col("runs"))
    guard_low, guard_high = st.wilson(F.col("guardrail_passes"), F.col("runs"))
    g = g.select("*", F.round(F.col("passes") / F.col("runs"), 6).alias("pass_rate"), low.alias("wilson_low"), high.alias("wilson_high"),
                 F.round(F.col("guardrail_passes") / F.col("runs"), 6).alias("guardrail_rate"), guard_low.alias("guardrail_low"), guard_high.alias("guardrail_high"))
    warm = records.where("phase = 'warmup'").groupBy("system").agg(F.count("*").alias("warmups"))
    times = st.metric_summary(ok, ["system"], "duration", "seed", resamples).drop("values")
    base = ok.where(F.col("system") == baseline).select("seed", F.col("duration").alias("__b"))
    pairs = ok.where(F.col("system") != baseline).join(base, "seed").withColumn("__d", F.col("__b") - F.col("duration"))
    d = st.delta_summary(pairs, ["system"], "__d", "seed", resamples, "delta").select(
        "system", F.col("pairs").alias("eligible_pairs"), F.col("mean").alias("mean_delta"), F.col("p50").alias("p50_delta"), F.col("low").alias("delta_low"), F.col("high").alias("delta_high"))
    x = g.join(warm, "system", "left").join(times, "system", "left").join(d, "system", "left")
    paired = F.when(F.col("system") != baseline, F.coalesce("eligible_pairs", F.lit(0)))
    return x.withColumns({"warmups": F.coalesce("warmups", F.lit(0)), "eligible_pairs": paired, "excluded_pairs": F.col("runs") - paired})
