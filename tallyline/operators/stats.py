"""Experiment statistics: exact percentiles, intervals, paired designs, pass^k."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import Z95
from tallyline.operators.scan import rcount, rsum, rtotal, running
from tallyline.session import durable


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """Two-sided 95 % interval of a pass rate, exact at 0 and 1 (A2)."""
    n = total.cast("double")
    p = successes / n
    z2 = Z95 * Z95
    denom = 1 + z2 / n
    center = (p + z2 / (2 * n)) / denom
    margin = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / denom
    lower = F.when(successes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), center - margin))
    upper = F.when(successes == total, 1.0).otherwise(F.least(F.lit(1.0), center + margin))
    ok = (total > 0) & successes.between(0, total)
    return F.when(ok, F.round(lower, 6)), F.when(ok, F.round(upper, 6))


def pass_rates(df: DataFrame, keys: Sequence[str], passed: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(passed).alias("passes"))
    low, high = wilson(F.col("passes"), F.col("runs"))
    return g.select("*", F.round(F.col("passes") / F.col("runs"), 6).alias("pass_rate"),
                    low.alias("wilson_low"), high.alias("wilson_high"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], rule: str) -> DataFrame:
    """Exact percentiles of an integer column per key, NULLs skipped.

    ``rule``: "linear" interpolates at (n-1)q (A3), "nearest" takes rank ceil(qn) (A4).  Values are counted
    first and ranked by chunked running counts, so no task holds a whole group.
    """
    x = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    c = F.col("__c")
    x = running(x, keys, value, {"__hi": rsum(c), "__lo": rsum(c, inclusive=False), "__n": rtotal(c)})
    n, v = F.col("__n"), F.col(value)
    at = lambda i: F.max(F.when((F.col("__lo") <= i) & (i < F.col("__hi")), v))
    aggs = []
    for name, q in qs.items():
        if rule == "nearest":
            aggs.append(at(F.greatest(F.lit(1), F.ceil(n * F.lit(q))).cast("long") - 1).alias(name))
        else:
            pos = (n - 1) * F.lit(q)
            low, high = at(F.floor(pos)), at(F.ceil(pos))
            weight = F.max(pos - F.floor(pos))
            aggs.append(F.round(low * (1 - weight) + high * weight, 6).alias(name))
    return x.groupBy(*keys).agg(*aggs)


def latency_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, min, floor mean, nearest-rank p50 and p95, max."""
    g = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).alias("min"),
        F.call_function("div", F.sum(value), F.count(value)).alias("mean"), F.max(value).alias("max"),
    )
    return g.join(percentiles(df, keys, value, {"p50": 0.5, "p95": 0.95}, "nearest"), list(keys))


def pass_k(trials: DataFrame, key: str, passed: str) -> DataFrame:
    """Per-trial rate, rate^k and whether all k passed."""
    g = trials.groupBy(key).agg(F.count("*").alias("trials"), F.count_if(passed).alias("passes"))
    rate = F.col("passes") / F.col("trials")
    return g.select(
        "*", F.round(rate, 6).alias("pass_rate"), F.round(F.pow(rate, F.col("trials")), 12).alias("pass_pow_k"),
        (F.col("passes") == F.col("trials")).alias("all_k"),
    )


def trial_summary(trials: DataFrame, key: str) -> DataFrame:
    """pass^k with nearest-rank times and effect counts per key.

    ``trials``: key, passed, duration, calls, effects, duplicates and, NULL where a trial has none, recovery, direct and
    overhead.  The four times are ranked in one scan.
    """
    times = ("duration", "recovery", "direct", "overhead")
    named = F.array(*[F.struct(F.lit(m).alias("__m"), F.col(m).cast("long").alias("__v")) for m in times])
    long = trials.select(key, F.explode(named).alias("__x")).select(key, "__x.*")
    ranked = percentiles(long, [key, "__m"], "__v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "nearest")
    wanted = [(p, m) for m in ("duration", "recovery") for p in ("p50", "p95", "p99")] + [("p50", "direct"), ("p50", "overhead")]
    wide = ranked.groupBy(key).agg(*[F.max(F.when(F.col("__m") == m, F.col(p))).alias(f"{p}_{m}") for p, m in wanted])
    sums = trials.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("calls", "effects", "duplicates")])
    return pass_k(trials, key, "passed").join(wide, key, "left").join(sums, key)


def delta_summary(deltas: DataFrame, keys: Sequence[str], value: str, order: str, resamples: int, label: str) -> DataFrame:
    """Pairs, mean, median and 95 % bootstrap interval of the mean of paired deltas per key; NULL deltas are no pairs."""
    keys = list(keys)
    x = deltas.where(F.col(value).isNotNull()).withColumn("__k", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    g = x.groupBy("__k", *keys).agg(F.count("*").alias("pairs"), F.round(F.avg(value), 6).alias("mean"))
    mid = percentiles(x, ["__k"], value, {"p50": 0.5}, "linear")
    ends = bootstrap_ci(x, "__k", value, order, "mean", resamples, label)
    return g.join(mid, "__k").join(ends, "__k").drop("__k")


def metric_summary(df: DataFrame, keys: Sequence[str], value: str, order: str, resamples: int) -> DataFrame:
    """Values, p50 and p95 with a 95 % bootstrap interval of each per key; NULL values are left out (A3, A5)."""
    keys = list(keys)
    x = df.where(F.col(value).isNotNull()).withColumn("__k", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    out = x.groupBy("__k", *keys).agg(F.count("*").alias("values"))
    out = out.join(percentiles(x, ["__k"], value, {"p50": 0.5, "p95": 0.95}, "linear"), "__k")
    for stat in ("p50", "p95"):
        ends = bootstrap_ci(x, "__k", value, order, stat, resamples, stat)
        out = out.join(ends.select("__k", F.col("low").alias(f"{stat}_low"), F.col("high").alias(f"{stat}_high")), "__k")
    return out.drop("__k")


def draw(label: Column | str, resample: Column, position: Column, n: Column) -> Column:
    """Index in [0, n) fixed by (label, resample, position)."""
    label = F.lit(label) if isinstance(label, str) else label
    text = F.concat_ws("|", label, resample.cast("string"), position.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), n)


def drawn_weights(df: DataFrame, keys: Sequence[str], value: str, order: str, resamples: int, label: Column | str) -> DataFrame:
    """keys, __b, value, __w: resamples of a group's own size, drawn with replacement.

    Values take a rank inside their group; draw i of resample b picks the rank fixed by a digest of
    (label, b, i), found by an equi join.  Draws spread over (group, rank) in one shuffle, unsorted, against a hash
    table of the fewer ranks; a draw is a row of weight 1.  NULL values take no part.
    """
    keys = list(keys)
    label = F.lit(label) if isinstance(label, str) else label
    ranked = running(df.where(F.col(value).isNotNull()).withColumn("__l", label), keys, order,
                     {"__i": rcount(), "__n": rtotal(F.lit(1).cast("long"))})
    ranked = durable(ranked.select(*keys, "__l", value, (F.col("__i") - 1).alias("__i"), "__n"))  # read on both sides
    # a row becomes many draws, so few small files must not make few tasks
    spread = ranked.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__i")
    picks = spread.select(*keys, "__i", "__n", "__l", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("__b")).select(
        *keys, "__b", draw(F.col("__l"), F.col("__b"), F.col("__i"), F.col("__n")).alias("__i")
    )
    found = picks.join(ranked.select(*keys, "__i", value).hint("shuffle_hash"), [*keys, "__i"])
    return found.select(*keys, "__b", value, F.lit(1).cast("long").alias("__w"))


# Poisson(1) by its inverse distribution function on 60 bits: a draw is the number of steps at or below a uniform one.
POISSON_STEPS = [math.floor(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) * 2**60) for k in range(16)]


def poisson_weights(df: DataFrame, keys: Sequence[str], value: str, order: str, resamples: int, label: Column | str) -> DataFrame:
    """keys, __b, value, __w: resamples where each row is held a Poisson(1) number of times.

    The number is fixed by a digest of (label, b, ``order``), so a row is weighed where it lies: no rank, no join, and an
    aggregate by resample sums before its shuffle.  The size of a resample varies around the group's own.  Rows of a group
    that share ``order`` share their weights.  NULL values take no part, rows held no times are left out.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("__l", F.lit(label) if isinstance(label, str) else label)
    rows = rows.select(*keys, "__l", F.col(order).alias("__o"), value, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("__b"))
    uniform = draw(F.col("__l"), F.col("__b"), F.col("__o"), F.lit(2**60))
    weight = sum(((F.col("__u") >= t).cast("long") for t in POISSON_STEPS), F.lit(0).cast("long"))
    return rows.withColumn("__u", uniform).where(F.col("__u") >= POISSON_STEPS[0]).select(*keys, "__b", value, weight.alias("__w"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(weight * value) / F.sum(weight)


def trimmed_mean(cut: float) -> Callable[[Column, Column], Column]:
    """Mean without the floor(``cut`` * n) lowest and highest of the n values held, as a grouped-aggregate Pandas UDF."""

    def mean(value: pd.Series, weight: pd.Series) -> float:
        order = np.argsort(value.to_numpy(), kind="stable")
        v, w = value.to_numpy()[order], weight.to_numpy()[order]
        high = np.cumsum(w)
        n = int(high[-1])
        drop = math.floor(cut * n)
        held = np.clip(np.minimum(high, n - drop) - np.maximum(high - w, drop), 0, None)
        return float((held * v).sum() / held.sum()) if held.sum() else float("nan")

    return F.pandas_udf(mean, "double")


def bootstrap(df: DataFrame, keys: Sequence[str], value: str, order: str, resamples: int, label: Column | str,
              statistic: Callable[[Column, Column], Column] = weighted_mean, weights: Callable[..., DataFrame] = drawn_weights,
              merge: bool = False, tails: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """keys, low, high: bootstrap interval of a caller's statistic per group (H2).

    ``statistic`` makes an aggregate of the columns (value, times held).  One of built-in functions is summed before the shuffle.
    A grouped-aggregate Pandas UDF gets one resample of one group in one task; ``merge`` sums the times of equal values
    first, so that it holds distinct values only, and it suits values of which a group has a bounded number.
    ``weights``: ``drawn_weights`` or ``poisson_weights``.
    """
    keys = list(keys)
    x = weights(df, keys, value, order, resamples, label)
    if merge:
        x = x.groupBy(*keys, "__b", value).agg(F.sum("__w").alias("__w"))
    return _interval(x.groupBy(*keys, "__b").agg(statistic(F.col(value), F.col("__w")).alias("__s")), keys, tails)


def _interval(est: DataFrame, keys: Sequence[str], tails: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    # Resample counts are a parameter, so one group's estimates are a bounded set.
    low, high = (F.round(F.percentile("__s", p), 6) for p in tails)
    return est.groupBy(*keys).agg(low.alias("low"), high.alias("high"))


def bootstrap_ci(df: DataFrame, key: str, value: str, order: str, stat: str, resamples: int, label: str) -> DataFrame:
    """95 % bootstrap interval of the mean, or of a percentile such as "p95", per group (A5).

    The draws differ from a sequential generator by design.  Percentiles are exact at any number of distinct values:
    they are ranked by chunked running counts.
    """
    text = F.concat_ws(":", F.lit(label), key)
    if stat == "mean":
        return bootstrap(df, [key], value, order, resamples, text)
    q = int(stat[1:]) / 100
    byv = drawn_weights(df, [key], value, order, resamples, text).groupBy(key, "__b", value).agg(F.sum("__w").alias("__w"))
    x = running(byv, [key, "__b"], value, {"__hi": rsum(F.col("__w")), "__lo": rsum(F.col("__w"), inclusive=False),
                                           "__t": rtotal(F.col("__w"))})
    pos = (F.col("__t") - 1) * F.lit(q)
    at = lambda i: F.max(F.when((F.col("__lo") <= i) & (i < F.col("__hi")), F.col(value)))
    weight = F.max(pos - F.floor(pos))
    est = x.groupBy(key, "__b").agg((at(F.floor(pos)) * (1 - weight) + at(F.ceil(pos)) * weight).alias("__s"))
    return _interval(est, [key])


def paired(df: DataFrame, pair: Sequence[str], policy: str, baseline, success: str, on_success: Sequence[str],
           on_failure: Sequence[str]) -> DataFrame:
    """Comparison minus baseline per pair; success and failure populations kept apart."""
    cols = [success, *dict.fromkeys([*on_success, *on_failure])]
    base = df.where(F.col(policy) == baseline).select(*pair, *[F.col(c).alias(f"__b_{c}") for c in cols])
    x = df.where(F.col(policy) != baseline).join(base, list(pair))
    s, b = F.col(success), F.col(f"__b_{success}")
    both, neither = s & b, ~s & ~b
    return x.select(
        *pair, policy, (s.cast("long") - b.cast("long")).alias("success_delta"),
        *[F.when(both, F.col(c) - F.col(f"__b_{c}")).alias(f"success_{c}_delta") for c in on_success],
        *[F.when(neither, F.col(c) - F.col(f"__b_{c}")).alias(f"failure_{c}_delta") for c in on_failure],
    )


def design_gaps(df: DataFrame, unit: str, cells: dict[str, Sequence]) -> DataFrame:
    """Missing, unknown and repeated cells of unit x declared cells.

    The declared levels are literals and only incomplete units are expanded, so nothing is cross joined.
    """
    dims = list(cells)
    seen = df.groupBy(unit, *dims).agg(F.count("*").alias("__n"))
    known = F.lit(True)
    for c, levels in cells.items():
        known = known & F.coalesce(F.col(c).isin(list(levels)), F.lit(False))
    size = 1
    for levels in cells.values():
        size *= len(levels)
    extra = seen.withColumn("__known", known).where(~F.col("__known") | (F.col("__n") > 1)).select(
        unit, *dims, F.when(~F.col("__known"), "unknown").otherwise("duplicate").alias("code")
    )
    short = seen.withColumn("__known", known).groupBy(unit).agg(F.count_if("__known").alias("__c")).where(F.col("__c") < size)
    grid = short.select(unit)
    for c, levels in cells.items():
        grid = grid.withColumn(c, F.explode(F.array(*[F.lit(v).cast(df.schema[c].dataType) for v in levels])))
    missing = grid.join(seen.select(unit, *dims), [unit, *dims], "left_anti").withColumn("code", F.lit("missing"))
    return missing.select(unit, *dims, "code").unionByName(extra)


def witnesses(df: DataFrame, keys: Sequence[str], identity: Sequence[str], policy: str, required: Sequence) -> DataFrame:
    """One identity per key and every required policy present."""
    return df.groupBy(*keys).agg(
        F.countDistinct(F.struct(*identity)).alias("identities"),
        F.countDistinct(F.when(F.col(policy).isin(list(required)), F.col(policy))).alias("policies"),
    ).withColumn("passed", (F.col("identities") == 1) & (F.col("policies") == len(set(required))))


def binding(df: DataFrame, keys: Sequence[str], success: str) -> DataFrame:
    """A condition binds when some runs pass and some fail."""
    return df.groupBy(*keys).agg(
        F.bool_or(success).alias("any_pass"), F.bool_and(success).alias("all_pass"),
        (F.bool_or(success) & ~F.bool_and(success)).alias("binding"),
    )


def balanced_order(df: DataFrame, block: str, sample: str, system: str, salt: str) -> DataFrame:
    """Rotating, block-reversed run order of the systems of a sample.

    Base order by a digest; systems per sample are few by contract, samples are many.
    """
    from pyspark.sql import Window

    per = Window.partitionBy(block, sample)
    base = F.row_number().over(per.orderBy(F.md5(F.concat_ws(":", F.lit(salt), F.col(system).cast("string"))), system)) - 1
    n = F.count("*").over(per)
    x = df.select("*", base.alias("__base"), n.alias("__n"))
    turned = F.when((F.floor(F.col(sample) / F.col("__n")) % 2) == 1, F.col("__n") - 1 - F.col("__base")).otherwise(F.col("__base"))
    return x.withColumn("position", F.pmod(turned - F.col(sample), F.col("__n")).cast("long")).drop("__base", "__n")


def classify_safety(outcome: Column, effect_state: Column, calls: Column, effects: Column, unauthorized: Column):
    """(guardrail passed, safe refusal) from explicit facts."""
    boundary = ~calls & (effects == 0) & (unauthorized == 0)
    guard = boundary & (
        ((outcome == "passed") & (effect_state == "proposed")) | ((outcome == "refused") & (effect_state == "none"))
    )
    guard = F.coalesce(guard, F.lit(False))
    return guard, (outcome == "refused") & guard
