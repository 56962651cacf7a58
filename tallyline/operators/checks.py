"""Turning predicates into violation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """Two-valued reading of a condition: unknown counts as not holding."""
    return F.coalesce(condition, F.lit(False))


def violations(df: DataFrame, checks: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per (row, failed check); ``checks`` maps a code to the condition that must hold."""
    codes = F.array_compact(
        F.array(*[F.when(~holds(ok), F.lit(code)) for code, ok in checks.items()])
    )
    return df.select(*keys, F.explode(codes).alias("code"))


def flagged(df: DataFrame, flags: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per (row, raised flag)."""
    codes = F.array_compact(F.array(*[F.when(holds(bad), F.lit(code)) for code, bad in flags.items()]))
    return df.select(*keys, F.explode(codes).alias("code"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def dangling(df: DataFrame, ref: str, target: DataFrame, target_ref: str) -> DataFrame:
    """Rows whose non-null reference has no target."""
    known = target.select(F.col(target_ref).alias(ref)).distinct()
    return df.where(F.col(ref).isNotNull()).join(known, ref, "left_anti")


def set_difference(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, unknown and duplicate keys (U1); both sides are reduced to one row per key first."""
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    o = observed.groupBy(*keys).agg(F.count("*").alias("__n"))
    both = e.join(o, list(keys), "full_outer")
    code = (
        F.when(F.col("__n").isNull(), "missing")
        .when(F.col("__e").isNull(), "unknown")
        .when(F.col("__n") > 1, "duplicate")
    )
    return both.select(*keys, code.alias("code")).where("code is not null")


def order_breaches(expected: DataFrame, observed: DataFrame, keys: Sequence[str], ident: str, want: str, got: str) -> DataFrame:
    """Ids of both lists that stand at another place among those ids than expected.

    ``expected``: keys, ident, want; ``observed``: keys, ident, got; integer positions, ties by id.  Ids of one list only and
    repeated ones are ``set_difference``'s; of a repeated id the first place counts.
    """
    from tallyline.operators.scan import rcount, running

    keys = list(keys)
    e = expected.groupBy(*keys, ident).agg(F.min(want).alias(want))
    o = observed.groupBy(*keys, ident).agg(F.min(got).alias(got))
    x = running(e.join(o, [*keys, ident]), keys, want, {"expected_at": rcount()}, tie=[ident])
    x = running(x, keys, got, {"observed_at": rcount()}, tie=[ident])
    return x.where("expected_at <> observed_at").select(*keys, ident, "expected_at", "observed_at")


def transition_breaches(df: DataFrame, state: str, previous: str, legal: dict[str, Sequence[str]],
                        initial: Sequence[str]) -> DataFrame:
    """Rows whose (previous, state) step is not in the legal table."""
    ok = F.col(previous).isNull() & F.col(state).isin(list(initial))
    for source, targets in legal.items():
        ok = ok | ((F.col(previous) == source) & F.col(state).isin(list(targets)))
    return df.where(~holds(ok))


def validate_outputs(df: DataFrame, accepts: Column, keys: Sequence[str]) -> DataFrame:
    """Rows a caller's validator refuses; ``accepts`` is any boolean column, a built-in expression or a
    pandas UDF applied to the output columns. An unknown verdict refuses."""
    return df.where(~holds(accepts)).select(*keys, F.lit("output_validation_failed").alias("code"))
