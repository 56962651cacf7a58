"""Ordered scans that never bring one whole key into one task.

A plain ``Window.partitionBy(run).orderBy(sequence)`` sends a run to one task, however large it is.
Here a key is cut into chunks of its integer order column (``order >> bits``).  Each chunk is scanned
on its own; the chunk totals, at most one row per chunk, are scanned once more and carried back in by
an equi join.  With orders below ``2**42`` both levels see at most ``2**21`` distinct positions each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 21
CHUNK = "__chunk"


@dataclass(frozen=True)
class Running:
    kind: str
    value: Column
    inclusive: bool = True


def rsum(value, inclusive=True):
    return Running("sum", value, inclusive)


def rcount(condition=None, inclusive=True):
    one = F.lit(1).cast("long")
    return Running("sum", one if condition is None else F.when(condition, one).otherwise(0), inclusive)


def rmax(value, inclusive=True):
    return Running("max", value, inclusive)


def rmin(value, inclusive=True):
    return Running("min", value, inclusive)


def rlast(value, inclusive=True):
    """Latest non-null value so far."""
    return Running("last", value, inclusive)


def rlag(value):
    """Value on the previous row of the key, null included."""
    return Running("lag", F.struct(value.alias("v")), False)


def rtotal(value):
    """Whole-key sum on every row."""
    return Running("total", value)


def chunk_of(order: str, bits: int = BITS) -> Column:
    return F.shiftright(F.col(order).cast("long"), bits)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    specs: dict[str, Running],
    tie: Sequence[str] = (),
    bits: int = BITS,
    lead: Sequence[str] = (),
) -> DataFrame:
    """Append running values over ``(*lead, order, *tie)`` inside each key; keys must not be null.

    ``lead`` columns take few values and sort before the integer ``order``.
    """
    keys = list(keys)
    part = [*keys, CHUNK]
    chunk = chunk_of(order, bits)
    base = df.withColumn(CHUNK, F.struct(*lead, chunk.alias("o")) if lead else chunk)
    local = Window.partitionBy(*part).orderBy(order, *tie)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = chunks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    at = F.struct(order, *tie)

    totals, carries, inner, out = [], [], [], []
    for name, spec in specs.items():
        frame = upto if spec.inclusive else before
        t, c, i = f"__t_{name}", f"__c_{name}", f"__i_{name}"
        if spec.kind == "total":
            totals.append(F.sum(spec.value).alias(t))
            carries.append(F.sum(t).over(whole).alias(c))
            out.append(F.col(c).alias(name))
            continue
        if spec.kind in ("last", "lag"):
            totals.append(F.max_by(spec.value, F.when(spec.value.isNotNull(), at)).alias(t))
            carries.append(F.last(t, ignorenulls=True).over(carried).alias(c))
            inner.append(F.last(spec.value, ignorenulls=True).over(frame).alias(i))
            merged = F.coalesce(i, c)
            out.append((merged["v"] if spec.kind == "lag" else merged).alias(name))
            continue
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[spec.kind]
        totals.append(agg(spec.value).alias(t))
        carries.append(agg(t).over(carried).alias(c))
        inner.append(agg(spec.value).over(frame).alias(i))
        if spec.kind == "sum":
            merged = F.coalesce(c, F.lit(0)) + F.coalesce(i, F.lit(0))
        else:
            merged = (F.greatest if spec.kind == "max" else F.least)(c, i)
        out.append(merged.alias(name))

    carry = base.groupBy(*part).agg(*totals).select(*part, *carries)
    return (
        base.select("*", *inner)
        .join(carry, part, "left")
        .select(*[F.col(c) for c in df.columns if c not in specs], *out)
    )


def peak(df: DataFrame, keys: Sequence[str], order: str, delta: str, bits: int = BITS) -> DataFrame:
    """Largest running sum of ``delta`` per key; one shuffle of the net deltas, no join back."""
    keys = list(keys)
    part = [*keys, CHUNK]
    net = df.groupBy(*keys, order).agg(F.sum(delta).alias("__d")).withColumn(CHUNK, chunk_of(order, bits))
    local = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    chunk = (
        net.withColumn("__r", F.sum("__d").over(local))
        .groupBy(*part)
        .agg(F.sum("__d").alias("__sum"), F.max("__r").alias("__high"))
    )
    carried = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("__sum").over(carried), F.lit(0)) + F.col("__high")
    return (
        chunk.select(*keys, level.alias("__level"))
        .groupBy(*keys)
        .agg(F.greatest(F.max("__level"), F.lit(0)).alias("peak"))
    )
