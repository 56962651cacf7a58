"""Gapless numbers within groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 50_000


def number_rows(df: DataFrame, keys: Sequence[str], unique: Sequence[str], out: str, rows: int, chunk_rows: int = CHUNK_ROWS, size: Column | None = None) -> DataFrame:
    """``df`` with ``out``: 0, 1, ... within ``keys``, in an order that the hash of ``unique`` fixes.

    Rows of a group are dealt by hash into chunks of about ``chunk_rows``; chunk totals (few rows) give each
    chunk its start.  ``df`` is read twice, so it should be a table.  ``size``: number by sums instead of counts.
    """
    n = max(1, -(-rows // chunk_rows))
    part = df.withColumn("__chunk", F.pmod(F.xxhash64(*unique), F.lit(n)).cast("int"))
    step = F.lit(1).cast("long") if size is None else size
    by = [*keys, "__chunk"]
    totals = part.groupBy(*by).agg(F.sum(step).alias("__n"))
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    starts = totals.select(*by, (F.sum("__n").over(order.orderBy("__chunk")) - F.col("__n")).alias("__start"))
    inside = F.sum(step).over(Window.partitionBy(*by).orderBy(*unique).rowsBetween(Window.unboundedPreceding, 0)) - step
    return (
        part.withColumn("__inside", inside).join(starts, by, "inner")
        .withColumn(out, F.col("__inside") + F.col("__start")).drop("__chunk", "__inside", "__start")
    )
