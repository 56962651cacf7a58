"""Overlapping intervals without pairing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.scan import rmax, rmin, running


def conflicting_use(df: DataFrame, keys: Sequence[str], start: str, end: str, writes: str,
                    ident: Sequence[str]) -> DataFrame:
    """Intervals that overlap another use of the same resource with at least one write.

    Half-open intervals; empty ones are ignored.  A pair exists when an interval starts before the latest
    end seen earlier, or another begins before this one ends; a write conflicts with any use and a read
    with a write only.  So running maxima of the ends and running minima of the starts decide every row,
    and no pair is built.  Equal rows are counted, not repeated.
    """
    x = df.where(F.col(start) < F.col(end)).groupBy(*keys, *ident, start, end, writes).agg(F.count("*").alias("copies"))
    tie = [end, writes, *ident]
    w = F.col(writes)
    fwd = running(
        x, keys, start,
        {"__end": rmax(F.col(end), inclusive=False), "__wend": rmax(F.when(w, F.col(end)), inclusive=False)},
        tie=tie,
    )
    # The same order backwards: negated columns give the earliest start that follows.
    back = fwd.withColumns({"__s": -F.col(start), "__e": -F.col(end), "__w": F.when(w, 0).otherwise(1),
                            "__id": F.struct(*[(-F.col(c)).alias(c) for c in ident])})
    both = running(
        back, keys, "__s",
        {"__next": rmin(F.col(start), inclusive=False), "__wnext": rmin(F.when(w, F.col(start)), inclusive=False)},
        tie=["__e", "__w", "__id"],
    )
    before = F.when(w, F.col("__end")).otherwise(F.col("__wend"))
    after = F.when(w, F.col("__next")).otherwise(F.col("__wnext"))
    hit = (before > F.col(start)) | (after < F.col(end)) | ((F.col("copies") > 1) & w)
    return both.where(F.coalesce(hit, F.lit(False))).select(*keys, *ident, start, end, writes, "copies")
