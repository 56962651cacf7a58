"""Labelled rows: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import crc_mod

FOLDS, HELD_OUT = 4, 2


def held_out(column: str = "doc_id"):
    return F.coalesce(crc_mod(column, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")


def trainable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y (0/1) of rows that are not held out; repeated ids take the majority, ties 1; null ids and labels are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    )


def sample(labels: DataFrame, label: str, per_class: dict[int, int]) -> DataFrame:
    """At most ``per_class[y]`` rows of each class, in the order of the id's hash."""
    rows = trainable(labels, label)
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in sorted(per_class.items())]
    return parts[0].unionByName(parts[1])
