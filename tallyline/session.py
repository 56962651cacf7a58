"""Session settings and durable materialisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 50_000  # rows of a key that may lie in one task

# Runtime settings the jobs rely on: AQE re-plans joins from observed sizes and splits skewed
# join partitions even where that costs one more shuffle.  Before a stage has run, sizes are guessed from
# compressed files, far below the rows a broadcast would hold in the driver, so only small tables are taken on a guess.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.  Where none is configured, a temporary one under a local master, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not _one_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="tallyline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder, so a lost executor costs one re-read; digests as hex take half under zstd."""
    path = fresh_dir(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A stage table in buckets of ``key``, as many as a shuffle has partitions: joins, aggregates and windows by the key, or by it
    and more columns, of such tables need no shuffle.  For keys of few rows, as a key lies in one bucket.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tallyline_{uuid.uuid4().hex}"
    rows = df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", fresh_dir(spark, "dealt"))
    rows.bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile join tables dealt by a key where they lie, also by more columns than the key."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def by_size(tables: Sequence[DataFrame], key: str, block: int = BLOCK) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """The tables without the keys that have more than ``block`` rows in them all, and the tables of those keys if there are any."""
    ids = reduce(DataFrame.unionByName, [t.select(key) for t in tables])
    big = durable(ids.groupBy(key).agg(F.count("*").alias("__n")).where((F.col("__n") > block) & F.col(key).isNotNull()).select(key))
    if big.isEmpty():
        return list(tables), None
    return [t.join(big, key, "left_anti") for t in tables], [t.join(big, key, "left_semi") for t in tables]
