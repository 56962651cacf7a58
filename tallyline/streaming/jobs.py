"""Streams: tail, exactly-once append, windows, status, and draining to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import fresh_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """The append-only event log as a resumable stream; the cursor is the source offset."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def exactly_once(events: DataFrame, ident: str, at: str, delay: str | None = None) -> DataFrame:
    """Each event id once, however late it or its repeats come (X2); all ids stay in the state.

    With ``delay``, ids are kept within that watermark only: later rows are dropped, and later repeats may be taken again.
    """
    if delay is None:
        return events.dropDuplicates([ident])
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([ident])


def quota_stream(calls: DataFrame, provider: str, at: str, tokens: str, width: str, delay: str | None = None) -> DataFrame:
    """Calls and tokens per provider and tumbling window (X3); all windows stay open.

    With ``delay``, windows close by that watermark and rows later than it are dropped.
    """
    return (
        (calls if delay is None else calls.withWatermark(at, delay)).groupBy(provider, F.window(at, width).alias("w"))
        .agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))
        .select(provider, F.unix_millis("w.start").alias("window_ms"), "calls", "tokens")
    )


def status_stream(events: DataFrame, key: str, seq: str, kind: str, terminal: Sequence[str]) -> DataFrame:
    """Current state, event count and usage of every run, as an updating table."""
    done = F.col(kind).isin(list(terminal))
    return events.groupBy(key).agg(
        F.coalesce(F.max_by(kind, F.when(done, F.col(seq))), F.lit("running")).alias("state"),
        F.count("*").alias("events"), F.sum(F.when(done, F.col("units")).otherwise(0)).alias("units"),
    )


def _places(spark: SparkSession, label: str, folder: str | None) -> tuple[str, str]:
    """Folders of a job's table and of its checkpoint."""
    if folder is None:
        return fresh_dir(spark, label), fresh_dir(spark, f"{label}-checkpoint")
    return f"{folder.rstrip('/')}/table", f"{folder.rstrip('/')}/checkpoint"


def drain(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Run an append stream over what is available and return the table it wrote.

    With the same ``folder`` a later call, also after a lost driver, goes on where the last one ended and returns all rows;
    without one each call starts anew.
    """
    spark = stream.sparkSession
    out, mark = _places(spark, label, folder)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: Sequence[str], label: str, folder: str | None = None) -> DataFrame:
    """Run an updating stream and return the last version of every key; ``folder`` as in ``drain``.

    Each batch lands in its own folder by batch id, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    out, mark = _places(spark, label, folder)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, "__r.*")
