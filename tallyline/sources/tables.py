"""Event tails, canonical writers, evidence folders, idempotent append and outbox."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.evidence import manifest_breaches


def events_after(events: DataFrame, run_id, cursor: int, limit: int | None = None) -> DataFrame:
    """A run's ordered events after a cursor (S2); both conditions reach the scan."""
    rows = events.where((F.col("run_id") == run_id) & (F.col("sequence") > cursor)).orderBy("sequence")
    return rows if limit is None else rows.limit(limit)


def write_records(df: DataFrame, path: str, order: Sequence[str], partitions: int | None = None) -> None:
    """JSON lines whose files, read in name order, follow ``order``."""
    args = [partitions] if partitions else []
    df.repartitionByRange(*args, *order).sortWithinPartitions(*order).write.json(path)


CHUNK_BYTES = 1 << 20


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size and digest of files, read a chunk at a time through Arrow's file systems."""
    opened: dict[str, tuple[fs.FileSystem, str]] = {}
    for pdf in batches:
        found = []
        for path, name in zip(pdf["path"], pdf["name"], strict=True):
            root, inner = re.match(r"([^:/]+:(?://[^/]*)?)?(.*)", path, re.DOTALL).groups()
            if not root or root.startswith("file:"):
                store, base = fs.LocalFileSystem(), ""
            else:
                if root not in opened:
                    opened[root] = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", root) + "/")
                store, base = opened[root]
            digest, size = hashlib.sha256(), 0
            with store.open_input_stream(base.rstrip("/") + inner) as stream:
                while part := stream.read(CHUNK_BYTES):
                    digest.update(part)
                    size += len(part)
            found.append((name, size, digest.hexdigest()))
        yield pd.DataFrame(found, columns=["name", "bytes", "sha256"])


def folder_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name (path below the folder), bytes, sha256 of every data file at any depth.

    Spark lists the files and deals them by size; a task reads a file in chunks, so no file is a row.  Names that start with
    a dot or an underscore, of files or folders below, are no data; Spark's scan leaves out files of no bytes.  ``folder`` is absolute or a URI.
    """
    inner = re.sub(r"^[^:/]+:(//[^/]*)?", "", folder).rstrip("/")
    if inner and not inner.startswith("/"):
        raise ValueError("give the evidence folder as an absolute path or a URI")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.expr("substring(regexp_replace(path, '^[^:/]+:(//[^/]*)?', ''), {})".format(len(re.sub("/+", "/", inner)) + 2))
    rows = files.select("path", name.alias("name")).where(~F.col("name").rlike(r"(^|/)[._]"))
    return rows.mapInPandas(_digests, "name string, bytes bigint, sha256 string")


def write_evidence(df: DataFrame, folder: str, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Write records below ``folder``/records and their manifest below ``folder``/manifest."""
    spark = df.sparkSession
    write_records(df, f"{folder}/records", order, partitions)
    folder_manifest(spark, f"{folder}/records").write.json(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("name string, bytes bigint, sha256 string").json(f"{folder}/manifest")


def verify_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Missing, extra, resized or altered files against the manifest; empty when the folder is intact."""
    return manifest_breaches(read_manifest(spark, folder), folder_manifest(spark, f"{folder}/records"), "name")


def append_new(new: DataFrame, path: str, key: Sequence[str]) -> None:
    """Append rows whose key is not stored yet, once per key (S8, sink side)."""
    spark = new.sparkSession
    rest = [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(*key, "__r.*")
    try:
        stored = spark.read.schema(new.schema).parquet(path).select(*key)
    except Exception as error:  # the first append finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = None
    fresh = one if stored is None else one.join(stored, list(key), "left_anti")
    fresh.select(*new.columns).write.mode("append").parquet(path)


def pending_outbox(outbox: DataFrame, acks: DataFrame, limit: int) -> DataFrame:
    """Oldest unacknowledged messages in commit order (S9); the limit is the caller's page size."""
    if limit <= 0:
        raise ValueError("outbox limit must be positive")
    done = acks.select("event_id").distinct()
    return outbox.join(done, "event_id", "left_anti").orderBy("sequence").limit(limit)


def acknowledge(messages: DataFrame, published_at: int, path: str) -> None:
    """Append acknowledgements; a second one for the same message changes nothing."""
    append_new(messages.select("event_id", F.lit(published_at).cast("long").alias("published_at")), path, ["event_id"])
