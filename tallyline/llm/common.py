"""Words, Arrow passes and shared-folder files used by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import durable, fresh_dir, tune

__all__ = [
    "ARROW_ROWS", "arrow_map", "base", "crc_mod", "durable", "free_name", "fresh_dir", "open_store", "plain_words", "space_words", "table", "text_bytes",
]

ARROW_ROWS = 256  # rows of one Arrow batch, so that a batch of long texts stays a few MB

_WORD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def base(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: AQE with skew splits, Spark's own limit of planned broadcasts, small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return base(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of 0-9, a-z and everything outside ASCII, of UTF-8 bytes."""
    return data.translate(_WORD).split()


def space_words(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of what is not a space or one of the control characters 9 to 13."""
    return data.lower().split()


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value's decimal text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string")) % n


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all executors reach."""
    if "://" not in uri and uri.startswith("file:"):
        uri = uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)
