"""Sizing, shared storage and bucketing helpers for the operators."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input that one shuffle partition should hold at most.
PARTITION_BYTES = 64 << 20
#: Rows of a few numbers that are broadcast, at most; rows that make a class hot.
SMALL_ROWS, HOT_ROWS = 200_000, 2_000


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``; where it has none, its strings and binaries are added up."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    names = [f"c{k}" for k in range(len(df.columns))]
    flat = df.toDF(*names)
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in flat.schema if f.dataType.typeName() in ("string", "binary")]
    row = sum(long, F.lit(8 * len(names))).cast("long")
    return int(flat.agg(F.sum(row).alias("n")).first().n or 0)


def partitions(df: DataFrame, per_partition: int = PARTITION_BYTES) -> int:
    """Shuffle partitions for an operator: the session's number, or more for an input of known larger size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // per_partition))


def ready(spark: SparkSession) -> None:
    """Makes sure that there is a checkpoint folder: the session's own, else a temporary one, which only local runs may use."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there, so that no lineage is left."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many rows of a few numbers, for a join: broadcast only if they are few."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def id_bucket(column: Column, buckets: int, other: Column) -> Column:
    """A bucket for an integer id, from all bits of its hash; null ids are dealt by ``other``."""
    h = F.when(column.isNotNull(), F.xxhash64(column.cast("long"))).otherwise(F.xxhash64(other))
    return F.pmod(h, F.lit(buckets)).cast("int")


def hash_buckets(values: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of 64-bit hashes."""
    return (((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def crc_part(column: str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


_CODEC = "zstd"


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed differences; small for ascending or repeated ones."""
    d = np.ascontiguousarray(values, dtype=np.int64)
    return pa.compress(np.diff(d, prepend=np.int64(0)).tobytes(), codec=_CODEC, asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec=_CODEC, asbytes=True), np.int64))


def binaries(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return column.to_pylist()


def string_array(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string column from bytes and offsets."""
    large = offsets[-1] >= 1 << 31
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(
        pa.large_string() if large else pa.string(),
        len(offsets) - 1,
        [bits, pa.py_buffer(np.ascontiguousarray(offsets, np.int64 if large else np.int32)), pa.py_buffer(np.ascontiguousarray(data))],
    )
