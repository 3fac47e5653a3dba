"""Helpers that several operators share: shared storage, ordered partitions, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python worker turns into Python objects at a time.
SLICE_ROWS = 128
#: Bytes of text that a Python worker handles at a time, where it works on whole columns.
SLICE_BYTES = 3 << 20

_STATE: dict[str, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests in local mode) a temporary folder of the driver is taken
    and set; it is removed when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    made = tempfile.mkdtemp(prefix="stepwell-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here,
    later reads survive lost executors, and each row is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, key: str, *ties: str, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``key`` ascending (nulls first), ties by a hash of ``ties``.

    The hash is part of the range key, so rows that share one key value are still split.
    Partition numbers ascend with the key.
    """
    spread = F.xxhash64(*[F.col(c) for c in ties]) if ties else F.lit(0)
    cols = df.columns
    df = df.withColumn("__tie", spread)
    keys = [F.col(key).asc_nulls_first(), F.col("__tie")]
    parts = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return parts.sortWithinPartitions(*keys).select(*cols)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces with about ``most`` bytes in a string column (a longer text is a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def worker_state(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, such as an encoder: one at a time, so that a worker that
    another operator used before holds nothing of it."""
    if name not in _STATE:
        _STATE.clear()
        _STATE[name] = make()
    return _STATE[name]


#: Rows of a few numbers each that may be broadcast (about 10 MB); larger tables are joined by key.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of a known number of rows, broadcast only up to ``BROADCAST_ROWS``; beyond, Spark joins by key."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_offsets(df: DataFrame, part: str, n: str) -> DataFrame:
    """``df`` with __before (sum of ``n`` in partitions of smaller number) and __total (in its own partition).

    One row a partition is summed up in one task; nothing of it passes the driver.
    """
    totals = df.groupBy(F.col(part).alias("__part")).agg(F.sum(n).cast("long").alias("__total"))
    run = F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = materialise(totals.withColumn("__before", run), "partition-offsets")
    return df.join(small(sums, sums.count()), F.col(part) == F.col("__part")).drop("__part")


def binary_rows(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Rows of ``n`` numbers each as binary values, without a copy."""
    ends = np.concatenate([[0], np.cumsum(n)]) * ids.dtype.itemsize
    wide = ends[-1] >= 1 << 31
    kind, offsets = (pa.large_binary(), ends.astype(np.int64)) if wide else (pa.binary(), ends.astype(np.int32))
    return pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def hashable(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """Columns that Spark can hash (all but maps and variants)."""

    def ok(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return ok(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(ok(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return [f.name for f in df.schema.fields if f.name not in without and ok(f.dataType)]


def spread_copies(df: DataFrame, key: str, rows: int, chunk: int = 10_000) -> DataFrame:
    """``df`` with ``key`` (a hash of all hashable columns) made different for rows equal in every column, where over ``rows`` share it.

    Such rows are counted (a partial aggregate) and dealt out again with a number each, so they don't meet in one task.
    Nothing changes for other rows, nor where a column can't be grouped by (a map).
    """
    cols = df.columns
    if set(hashable(df)) != set(cols):
        return df
    hot = materialise(df.groupBy(F.col(key).alias("__hot")).count().where(F.col("count") > rows).select("__hot"), "hot-keys")
    n = hot.count()
    if not n:
        return df
    same = df.join(small(hot, n), F.col(key) == F.col("__hot"), "left_semi").groupBy(*[F.col(quoted(c)) for c in cols]).agg(F.count(F.lit(1)).alias("__n"))
    same = same.withColumn("__c", F.explode(F.expr(f"sequence(0L, (__n - 1) div {chunk})"))).repartition(F.col(key), F.col("__c"))
    same = same.withColumn("__copy", F.explode(F.expr(f"sequence(__c * {chunk}, least(__n, (__c + 1) * {chunk}) - 1)")))
    same = same.withColumn(key, F.when(F.col("__copy") == 0, F.col(key)).otherwise(F.xxhash64(key, "__copy"))).select(*[F.col(quoted(c)) for c in cols])
    return df.join(small(hot, n), F.col(key) == F.col("__hot"), "left_anti").unionByName(same)


def quoted(name: str) -> str:
    """A column name as Spark SQL identifier, dots and backticks and all."""
    return "`" + name.replace("`", "``") + "`"
