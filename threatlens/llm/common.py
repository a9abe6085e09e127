"""Helpers shared by the operators: stored files, Arrow batches, running totals, label folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_folder, prepare

__all__ = [
    "fold", "fresh_folder", "list_column", "open_store", "prepare", "sent", "settle", "table", "unused", "with_offsets",
]

#: Rows up to which a stored narrow table (some 100 bytes a row in memory) is sent to all executors; beyond, it
#: is joined by exchange.
SENT_ROWS = 1 << 19
#: Bytes of variable-length data after which a task hands a batch on.
BATCH_BYTES = 4 << 20


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Writes an intermediate table to the shared folder with the session's compression and reads it back."""
    spark = df.sparkSession
    path = fresh_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file that all executors share."""
    return fs.FileSystem.from_uri(uri)


def fold(id_col: str) -> Column:
    """crc32 of the id's decimal text, modulo 5; null ids count as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def sent(rows: DataFrame, width: int = 1) -> DataFrame:
    """A stored narrow table, broadcast while its counted rows, ``width`` times as wide as usual, allow."""
    return F.broadcast(rows) if rows.count() * width <= SENT_ROWS else rows


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it, whatever its letters' case."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free


def list_column(parts: list[bytes]) -> pa.ListArray:
    """A list<int32> column of one list for each run of little-endian int32 values."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    flat = np.frombuffer(b"".join(parts), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def with_offsets(
    rows: DataFrame, part: str, size: str, start_in_part: str, out: str, stored: DataFrame | None = None
) -> DataFrame:
    """Adds the sum of ``size`` over all earlier rows of a stored, range-partitioned table.

    ``part`` numbers the range partitions in order and ``start_in_part`` is the running sum within one;
    ``stored`` is the whole table where ``rows`` are some of it. The totals table has one row per partition,
    so one window over it is small and its join is broadcast.
    """
    whole = rows if stored is None else stored
    totals = whole.groupBy(F.col(part).alias("_part")).agg(F.sum(size).alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_part", F.coalesce(before, F.lit(0)).cast("long").alias("_before"))
    joined = rows.join(F.broadcast(offsets), F.col(part) == F.col("_part"))
    return joined.withColumn(out, F.col("_before") + F.col(start_in_part)).drop("_part", "_before")
