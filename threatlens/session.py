"""Session settings and the shared folder for checkpoints and stream state."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app_name: str = "threatlens", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators expect; ``conf`` keys may use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A skewed join is split even when that costs one more shuffle after it.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings["spark.ui.showConsoleProgress"] = "false"
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application for one stateful stream: RocksDB state, its number of partitions."""
    own = spark.newSession()
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        "spark.sql.shuffle.partitions": partitions or spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        own.conf.set(key, str(value))
    return own


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(), os.path.basename(package))
        context.addPyFile(
            shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
        )
        _SHIPPED.add(context.applicationId)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the results rely on: event times are UTC, skewed joins may be split."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return ship(spark)


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only when none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="threatlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    Used where several later steps need the same expensive result: it is computed once, its lineage
    is cut, a lost executor costs nothing, and its measured size drives later join choices.
    """
    return store(df, fresh_folder(df.sparkSession, label))


def store(df: DataFrame, path: str) -> DataFrame:
    """Writes a table to a folder, or adds it to what is there, and reads it all back. What was exchanged on the way
    is deleted at once; otherwise it stays on the disks until the driver happens to collect its garbage."""
    spark = df.sparkSession
    with _exchanges_deleted(spark):
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_DELETES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITERS, _LOCAL = threading.Lock(), {}, threading.local()


@contextmanager
def _exchanges_deleted(spark: SparkSession) -> Iterator[None]:
    """While this lasts, actions of the session (several threads may write) delete their shuffle files when they end."""
    with _LOCK:
        count, before = _WRITERS.get(id(spark), (0, spark.conf.get(_DELETES, None)))
        _WRITERS[id(spark)] = (count + 1, before)
        spark.conf.set(_DELETES, "true")
    try:
        yield
    finally:
        with _LOCK:
            count, before = _WRITERS.pop(id(spark))
            if count > 1:
                _WRITERS[id(spark)] = (count - 1, before)
            elif before is None:
                spark.conf.unset(_DELETES)
            else:
                spark.conf.set(_DELETES, before)


#: Estimated size of a table up to which it is worked on as a whole where disk would run short otherwise.
SLICE_BYTES = 1 << 29


def sliced(df: DataFrame, key: str, slice_bytes: int | None = None) -> list[DataFrame]:
    """The table, or slices of it by a hash of the key if Spark takes it for larger than ``slice_bytes``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(1, -(-size // (slice_bytes or SLICE_BYTES)))
    if n == 1:
        return [df]
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == F.lit(i)) for i in range(n)]


def settle_parts(spark: SparkSession, parts: Iterable[Callable[[], DataFrame]], label: str) -> DataFrame:
    """The parts one after another in one stored table. Tables that making a part stores are deleted when it is written,
    so a part must not store anything that is used later."""
    path, out = fresh_folder(spark, label), None
    for part in parts:
        outer, _LOCAL.made = getattr(_LOCAL, "made", None), []
        try:
            out = store(part(), path)
        finally:
            made, _LOCAL.made = _LOCAL.made, outer
            for folder in made:
                discard(spark, folder)
    return out


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/threatlens-{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below this application's part of the shared one."""
    folder = f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if getattr(_LOCAL, "made", None) is not None:
        _LOCAL.made.append(folder)
    return folder


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``fresh_folder`` named, when nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes the intermediate tables this application stored; call it when its results are written."""
    discard(spark, _session_folder(spark))
