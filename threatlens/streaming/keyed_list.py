"""A list of keys that micro-batches add to: one snapshot and a few deltas, named by a numbered version.

Each change writes a folder of its own and then a new version, a small file that names the snapshot and the deltas
that make up the list; a version is never changed. After a number of deltas the earlier ones are folded into a new
snapshot, so a reader opens a bounded number of folders, however many batches have been. A batch that is run again
finds its number in the list and changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "src_ip string, time timestamp, present boolean"
STORED = f"{ROWS}, batch long"


class KeyedList:
    """Keys with the time of their last change; ``present`` false takes a key off. Of one instant, off wins."""

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 10):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ── versions ──

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())

    def _version(self, number: int) -> dict | None:
        """What a version names; None for one whose writer was lost before it was whole."""
        stream = self._fs.open(self._path(f"{self.path}/versions/{number}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def current(self) -> tuple[int, dict]:
        """Number and content of the latest whole version."""
        for number in reversed(self._numbers()):
            version = self._version(number)
            if version is not None:
                return number, version
        return 0, {"batch": -1, "snapshot": None, "deltas": []}

    def _publish(self, version: dict) -> int:
        """Writes the next version; fails if another writer has just taken its number."""
        number = max(self._numbers(), default=0) + 1
        stream = self._fs.create(self._path(f"{self.path}/versions/{number}"), False)
        stream.write(bytearray(json.dumps(version).encode()))
        stream.close()
        return number

    # ── rows ──

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select("src_ip", "time", "present", "batch").write.parquet(f"{self.path}/parts/{name}")
        return name

    def _rows(self, version: dict) -> DataFrame:
        names = [n for n in [version["snapshot"], *version["deltas"]] if n]
        if not names:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*[f"{self.path}/parts/{n}" for n in names])

    @staticmethod
    def _folded(rows: DataFrame) -> DataFrame:
        """The last change of each key."""
        last = F.max(F.struct("time", (~F.col("present")).alias("off"), "batch")).alias("last")
        return rows.groupBy("src_ip").agg(last).select(
            "src_ip", "last.time", (~F.col("last.off")).alias("present"), "last.batch"
        )

    def members(self, before: int | None = None) -> DataFrame:
        """(src_ip, time) of the keys on the list, by all changes or by those before a batch."""
        rows = self._rows(self.current()[1])
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return self._folded(rows).where("present").select("src_ip", "time")

    def add(self, batch: int | None, rows: DataFrame) -> bool:
        """Applies the changes of a batch unless it has been applied; of no batch: on top of the latest one.

        Only changes before this batch are folded, so the list as it was before the batch can still be read when
        the batch is run again.
        """
        _, version = self.current()
        if batch is not None and batch <= version["batch"]:
            return False
        number = version["batch"] if batch is None else batch
        delta = self._write(rows.withColumn("batch", F.lit(number).cast("long")))
        snapshot, deltas = version["snapshot"], version["deltas"]
        if batch is not None and len(deltas) >= self.compact_after:
            snapshot, deltas = self._write(self._folded(self._rows(version))), []
        self._publish({"batch": number, "snapshot": snapshot, "deltas": [*deltas, delta]})
        self._clean()
        return True

    def _clean(self) -> None:
        """Deletes what neither the latest version nor the one before it names; readers may still use that one."""
        kept, used = [], set()
        for number in reversed(self._numbers()):
            version = self._version(number) if len(kept) < 2 else None
            if version is None:
                if len(kept) == 2:
                    self._fs.delete(self._path(f"{self.path}/versions/{number}"), False)
                continue
            kept.append(number)
            used |= {version["snapshot"], *version["deltas"]}
        for part in self._fs.listStatus(self._path(f"{self.path}/parts")):
            if part.getPath().getName() not in used:
                self._fs.delete(part.getPath(), True)

    def n_parts(self) -> int:
        """Folders that a reader opens."""
        _, version = self.current()
        return len(version["deltas"]) + (version["snapshot"] is not None)
