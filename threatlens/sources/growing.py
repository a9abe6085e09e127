"""A streaming source that follows text files while they grow, by (file, byte) offsets.

Spark's file source takes a file once, when it appears; what is appended later is never read. Here an offset holds,
for each file of a folder (or for one file), the byte behind the last whole line that has been delivered. A micro-batch
is cut into byte ranges, read by tasks in parallel, and a line belongs to the range that it begins in. Half a line at
the end of a file waits for its rest.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# Sources are planned by a process of the driver that does not see shipped files, so this module travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that one task reads, and that are looked through at once for line ends.
RANGE_BYTES, BLOCK_BYTES = 32 << 20, 1 << 20
#: Lines of one Arrow batch.
BATCH_LINES = 10_000


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


@dataclass
class LineRange(InputPartition):
    """Lines of a file that begin within [begin, end); ``begin`` of ``first`` is known to be the begin of a line."""

    path: str
    begin: int
    end: int
    first: bool

    def __post_init__(self) -> None:
        super().__init__(self.path)


def whole_lines(store: fs.FileSystem, path: str, size: int, least: int = 0) -> int:
    """The byte behind the last line end before ``size``, not below ``least``."""
    with store.open_input_file(path) as file:
        end = size
        while end > least:
            begin = max(least, end - BLOCK_BYTES)
            at = file.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return least


def lines_of(part: LineRange, store: fs.FileSystem, stop: int) -> Iterator[bytes]:
    """The lines of a range without their ends; ``stop`` is where whole lines of the file end."""
    with store.open_input_file(part.path) as file:
        # A line that begins with the range follows a line end, which is the byte before it.
        at = part.begin if part.first else part.begin - 1
        skip, rest = not part.first, b""
        begin = at  # of the line that ``rest`` belongs to
        while at < stop:
            block = file.read_at(min(BLOCK_BYTES, stop - at), at)
            at += len(block)
            pieces = (rest + block).split(b"\n")
            rest = pieces.pop()
            for line in pieces:
                if skip:
                    skip = False
                elif begin >= part.end:
                    return
                else:
                    yield line
                begin += len(line) + 1
            if begin >= part.end and not skip:
                return


class GrowingLines(DataSourceStreamReader):
    """Reader of delimited lines; options path, header, separator."""

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.uri = options["path"]
        self.header = str(options.get("header", "false")).lower() == "true"
        self.separator = options.get("separator", ",")
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Whole lines of each file by now. Files are looked into only where they have grown."""
        store, base = store_of(self.uri)
        info = store.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        for file in found:
            if file.type != fs.FileType.File or file.base_name.startswith((".", "_")):
                continue
            size, upto = self.seen.get(file.path, (0, 0))
            if file.size < upto:
                raise ValueError(f"{file.path} has become shorter: a log only grows, a rotated one takes a new name")
            if file.size > size:
                self.seen[file.path] = (file.size, whole_lines(store, file.path, file.size, upto))
        return {path: upto for path, (_, upto) in sorted(self.seen.items()) if upto}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        ranges = []
        for path, upto in end.items():
            begin = start.get(path, 0)
            if upto < begin:
                raise ValueError(f"{path} has become shorter: a log only grows, a rotated one takes a new name")
            cuts = [*range(begin, upto, RANGE_BYTES), upto]
            ranges += [LineRange(path, a, b, a == begin) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return ranges

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.uri)
        stop = whole_lines(store, partition.path, store.get_file_info(partition.path).size, partition.end)
        rows: list[list[str | None]] = []
        lines = lines_of(partition, store, stop)
        if self.header and partition.begin == 0:
            next(lines, None)
        for line in lines:
            text = line.rstrip(b"\r").decode("utf-8", "replace")
            fields = next(csv.reader([text], delimiter=self.separator), []) if '"' in text else text.split(self.separator)
            if len(fields) == len(self.names):
                rows.append([field or None for field in fields])
            if len(rows) == BATCH_LINES:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=self.names)


class GrowingLog(DataSource):
    """``format("growing-log")``: fields of a line are text, an empty one is null, lines of another width are skipped."""

    @classmethod
    def name(cls) -> str:
        return "growing-log"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GrowingLines(schema, self.options)


def follow_lines(
    spark: SparkSession, path: str, schema: str, header: bool = False, separator: str = ","
) -> DataFrame:
    """The lines of a file, or of all files of a folder, as text columns, while they are appended to.

    Each whole line arrives once, also after a restart from the checkpoint. A file is known by its name and only
    grows; names that begin with a dot or an underscore are left out. Lines without as many fields as ``schema`` are
    skipped, quotes may hold separators but no line ends. All files that were ever seen stay in the offset, so
    old files belong into another folder once they are read.
    """
    spark.dataSource.register(GrowingLog)
    return (
        spark.readStream.format("growing-log").schema(schema).option("header", header).option("separator", separator)
        .load(path)
    )
