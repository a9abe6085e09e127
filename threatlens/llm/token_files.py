"""Token ids as Parquet list columns, written in document order and read back selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_column, with_offsets
from .words import encoder

#: The writer's layout: dictionary pages where ids repeat, row groups and pages of a fixed size, page indexes
#: with checksums, zstd.
LAYOUT = {
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.columnindex.truncate.length": "64",
    "parquet.page.write-checksum.enabled": "true",
    "compression": "zstd",
}
#: Words kept in a worker's memory (twice, see ``words``) and bytes of text cut at once: a word that is not kept costs
#: a call of the library, some 10 microseconds, and nothing else in a task needs as much.
MEMORY = 400_000
CUT_BYTES = 4 << 20
COLUMNS = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, end = TaskContext.get().partitionId(), 0, np.int32(end_id).tobytes()
        words = encoder(path, MEMORY)
        for batch in batches:
            keys = batch.column(id_col)
            for first, lengths, ids in words.encode(batch.column(text_col), CUT_BYTES):
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                rows = [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                starts = start + bounds[:-1] + np.arange(len(rows))
                start += int(bounds[-1]) + len(rows)
                yield pa.record_batch(
                    [
                        keys.slice(first, len(rows)), pa.array(np.full(len(rows), part, dtype=np.int32)),
                        pa.array(starts), pa.array(lengths + 1), list_column(rows),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    layout: dict[str, str] | None = None,
) -> None:
    """Encodes whole texts and writes (doc_id, n_tokens, ids, place) in ascending id order below ``folder``.

    The documents are dealt to range partitions by id and sorted there; each partition becomes one file whose
    number follows the order. A document's place is its partition and the ids before it in that partition, so
    no pass over the ids is needed to know where it starts. Spark's committer gives files their final names.

    A null text is empty and gives the end id alone; null ids come first; rows that repeat an id are ordered by
    text and each keeps its own row. Very long texts are encoded whole. Other columns are not written. An empty
    table gives an empty folder that can be read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    tokens = ordered.mapInArrow(_encode(tokenizer_path, end_id, "doc_id", "text"), COLUMNS)
    tokens.write.options(**(LAYOUT | (layout or {}))).parquet(folder)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens and start (ids of all documents before it); the ids column is not read."""
    stored = spark.read.schema(COLUMNS).parquet(folder)
    return with_offsets(stored.drop("ids"), "part", "n_tokens", "start_in_part", "start").select(
        "doc_id", "start", "n_tokens"
    )


def read_tokens(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; a condition on doc_id is answered from row-group and page indexes."""
    stored = spark.read.schema(COLUMNS).parquet(folder)
    offsets_from = stored.select("part", "n_tokens")
    wanted = stored if where is None else stored.filter(where)
    return with_offsets(wanted, "part", "n_tokens", "start_in_part", "start", offsets_from).select(
        "doc_id", "start", "n_tokens", "ids"
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, bounds = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.record_batch(
            [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
    return tokens.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
