"""Deterministic sharded WARC archives: written from a table of pages, and read back."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, fresh_folder, open_store, settle, with_offsets

#: One date for all records, so that equal input gives equal bytes.
DATE = "2020-01-01T00:00:00Z"
#: Compressed bytes after which a new file begins.
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MEMBER = pa.schema([
    ("page_id", pa.int64()), ("tie", pa.string()), ("size", pa.int64()), ("part", pa.int32()),
    ("start_in_part", pa.int64()), ("member", pa.binary()),
])
_SHARD = pa.schema([
    ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()),
    ("first_id", pa.int64()), ("last_id", pa.int64()),
])
_RECORD = pa.schema([
    ("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
    ("block_ok", pa.bool_()), ("payload", pa.binary()),
])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, tie: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{tie}').urn}>"


def _record(page_id, url, payload: bytes, tie: str, winner, date: str) -> bytes:
    """Headers and block of one record; a revisit keeps the payload's digest and length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if winner is None else b"")
    fields = [
        ("WARC-Type", "response" if winner is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, tie)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url is not None else None),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Page-Id", page_id),
        ("WARC-Profile", PROFILE if winner is not None else None),
        ("WARC-Refers-To", _record_id(winner, tie) if winner is not None else None),
        ("X-Refers-To-Page-Id", winner),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _compress(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "sha", "winner")]
            for page_id, url, payload, sha, winner in zip(*columns, strict=True):
                page_id, url, payload = page_id.as_py(), url.as_py(), payload.as_py()
                tie = sha.as_py()
                member = _member(_record(page_id, url, payload, tie, winner.as_py(), date))
                rows.append((page_id, f"{tie}/{url or ''}", len(member), part, start, member))
                start, held = start + len(member), held + len(member)
                if held > BATCH_BYTES:
                    yield pa.record_batch([*zip(*rows, strict=True)], schema=_MEMBER)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([*zip(*rows, strict=True)], schema=_MEMBER)

    return run


def _info(name: str, date: str) -> bytes:
    body = b"software: threatlens\r\nformat: WARC File Format 1.1\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(name, 'info')}\r\nWARC-Date: {date}\r\n"
        f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return _member(head.encode() + body + b"\r\n\r\n")


def _write_shards(folder: str, date: str):
    """Rows come sorted by file; a file is written under a temporary name and renamed when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out = name = None
        stats: list = []

        def close():
            out.close()
            target = f"{root}/{name}"
            try:
                store.move(f"{target}.{attempt}.tmp", target)
            except OSError:  # an earlier attempt left the same bytes, on a store that does not overwrite
                store.delete_file(target)
                store.move(f"{target}.{attempt}.tmp", target)
            rows = [name, stats[0], stats[1], stats[2].hexdigest(), stats[3], stats[4]]
            return pa.record_batch([[x] for x in rows], schema=_SHARD)

        for batch in batches:
            for number, page_id, member in zip(*(batch.column(c) for c in ("file_no", "page_id", "member")), strict=True):
                if name != (wanted := f"pages-{number.as_py():08d}.warc.gz"):
                    if out is not None:
                        yield close()
                    name, attempt = wanted, uuid.uuid4().hex
                    out = store.open_output_stream(f"{root}/{name}.{attempt}.tmp", compression=None)
                    info = _info(name, date)
                    out.write(info)
                    stats = [0, len(info), hashlib.sha256(info), page_id.as_py(), None]
                data = member.as_py()
                out.write(data)
                stats[2].update(data)
                stats[0], stats[1], stats[4] = stats[0] + 1, stats[1] + len(data), page_id.as_py()
        if out is not None:
            yield close()

    return run


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = DATE,
) -> DataFrame:
    """Writes one WARC record per row into gzip files below ``folder``; returns the manifest.

    Records are sorted by (id, payload digest, url), nulls first. A file begins at each multiple of
    ``file_bytes`` of the compressed records before it, so names, borders and bytes depend on the rows only,
    not on partitions or retries. Files get their names when they are whole; the manifest, written last, is
    the commit: a reader looks at no file that it does not list.

    Of equal payloads of at least ``min_bytes`` bytes the row with the largest id is a response and the others
    revisit it; smaller ones are all responses. A null payload is empty, a null url has no target line, a null
    id is smaller than any other. Rows that repeat the largest id and the payload are all responses. Other
    columns are not looked at. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("sha"),
    )
    groups = (
        rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    )
    groups = settle(groups.select("sha", "largest"), "warc-groups")
    winner = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("winner")
    records = rows.join(groups, "sha", "left").select("page_id", "url", "payload", "sha", winner)
    order = [F.col("page_id").asc_nulls_first(), "sha", F.col("url").asc_nulls_first()]
    members = records.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _compress(date), "page_id long, tie string, size long, part int, start_in_part long, member binary"
    )
    members = settle(members, "warc-members")
    placed = with_offsets(members, "part", "size", "start_in_part", "start")
    placed = placed.withColumn("file_no", F.floor(F.col("start") / file_bytes).cast("long"))
    open_store(folder)[0].create_dir(open_store(folder)[1], recursive=True)
    shards = (
        placed.select("file_no", "start", "page_id", "member").repartition("file_no")
        .sortWithinPartitions("file_no", "start")
        .mapInArrow(
            _write_shards(folder, date),
            "file string, records long, bytes long, sha256 string, first_id long, last_id long",
        )
    )
    shards.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _records(stream, name: str) -> Iterator[bytes]:
    """The uncompressed records of a file, one gzip member at a time."""
    unzip, data, parts = zlib.decompressobj(31), b"", []
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            if parts:
                raise ValueError(f"{name} ends within a record")
            return
        parts.append(unzip.decompress(data))
        data = unzip.unused_data
        if unzip.eof:
            yield b"".join(parts)
            unzip, parts = zlib.decompressobj(31), []


def parse_record(data: bytes) -> dict:
    """Header fields of a record, lower-cased, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields | {"block": rest[: int(fields["content-length"])]}


def _read_files(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        rows, held = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _records(stream, name):
                        record = parse_record(data)
                        if record["warc-type"] not in ("response", "revisit"):
                            continue
                        block = record["block"]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        whole = record["warc-type"] == "response"
                        stated = record["warc-payload-digest"].removeprefix("sha1:")
                        length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))[15:])
                        page, refers = record.get("x-page-id"), record.get("x-refers-to-page-id")
                        rows.append((
                            name, page and int(page), record.get("warc-target-uri"), record["warc-type"],
                            base32_sha1(payload) if whole else stated, len(payload) if whole else length,
                            refers and int(refers), record["warc-block-digest"] == f"sha1:{base32_sha1(block)}",
                            payload if whole and with_payload else None,
                        ))
                        held += len(payload) if with_payload else 100
                        if held > BATCH_BYTES:
                            yield pa.record_batch([*zip(*rows, strict=True)], schema=_RECORD)
                            rows, held = [], 0
        if rows:
            yield pa.record_batch([*zip(*rows, strict=True)], schema=_RECORD)

    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Response and revisit records of the archives that the manifest of ``folder`` lists.

    ``payload_digest`` of a response is computed from what was read; a revisit states that of its full payload.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.select("file")
    files = files.repartition(max(1, files.count()))  # a stated number: one file per task, however short the names
    return files.mapInArrow(
        _read_files(folder, with_payload),
        "file string, page_id long, url string, record_type string, payload_digest string, payload_bytes long,"
        " refers_to long, block_ok boolean, payload binary",
    )


def round_trip(pages: DataFrame, file_bytes: int = FILE_BYTES, min_bytes: int = 0) -> DataFrame:
    """Archives in a new shared folder, read back without payloads."""
    folder = fresh_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, min_bytes=min_bytes, file_bytes=file_bytes)
    return read_warc(pages.sparkSession, folder, with_payload=False)
