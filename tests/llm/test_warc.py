import gzip
import hashlib
import os

from threatlens.llm import warc
from threatlens.session import fresh_folder

SCHEMA = "page_id long, url string, html string, sha string, winner int"
ROWS = [
    (1, "http://a/b c\r\nX: y", "same", "", 0), (2, None, "same", "", 0), (3, "http://é", "same", "", 0),
    (4, "http://x", "", "", 0), (5, "http://x", None, "", 0), (6, "http://x", "line\r\n\r\nend" * 5000, "", 0),
    (7, "u", "7", "", 0), (7, "v", "7", "", 0), (None, "w", "alone", "", 0), (None, "w", "same", "", 0),
]


def write(spark, docs, **settings):
    folder = fresh_folder(spark, "warc-test")
    warc.write_warc(docs, folder, **settings)
    return folder


def files(folder):
    path = folder.removeprefix("file://")
    return {n: open(os.path.join(path, n), "rb").read() for n in sorted(os.listdir(path)) if n.endswith(".gz")}


def test_round_trip(spark):
    folder = write(spark, spark.createDataFrame(ROWS, SCHEMA).repartition(4))
    got = sorted(warc.read_warc(spark, folder).collect(), key=lambda r: (r.page_id or 0, r.url or ""))
    assert len(got) == len(ROWS) and all(r.block_ok for r in got)
    for r in got:
        payload = next(x[2] or "" for x in ROWS if x[0] == r.page_id and (r.page_id or x[2] == ("alone" if r.record_type == "response" else "same")))
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warc.base32_sha1(payload.encode()))
        if r.record_type == "response":
            assert r.payload.decode() == payload and r.refers_to is None
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in got]
    assert kinds[:2] == [(None, "response", None), (None, "revisit", 3)] or kinds[:2] == [(None, "revisit", 3), (None, "response", None)]
    assert kinds[2:] == [
        (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "revisit", 5), (5, "response", None),
        (6, "response", None), (7, "response", None), (7, "response", None),
    ]


def test_short_payloads_are_all_responses(spark):
    folder = write(spark, spark.createDataFrame(ROWS, SCHEMA), min_bytes=5)
    assert {r.record_type for r in warc.read_warc(spark, folder).collect()} == {"response"}


def test_bytes_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"http://h/{i}", f"text {i % 40} " * 50) for i in range(300)], "page_id long, url string, html string")
    one = files(write(spark, docs.repartition(1), file_bytes=4096))
    many = files(write(spark, docs.repartition(7, "url"), file_bytes=4096))
    assert one == many and len(one) > 3
    assert all(gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for data in one.values())


def test_manifest_is_the_commit(spark):
    folder = write(spark, spark.createDataFrame(ROWS, SCHEMA))
    stored = files(folder)
    manifest = {r.file: r for r in spark.read.parquet(f"{folder}/manifest").collect()}
    assert set(stored) == set(manifest)
    for name, data in stored.items():
        assert (len(data), hashlib.sha256(data).hexdigest()) == (manifest[name].bytes, manifest[name].sha256)
    with open(os.path.join(folder.removeprefix("file://"), "pages-99999999.warc.gz"), "wb") as stray:
        stray.write(b"not listed")
    assert warc.read_warc(spark, folder).count() == len(ROWS)


def test_empty_table(spark):
    folder = write(spark, spark.createDataFrame([], SCHEMA))
    assert warc.read_warc(spark, folder).count() == 0
