import re

import pytest

from threatlens.llm import common, exact_dedup

SCHEMA = "doc_id long, text string, kept string, _ID int, _digest int"
LONG = "x" * 64
ROWS = [
    (1, "a  b", "p", 1, 1), (2, "a\tb", "q", 1, 1), (3, "a b ", "r", 1, 1), (4, None, "s", 1, 1), (5, "", "t", 1, 1),
    (6, " ", "u", 1, 1), (7, "\n\n", "v", 1, 1), (9, "z", "w", 1, 1), (9, "z", "w2", 2, 1), (None, "z", "x", 1, 1),
    (None, "only", "y", 1, 1), (10, LONG + "1", "", 1, 1), (11, LONG + "2", "", 1, 1), (12, LONG + "1", "", 1, 1),
    (13, "w " * 100_000, "", 1, 1), (14, "w \n" * 100_000, "", 1, 1), (9, "another text", "", 0, 0), (15, "a\xa0b", "", 0, 0),
]


def brute(rows):
    def norm(text):
        return re.sub("[\x20\x09-\x0d]+", " ", text or "")
    out = set()
    for key, text, *_ in rows:
        same = [r[0] for r in rows if norm(r[1]) == norm(text)]
        ids = [i for i in same if i is not None]
        keep = min(ids) if ids else None
        out.add((key, keep, len(same), key == keep))
    return out


@pytest.mark.parametrize("digest_all", [True, False])
def test_verdicts(spark, digest_all):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = exact_dedup.exact_dedup(docs, digest_all=digest_all).collect()
    want = brute(ROWS)
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got}
    assert found == want if digest_all else found <= want
    assert {w for w in want if w[2] > 1} <= found
    assert len(got) == len({(r.doc_id, r.text_sha256) for r in got})


@pytest.mark.parametrize("rows_sent", [1 << 19, 0])
def test_rows_that_stay(spark, monkeypatch, rows_sent):
    monkeypatch.setattr(common, "SENT_ROWS", rows_sent)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    got = [(r.doc_id, re.sub("[\x20\x09-\x0d]+", " ", r.text or "")) for r in left.collect()]
    assert len(got) == len(set(got))
    assert {i for i, _ in got} == {1, 3, 4, 6, 9, 10, 11, 13, 15, None}
    assert (None, "only") in got and (None, "z") not in got
    assert exact_dedup.drop_copies(docs.filter("doc_id in (1, 3)")).count() == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
