import duckdb
import pytest

import corpus_pipeline
from threatlens.llm.queries import ORACLES, QUERIES

from .test_lsh_forest import brute
from .test_tokens import check_packed

PATH = "/root/testdata/sf0.001"


def rows_of(df):
    names = sorted(df.columns)
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{PATH}/{table}.parquet')")
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted([tuple(r[i] for i in order) for r in found.fetchall()], key=str)
    got = QUERIES[name](spark, PATH)
    assert sorted(got.columns) == sorted(names) and rows_of(got) == want


def test_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == [*range(1, 14)]


def test_stages(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    (_, classify), (_, exact), (_, near), (_, pack) = corpus_pipeline.STAGES
    good = classify(spark, docs, PATH).cache()
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert good.schema == docs.schema and sum(i in kept for i in clean) > 0.97 * len(clean)
    once = exact(spark, docs, PATH).cache()
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(" ".join(r.text.split()) if r.text else "", r.doc_id)
    assert once.schema == docs.schema and {r.doc_id for r in once.collect()} == set(first.values())
    apart = near(spark, docs, PATH).cache()
    classes = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert apart.schema == docs.schema and {r.doc_id for r in apart.collect()} == {c for c, _, _ in classes.values()}
    pieces = pack(spark, apart, PATH).collect()
    check_packed(pieces, 1024)
    assert {p.doc_id for p in pieces} == {r.doc_id for r in apart.collect()}


def test_run(spark):
    pieces = corpus_pipeline.run(spark, PATH).collect()
    check_packed(pieces, 1024)
    totals = {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(p.length for p in pieces) == sum(totals.values())
