import random

import numpy as np
import pytest

from threatlens.llm import common, lsh_forest
from threatlens.llm.components import components

SCHEMA = "doc_id long, text string, node long, class_id string, label int"


def shingles(text):
    words = (text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute(rows, threshold=0.8):
    """doc_id to (class_id, n_links, copy_of) by comparing all pairs."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    linked = {i: {j for j, b in sets.items() if j != i and a and b and len(a & b) >= threshold * len(a | b)} for i, a in sets.items()}
    name = {}
    for i in sorted(sets):
        if i not in name:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in name:
                    name[j] = i
                    stack += linked[j]
    return {i: (name[i], len(linked[i]), min([j for j in linked[i] if sets[j] == s] + [i])) for i, s in sets.items()}


def near_rows(seed=5, groups=6, most=30):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(40, 160))]
        for _ in range(draw.randrange(1, most)):
            words = list(base)
            for _ in range(draw.randrange(0, 4)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(words), 1, "", 0))
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK", block)  # small blocks: components go by trie node and by grid
    rows = near_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links, r.copy_of) for r in lsh_forest.jaccard_join(docs).collect()}
    assert got == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.class_id, r.n_links, r.copy_of) for r in lsh_forest.jaccard_join(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "SENT_ROWS", 0)  # the way beyond the broadcast
    long = "one two three four five six seven " * 20_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a  b"), (6, "a b c"), (7, long), (8, long + " end"), (9, "q r s t u v"), (9, "q r s t u v")]
    docs = spark.createDataFrame([(i, t, 1, "", 0) for i, t in rows] + [(None, "a b", 1, "", 0)], SCHEMA)
    got = lsh_forest.jaccard_join(docs).collect()
    want = brute(rows)
    assert {r.doc_id: (r.class_id, r.n_links, r.copy_of) for r in got if r.doc_id is not None} == want
    assert len(got) == len(want) + 1
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    left = lsh_forest.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 9, 9, None], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lsh_forest.jaccard_join(empty).count() == 0
    assert lsh_forest.drop_near_copies(empty).count() == 0


def test_depths_reach_the_recall():
    assert lsh_forest.chance(lsh_forest.THRESHOLD, lsh_forest.SHORTEST) > 0.9999
    assert lsh_forest.LABEL >= lsh_forest.LONGEST


def test_overlaps():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 300, draw.integers(1, 200)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert lsh_forest.overlaps(sets[:5], sets[5:]).tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 95: 90, **dict.fromkeys(range(200, 230), 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_at_the_threshold_do_not_depend_on_other_links(spark):
    """Pairs at 0.8 beside a group whose many closer links used to fill the estimate of the recall."""
    middle = [[f"p{k}w{i}" for i in range(20)] for k in range(2500)]
    rows = [(2 * k + side, " ".join([f"a{side}", *words, f"z{side}"])) for k, words in enumerate(middle) for side in (0, 1)]
    base = [f"g{i}" for i in range(400)]
    rows += [(10_000 + k, " ".join([f"x{k}", *base])) for k in range(120)]
    docs = spark.createDataFrame([(i, t, 1, "", 0) for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in lsh_forest.jaccard_join(docs).collect()}
    assert [i for i in range(5000) if got[i] != (i - i % 2, 1)] == []
    assert all(got[10_000 + k] == (10_000, 119) for k in range(120))


def test_depth_follows_the_threshold():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        depth = lsh_forest.depth_for(threshold, lsh_forest.RECALL)
        assert lsh_forest.chance(threshold, depth) >= lsh_forest.RECALL
    assert lsh_forest.chance(lsh_forest.THRESHOLD, lsh_forest.depth_for(lsh_forest.THRESHOLD, lsh_forest.RECALL)) > 1 - 1e-7
