import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlens.llm import voronoi_knn

SCHEMA = "vec_id long, embedding array<double>, cell int, rank string, score string"


def brute(rows, every, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(1024 * x) for x in v]
            best[i] = min(best.get(i, q), q)
    out = set()
    for i in [i for i in best if i % every == 0]:
        scored = sorted((-sum(a * b for a, b in zip(best[i], v, strict=False)), j) for j, v in best.items() if j != i)
        out |= {(i, at + 1, j, -s) for at, (s, j) in enumerate(scored[:k])}
    return out


def run(spark, rows, every, k):
    docs = spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA).repartition(5)
    return {tuple(r) for r in voronoi_knn.top_k(docs, F.col("vec_id") % every == 0, k).collect()}


@pytest.mark.parametrize("slice_rows", [8192, 16])
def test_against_all_pairs(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(voronoi_knn, "SLICE", slice_rows)
    monkeypatch.setattr(voronoi_knn, "PIVOTS", 9)
    draw = np.random.default_rng(1)
    centres = draw.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + draw.normal(0, 0.1, 8)).tolist()) for i in range(400)]
    rows += [(400 + i, [0.25] * 8) for i in range(200)]  # a very common vector
    assert run(spark, rows, 7, 10) == brute(rows, 7, 10)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0]),
        (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (8, [0.5, 2.0, 3.0]), (None, [1.0, 2.0]), (10, [1e9, -1e9]), (20, [-1e9, 3.0]),
    ]
    assert run(spark, rows, 10, 4) == brute(rows, 10, 4)
    assert run(spark, rows[:1], 10, 4) == set()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert voronoi_knn.top_k(docs, F.col("vec_id") % 10 == 0).count() == 0


def clustered(count, clusters, dim=16):
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 1, (clusters, dim))
    return [(i, (centres[i % clusters] + draw.normal(0, 0.02, dim)).tolist()) for i in range(count)]


def test_cells_are_left_out(spark):
    """On clear clusters a query is sent to few of the cells, and answers stay exact."""
    rows = clustered(1600, 20)
    assert run(spark, rows, 50, 10) == brute(rows, 50, 10)
    docs = spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA).repartition(5)
    found = voronoi_knn.cells(docs, F.col("vec_id") % 50 == 0)
    asked = voronoi_knn.needed(found, voronoi_knn.home_hits(found, 10), 10)
    pairs = 32 * found.slices.count()
    assert asked.count() + 32 < 0.3 * pairs


def test_lengths_and_small_cells(spark):
    """Vectors of very different lengths, zero vectors, and cells with fewer rows than are asked for."""
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(0, 1, 4) * 10.0 ** draw.integers(-3, 3)).tolist()) for i in range(300)]
    rows += [(300 + i, [0.0] * 4) for i in range(30)]
    assert run(spark, rows, 3, 10) == brute(rows, 3, 10)


def test_bounds_hold():
    draw = np.random.default_rng(6)
    rows = draw.normal(0, 100, (500, 6)) * draw.choice([0, 1, 30], (500, 1))
    pivots = voronoi_knn.fit_pivots(rows[:200], 20)
    cell = voronoi_knn._nearest(rows, pivots)
    size, own = np.linalg.norm(rows, axis=1), pivots[cell]
    turn = voronoi_knn._angles((rows * own).sum(axis=1), size * np.linalg.norm(own, axis=1))
    far = np.linalg.norm(rows - own, axis=1)

    def per_cell(values, how):
        return np.array([how(values[cell == c]) if (cell == c).any() else 0.0 for c in range(len(pivots))])

    summary = voronoi_knn.Summary(
        pivots, np.bincount(cell, minlength=len(pivots)), per_cell(far, np.max), per_cell(size, np.min),
        per_cell(size, np.max), per_cell(turn, np.max),
    )
    scores = rows @ rows.T
    high, low = summary.bounds(rows, 10)
    assert (scores <= high[:, cell]).all()
    assert (np.sort(scores, axis=1)[:, -11] >= low).all()
    groups = summary.groups(10)
    for q in range(500):
        best = np.argsort(-scores[q])[:10]
        assert groups[cell[q], cell[best]].all()
