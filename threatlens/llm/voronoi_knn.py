"""Exact top-k search by inner product as a Voronoi join: pivots, cell summaries, bounds, local solutions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Pivots at most (as many as the square root of the rows below that), the rows that they are fitted on at most,
#: and rounds of that.
PIVOTS, FIT_ROWS, FIT_ROUNDS = 1024, 16384, 8
#: Rows of a cell that one task holds; larger cells are dealt into slices.
SLICE = 8192
#: Scores that a task looks at at once.
SCORES = 1 << 22
#: Slack of angles for rounding, in radians.
TURN = 1e-6
#: Relative slack of bounds for rounding.
SLACK = 1e-9


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ListArray, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), dtype=kind)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fit_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """At most ``pivots`` centres of the sample's distinct rows by a few rounds of k-means."""
    rows = np.unique(sample, axis=0)
    centres = rows[np.random.default_rng(3).permutation(len(rows))[:pivots]]
    for _ in range(FIT_ROUNDS if len(rows) > pivots else 0):
        near = _nearest(rows, centres)
        used, at = np.unique(near, return_inverse=True)
        sums = np.zeros((len(used), rows.shape[1]))
        np.add.at(sums, at, rows)
        centres = sums / np.bincount(at)[:, None]
    return centres


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Number of each row's nearest pivot."""
    half = (pivots**2).sum(axis=1) / 2
    step = max(1, SCORES // len(pivots))
    parts = [(half - rows[at : at + step] @ pivots.T).argmin(axis=1) for at in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _angles(dots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Angles from products and the products of lengths; a half turn where a length is zero."""
    return np.arccos(np.clip(np.divide(dots, sizes, out=np.full_like(dots, -1.0), where=sizes > 0), -1, 1))


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = _matrix(batch.column("v"), pivots.shape[1])
            cell = _nearest(rows, pivots)
            own, size = pivots[cell], np.linalg.norm(rows, axis=1)
            turn = _angles((rows * own).sum(axis=1), size * np.linalg.norm(own, axis=1))
            measures = [np.linalg.norm(rows - own, axis=1), size, turn]
            yield pa.record_batch(
                [*batch.columns, pa.array(cell.astype(np.int32)), *map(pa.array, measures)],
                names=["id", "v", "asks", "cell", "far", "size", "turn"],
            )

    return run


@dataclass
class Summary:
    """Per cell: pivot, rows, largest distance from the pivot, shortest and longest row, largest angle to the pivot."""

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    turn: np.ndarray

    def reached(self, lows: np.ndarray, k: int) -> np.ndarray:
        """A score that k + 1 rows reach, per row of ``lows`` (lower bounds of the cells' scores)."""
        order = np.argsort(-lows, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) > k
        best = np.take_along_axis(lows, np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
        return np.where(enough.any(axis=1), best, -np.inf)

    def groups(self, k: int) -> np.ndarray:
        """Whether a cell may hold an answer to some query of another, for all pairs of cells."""
        norms, r = np.linalg.norm(self.pivots, axis=1), self.radius
        dots = self.pivots @ self.pivots.T
        reach = r[:, None] * norms[None] + (norms + r)[:, None] * r[None]
        return (dots + reach >= (self.reached(dots - reach, k))[:, None] - SLACK * (1 + np.abs(dots) + reach)) & (self.rows > 0)

    def bounds(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the scores in each cell, and a score that k rows other than the query reach.

        With p a cell's pivot and r its radius, a score is at most <q, p> + |q| r; it is also at most |q| |d| times
        the cosine of the least angle between q and a row d of the cell.
        """
        size, norms = np.linalg.norm(queries, axis=1)[:, None], np.linalg.norm(self.pivots, axis=1)
        dots = queries @ self.pivots.T
        slack = SLACK * (1 + size * (norms + self.radius + self.longest))
        cosine = np.cos(np.maximum(_angles(dots, size * norms) - self.turn - TURN, 0))
        by_angle = size * cosine * np.where(cosine >= 0, self.longest, self.shortest)
        high = np.minimum(dots + size * self.radius, np.where(norms > 0, by_angle, np.inf))
        low = self.reached(dots - size * self.radius, k)
        return high + slack, low - slack.max(axis=1)


def _needed(summary: Summary, k: int):
    """Cells but the query's own that may hold one of its k best.

    ``least``, the score of the k-th best of the query's own cell, and what the summaries promise are reached by k
    rows; a cell whose upper bound is below that is left out. Queries of a cell are bounded as one group first.
    """
    for_group = summary.groups(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES // 8 // len(summary.pivots))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows = _matrix(batch.column("v"), summary.pivots.shape[1])
                home = batch.column("cell").to_numpy()
                high, low = summary.bounds(rows, k)
                least = np.maximum(batch.column("least").to_numpy(), low)
                wanted = for_group[home] & (high >= least[:, None])
                wanted[np.arange(len(home)), home] = False
                q, cell = np.nonzero(wanted)
                picked = batch.take(pa.array(q))
                yield pa.record_batch(
                    [picked.column("id"), picked.column("v"), pa.array(cell.astype(np.int32)), pa.array(least[q])],
                    names=["id", "v", "cell", "least"],
                )

    return run


def best_of(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int):
    """(query row, data row, score) of each query's k best in a slice, ties to the smaller id."""
    largest = max(np.abs(data).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * max(data.shape[1], 1)
    if float(largest) < 2.0**53:  # then products and sums of doubles are exact integers
        scores = (queries.astype(np.float64) @ data.astype(np.float64).T)
    else:
        scores = queries @ data.T
    low = -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min
    allowed = (own[:, None] != ids[None]) & (scores >= least[:, None])
    masked = np.where(allowed, scores, low)
    if masked.shape[1] > k:
        allowed &= masked >= np.partition(masked, -k, axis=1)[:, [-k]]
    q, d = np.nonzero(allowed)
    order = np.lexsort((ids[d], -scores[q, d], q))
    q, d = q[order], d[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    chosen = np.arange(len(q)) - first[q] < k
    q, d = q[chosen], d[chosen]
    return q, d, scores[q, d].astype(np.int64)


def _solve(dim: int, k: int):
    """Rows come sorted by (cell, slice), data before queries; a slice's data stay while its queries pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, data, ids = None, [], None, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("cell", "slice", "kind")], axis=1)
            if len(place) == 0:
                continue
            edges = np.flatnonzero(np.any(np.diff(place, axis=0, prepend=place[:1] - 1) != 0, axis=1))
            for a, b in zip(edges, [*edges[1:], len(place)], strict=True):
                cell, piece, kind = place[a]
                rows = batch.slice(a, b - a)
                if (cell, piece) != held:
                    held, parts, data = (cell, piece), [], None
                if kind == 0:
                    parts.append((rows.column("id").to_numpy(), _matrix(rows.column("v"), dim, np.int64)))
                    continue
                if data is None:
                    if not parts:
                        continue
                    ids, data = (np.concatenate(x) for x in zip(*parts, strict=True))
                step = max(1, SCORES // len(ids))
                for at in range(0, len(rows), step):
                    asked = rows.slice(at, step)
                    own, least = asked.column("id").to_numpy(), asked.column("least").to_numpy()
                    q, d, score = best_of(data, ids, _matrix(asked.column("v"), dim, np.int64), own, least, k)
                    yield pa.record_batch(
                        [pa.array(own[q]), pa.array(ids[d]), pa.array(score)], names=["query_id", "vec_id", "score"]
                    )

    return run


def _local(placed: DataFrame, asked: DataFrame, slices: DataFrame, dim: int, k: int) -> DataFrame:
    """The k best of each asked (query, cell) in each slice of the cell that reach the query's ``least``."""
    asked = asked.join(slices, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("kind"),
        "id", "v", "least",
    )
    held = placed.join(slices, "cell").select(
        "cell", F.pmod(F.xxhash64("id"), "slices").alias("slice"), F.lit(0).alias("kind"), "id", "v",
        F.lit(0.0).alias("least"),
    )
    dealt = held.unionByName(asked).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "kind")
    return dealt.mapInArrow(_solve(dim, k), "query_id long, vec_id long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


@dataclass
class Cells:
    """Stored rows with their cells, the cells' summary and numbers of slices (one row per cell), and the dimension."""

    placed: DataFrame
    summary: Summary
    slices: DataFrame
    dim: int


def cells(data: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> Cells:
    """Fits pivots and deals all rows to the cell of their nearest pivot; see ``top_k``."""
    spark = data.sparkSession
    rows = data.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), asks.alias("asks"))
    rows = rows.filter("id is not null and v is not null")
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    seen = rows.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("rows")).first()
    dim, count = max(seen["dim"] or 0, 1), seen["rows"]
    share = int(2**62 * min(1.0, 1.25 * FIT_ROWS / max(count, 1)))  # so that tasks send about the bound in all
    few = rows.filter(F.xxhash64("id").bitwiseAND((1 << 62) - 1) <= share)
    sample = few.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect()
    padded = np.zeros((len(sample), dim))
    for at, row in enumerate(sample):
        padded[at, : len(row["v"])] = row["v"]
    pivots = fit_pivots(padded, min(PIVOTS, math.isqrt(count) + 1)) if len(sample) else np.zeros((1, dim))
    kind = "id long, v array<long>, asks boolean, cell int, far double, size double, turn double"
    placed = settle(rows.mapInArrow(_assign(pivots), kind), "cells")
    whole = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius"), F.min("size").alias("shortest"),
        F.max("size").alias("longest"), F.max("turn").alias("turn"),
    ).collect()
    measures = {name: np.zeros(len(pivots)) for name in ("rows", "radius", "shortest", "longest", "turn")}
    for row in whole:
        for name, values in measures.items():
            values[row["cell"]] = row[name]
    slices = spark.createDataFrame([(r["cell"], -(-r["rows"] // SLICE)) for r in whole], "cell int, slices long")
    return Cells(placed, Summary(pivots, **measures), F.broadcast(slices), dim)


def home_hits(found: Cells, k: int) -> DataFrame:
    """First round, stored: each query's k best in every slice of its own cell."""
    asked = found.placed.filter("asks").select("id", "v", "cell", F.lit(float("-inf")).alias("least"))
    homes = F.broadcast(asked.select("cell").distinct())  # at most one row per pivot
    held = found.placed.join(homes, "cell", "left_semi")
    return settle(_local(held, asked, found.slices, found.dim, k), "home-hits")


def needed(found: Cells, home: DataFrame, k: int) -> DataFrame:
    """Second round, stored: (id, v, cell, least) for each further cell that may hold an answer to a query."""
    last = _ranked(home, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("last"))
    slack = F.col("last") - F.abs("last") * SLACK
    asked = found.placed.filter("asks").select("id", "v", "cell").join(last, "id", "left").select(
        "id", "v", "cell", F.coalesce(slack, F.lit(float("-inf"))).alias("least")
    )
    return settle(asked.mapInArrow(_needed(found.summary, k), "id long, v array<long>, cell int, least double"), "needed-cells")


def top_k(data: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``asks`` holds, the k other rows of the largest integer
    inner product, ties to the smaller id; fewer where there are fewer.

    Rows belong to the cell of their nearest pivot; there are about as many pivots as the square root of the rows,
    PIVOTS at most. Each query is answered in its own cell first. Its k-th best score there, and what the cells'
    summaries (rows, radius, lengths, largest angle) promise, bound its answers from below; it is sent only to the
    cells whose upper bound reaches that, and only rows of such cells are exchanged again. A cell is dealt into
    slices of about SLICE rows, so a very common vector is spread, and a task holds one slice. Only pivots and
    summaries reach the driver: a row of each per pivot, and FIT_ROWS rows that pivots are fitted on.

    The result is exact whatever the bounds leave out. That is much on vectors with clusters and nothing on
    random directions in many dimensions, where the work is that of queries times rows.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without id. Shorter
    vectors count as padded with zeros. Of rows that repeat an id the one with the smallest vector takes part.
    Scores must fit 63 bits. Other columns are not looked at. An empty table, or no query, gives no rows.
    """
    found = cells(data, asks, id_col, vector_col)
    home = home_hits(found, k)
    asked = needed(found, home, k)
    wanted = F.broadcast(asked.select("cell").distinct())  # at most one row per pivot
    held = found.placed.join(wanted, "cell", "left_semi")
    return _ranked(home.unionByName(_local(held, asked, found.slices, found.dim, k)), k)
