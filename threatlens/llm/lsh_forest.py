"""Jaccard join of documents on word shingles: a MinHash LSH forest, then exact verification.

Each tree of the forest is a prefix trie over the documents' labels, a run of MinHash values. Two documents
are candidates when some tree has them below one trie node at one depth: the longest at which a pair at the
threshold is all but certain to be found, whatever else is in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent, settle, unused
from .components import components
from .tokens import slices, words

WORDS, THRESHOLD = 5, 0.8
#: Trees of the forest, hashes of a label, and bytes that a label keeps of each.
TREES, LABEL, BYTES = 35, 4, 2
#: Lengths of matched prefixes to choose from. At 0.8 the longest is taken, which misses a pair once in 10^8.
LONGEST, SHORTEST = 4, 1
#: Chance that a pair at the threshold has to be found with.
RECALL = 0.999999
#: Documents that are compared with each other at once; larger groups become a grid of blocks.
BLOCK = 512
#: Shared shingles that are compared at once.
COLUMNS = 1 << 13
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RECORD = "doc_id long, hi long, lo long, n int, label binary"
_SET = "node long, size long, label binary, shingles binary"
_FOUND = "kind int, a long, b long, w double"


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingle_sets(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles per row, their sorted hashes): five words in a row, or all words of a shorter text."""
    counts, codes = words(texts, _hash, np.uint64)
    shingles = np.maximum(counts - WORDS + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), shingles)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    at = (np.cumsum(counts) - counts)[rows] + within
    hashes = np.zeros(len(rows), dtype=np.uint64)
    for k in range(WORDS):
        has = within + k < counts[rows]
        word = codes[np.minimum(at + k, max(len(codes) - 1, 0))] if len(codes) else hashes
        hashes = np.where(has, (hashes ^ word) * _MIX + (hashes >> np.uint64(31)), hashes)
    hashes ^= hashes >> np.uint64(32)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(rows[new], minlength=len(counts)), hashes[new]


def _family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11)
    a, b = draw.integers(0, 1 << 32, (2, TREES * LABEL), dtype=np.uint64).astype(np.uint32)
    return a | np.uint32(1), b


def labels(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """TREES * LABEL MinHash values of each set, two bytes each; zeros for an empty set."""
    out = np.zeros((len(sizes), TREES * LABEL), dtype=np.uint16)
    full = np.flatnonzero(sizes)
    if len(full) == 0:
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    low = (hashes ^ (hashes >> np.uint64(29))).astype(np.uint32)
    for k, (a, b) in enumerate(zip(*_family(), strict=True)):
        least = np.minimum.reduceat(low * a + b, starts)
        out[full, k] = ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)
    return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, rows in slices(batch.column("text")):
            sizes, hashes = shingle_sets(rows)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            keys = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            key = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            label = labels(sizes, hashes)
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(first, len(rows)), pa.array(key[:, 0]), pa.array(key[:, 1]),
                    pa.array(sizes.astype(np.int32)), pa.array([x.tobytes() for x in label], pa.binary()),
                ],
                names=["doc_id", "hi", "lo", "n", "label"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, rows in slices(batch.column("text")):
            sizes, hashes = shingle_sets(rows)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            rest = batch.slice(first, len(rows))
            key = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, sets)), dtype=np.int64).reshape(-1, 2)
            speaks = (key[:, 0] == rest.column("hi").to_numpy()) & (key[:, 1] == rest.column("lo").to_numpy())
            out = pa.record_batch(
                [*(rest.column(c) for c in ("node", "size", "label")), pa.array(sets, pa.binary())],
                names=["node", "size", "label", "shingles"],
            )
            yield out.filter(pa.array(speaks))


def chance(similarity, depth: int):
    """Probability that some tree has a pair of that similarity below one node of that depth."""
    return 1 - (1 - np.asarray(similarity, dtype=float) ** depth) ** TREES


def depth_for(threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is found with that chance; the shortest if none is."""
    return next((d for d in range(LONGEST, SHORTEST, -1) if chance(threshold, d) >= recall), SHORTEST)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left and right sets."""
    sets = [*left, *right]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    times = np.diff(np.append(np.flatnonzero(new), len(flat)))
    column = np.cumsum(new) - 1
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    bounds = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        here = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1)), dtype=np.float32)
        here[owner[a:b], column[a:b] - k * COLUMNS] = 1
        out += here[: len(left)] @ here[len(left) :].T
    return out


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest place of each place's component."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, pairs.ravel(), np.repeat(low, 2))
        np.minimum.at(root, before[pairs.ravel()], np.repeat(low, 2))
        root = root[root]
        if (root == before).all():
            break
    return root


def _compare(rows: list[tuple], tree: int, cross: bool, depth: int, threshold: float) -> list[tuple]:
    """Links of one block (or of two blocks) of candidates as rows of ``_FOUND``.

    In a group of one tree, a pair that an earlier tree has together too is left to that one.
    """
    seen: dict[int, tuple] = {}
    for row in rows:
        seen.setdefault(row[0], row)
    rows = sorted(seen.values(), key=lambda r: (r[4], r[0]))
    split = sum(r[4] == 0 for r in rows) if cross else len(rows)
    left, right = rows[:split], rows[split:] if cross else rows
    if not left or not right:
        return []
    live = np.ones((len(left), len(right)), dtype=bool) if cross else np.triu(np.ones((len(rows),) * 2, dtype=bool), 1)
    if tree > 0:
        a, b = (
            np.frombuffer(b"".join(r[2] for r in side), dtype=np.uint16).reshape(-1, TREES, LABEL)[:, :tree, :depth]
            for side in (left, right)
        )
        for t in range(tree):
            alike = (a[:, None, t, 0] == b[None, :, t, 0])
            for k in range(1, depth):
                alike &= a[:, None, t, k] == b[None, :, t, k]
            live &= ~alike
    if not live.any():
        return []
    sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
    common = overlaps(sets[:split], sets[split:] if cross else sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    union = sizes[: len(left), None] + (sizes[split:] if cross else sizes)[None, :] - common
    i, j = np.nonzero(live & (common >= threshold * union - 1e-6))
    if len(i) == 0:
        return []
    nodes = np.array([r[0] for r in rows])
    weight = np.array([r[1] for r in rows], dtype=np.float64)
    pairs = np.stack([i, j + split if cross else j], axis=1)
    links = np.bincount(pairs.ravel(), weight[pairs[:, ::-1].ravel()], len(rows))
    root = _roots(len(rows), pairs)
    out = [(0, int(nodes[k]), None, float(links[k])) for k in np.flatnonzero(links)]
    return out + [(1, int(nodes[k]), int(nodes[root[k]]), 0.0) for k in np.flatnonzero(root != np.arange(len(rows)))]


def _verify(depth: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, out = None, [], []

        def finish():
            if held is not None:
                out.extend(_compare(rows, held[1], held[2] != held[3], depth, threshold))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "tree", "lo", "hi", "node", "size", "label", "shingles", "side")]
            for grp, tree, lo, hi, *row in zip(*columns, strict=True):
                if (grp, tree, lo, hi) != held:
                    finish()
                    held, rows = (grp, tree, lo, hi), []
                rows.append(row)
            if out:
                yield _table(out)
                out.clear()
        finish()
        if out:
            yield _table(out)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kind, a, b, w = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64())],
        names=["kind", "a", "b", "w"],
    )


def _grid(groups: DataFrame) -> DataFrame:
    """Adds the blocks (lo, hi) of a group's grid that a node takes part in; ``members`` counts the group."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    other = groups.select("node", "grp", "tree", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return other.select(
        "node", "grp", "tree", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )


def _groups(records: DataFrame, depth: int) -> DataFrame:
    """(node, grp, tree, members) of the groups whose members are compared with each other.

    Nodes that trie nodes connect to no more than BLOCK others form one group (tree -1). In larger components
    each trie node is a group of its own; of trie nodes with the same members the first tree's stays.
    """
    size = BYTES * LABEL
    trees = records.select("node", "label", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    prefix = F.expr(f"substring(label, tree * {size} + 1, {BYTES * depth})")
    below = settle(trees.select("node", "tree", F.xxhash64("tree", prefix).alias("grp")), "trie")
    shared = below.groupBy("grp", "tree").agg(
        F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("node")).alias("mark"),
    ).filter("least < most")
    shared = settle(shared, "trie-shared")
    crowded = settle(below.join(shared, ["grp", "tree"]), "trie-rows")
    parts = settle(components(crowded.select(F.col("node").alias("a"), F.col("least").alias("b"))), "trie-parts")
    totals = parts.groupBy("component").agg(F.count(F.lit(1)).alias("total"))
    parts = settle(parts.join(totals, "component"), "trie-sizes")
    small = parts.filter(F.col("total") <= BLOCK).select(
        "node", F.col("component").alias("grp"), F.lit(-1).alias("tree"), F.col("total").alias("members")
    )
    large = parts.filter(F.col("total") > BLOCK).select("node")
    cells = crowded.join(large, "node", "left_semi")
    first = shared.groupBy("least", "most", "members", "mark").agg(F.min("tree").alias("tree"))
    cells = cells.join(first, ["least", "most", "members", "mark", "tree"], "left_semi")
    return small.unionByName(cells.select("node", "grp", "tree", "members"))


def _links(docs: DataFrame, records: DataFrame, depth: int, threshold: float) -> DataFrame:
    groups = settle(_groups(records, depth), "candidates")
    chosen = settle(
        groups.select("node").dropDuplicates().join(records, "node").select("node", "hi", "lo", "size", "label"),
        "compared",
    )
    texts = docs.join(sent(chosen, 4), F.col("doc_id") == F.col("node")).drop("doc_id")
    sets = texts.mapInArrow(_sets, _SET)
    rows = sets.join(sent(settle(_grid(groups), "grid")), "node")
    dealt = rows.repartition("grp", "tree", "lo", "hi").sortWithinPartitions("grp", "tree", "lo", "hi")
    return settle(dealt.mapInArrow(_verify(depth, threshold), _FOUND), "links")


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copy_of.

    Documents link when the Jaccard similarity of their shingle sets is at least ``threshold``; a shingle is five
    words between white space, or the whole of a shorter text. ``n_links`` counts all other documents that link
    with this one, copies included; ``class_id`` is the smallest id that links lead to, ``copy_of`` the smallest
    id with the same shingles. Documents of one shingle set are compared as one, so a group of copies costs
    one row, and candidates are never listed as pairs: a group is compared inside a task, block by block, and
    gives its documents' numbers of links and a spanning forest.

    The forest's depth follows from the threshold alone: each pair at or above it is found with a chance of at
    least ``recall``, however many other links there are (at thresholds below 0.33 no depth gives the default).

    A null text is empty; texts without words link with nothing and are a class of their own. A row without id
    is returned with null class and no links. Rows that repeat an id give one row; the one whose shingles hash
    lowest speaks for it. Other columns are not looked at. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    records = settle(docs.mapInArrow(_records, _RECORD), "shingles")
    ids = records.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("hi", "lo", "n")).alias("k"))
    ids = settle(ids.select("doc_id", "k.hi", "k.lo", "k.n"), "shingle-ids")
    key = ["hi", "lo"]
    classes = ids.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size"))
    classes = settle(classes, "shingle-classes")
    speaks = records.join(classes, key).filter("doc_id = node")
    speaks = settle(speaks.select("node", *key, "size", "label").dropDuplicates(["node"]), "shingle-nodes")
    found = _links(docs, speaks, depth_for(threshold, recall), threshold)
    joined = components(found.filter("kind = 1").select("a", "b"))
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("w").cast("long").alias("near"))
    nodes = classes.join(joined, "node", "left").join(counts, "node", "left").select(
        *key, "node", F.coalesce("component", "node").alias("class_id"),
        (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
    )
    out = ids.join(nodes, key, "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("node", "doc_id").alias("copy_of"),
    )
    nameless = records.filter("doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("doc_id").alias("copy_of"),
    )
    return out.unionByName(nameless)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each class the id that names it; rows without id."""
    verdict = jaccard_join(docs, id_col, text_col)
    (key,) = unused(docs, "_id")
    gone = settle(verdict.filter("doc_id <> class_id").select(F.col("doc_id").alias(key)), "near-copies")
    return docs.join(sent(gone), docs[id_col] == F.col(key), "left_anti")
