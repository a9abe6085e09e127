"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, settle
from .tokens import slices, words

#: Words share this many vectors by hash, each of DIM numbers: a table of 4 MB, whatever the corpus.
BUCKETS, DIM = 1 << 14, 64
#: Places on either side of a word that count as its context; entries of an index vector that are not zero.
REACH, ENTRIES = 2, 4
#: Vectors that travel in one row.
BLOCK = 256
#: Labelled rows that the network is fitted on at most, the first by hash of their id.
FIT_ROWS = 20_000
HIDDEN, EPOCHS, STEP, DECAY, SEED = 48, 40, 2e-3, 1e-4, 7
#: Words that are pooled at once; within that, sums are of single precision.
CHUNK = 1 << 13
_SPLIT = (r"([\p{L}\p{N}])([^\p{L}\p{N}\s])", r"([^\p{L}\p{N}\s])([\p{L}\p{N}])")


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's sparse random index vector."""
    draw = np.random.default_rng(SEED)
    places = np.argsort(draw.random((BUCKETS, DIM)), axis=1)[:, :ENTRIES]
    return places, draw.choice([-1.0, 1.0], (BUCKETS, ENTRIES))


def _codes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and signs count as words of their own."""
    for pattern in _SPLIT:
        texts = pc.replace_substring_regex(texts, pattern, r"\1 \2")
    return words(texts, _bucket, np.int32)


def _add_contexts(sums: np.ndarray, counts: np.ndarray, codes: np.ndarray, places, signs) -> None:
    rows = np.repeat(np.arange(len(counts)), counts)
    for gap in range(1, REACH + 1):
        same = rows[gap:] == rows[:-gap]
        left, right = codes[:-gap][same], codes[gap:][same]
        for word, near in ((left, right), (right, left)):
            for entry in range(ENTRIES):
                at = word.astype(np.int64) * DIM + places[near, entry]
                sums += np.bincount(at, signs[near, entry], BUCKETS * DIM)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task saw of each bucket's contexts: rows of BLOCK vectors, blocks without any left out."""
    places, signs = index_vectors()
    sums = np.zeros(BUCKETS * DIM)
    for batch in batches:
        for _, rows in slices(batch.column("text")):
            _add_contexts(sums, *_codes(rows), places, signs)
    blocks = sums.astype(np.float32).reshape(-1, BLOCK * DIM)
    for k in np.flatnonzero(blocks.any(axis=1)):
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([blocks[k].tobytes()])], names=["block", "sums"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums rows of one block as they come; memory is the blocks of a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            part = np.frombuffer(sums.as_py(), dtype=np.float32)
            total[block] = total[block] + part if block in total else part.astype(np.float64)
    if total:
        yield pa.record_batch(
            [pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()])],
            names=["block", "sums"],
        )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIM random-indexing vectors from all texts: own index vector plus context, of length one each.

    Each task adds up its own documents; the tasks' sums meet by block. What reaches the driver is the finished
    table, whose size is fixed.
    """
    kind = "block int, sums binary"
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(_context_sums, kind)
    rows = sums.repartition("block").mapInArrow(_total, kind).collect()
    table = np.zeros((BUCKETS // BLOCK, BLOCK * DIM), dtype=np.float32)
    for row in rows:
        table[row["block"]] = np.frombuffer(row["sums"], dtype=np.float32)
    return _unit(table.reshape(BUCKETS, DIM))


def _unit(context: np.ndarray) -> np.ndarray:
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIM), dtype=np.float32)
    np.put_along_axis(own, places, signs.astype(np.float32), axis=1)
    def normed(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    return normed(normed(own) + normed(context))


def pooled(texts: pa.StringArray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word vectors, rows of 2 * DIM; zeros for a text without words."""
    counts, codes = _codes(texts)
    both = np.concatenate([vectors, vectors * vectors], axis=1)
    rows = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros((len(counts), 2 * DIM))
    for first in range(0, len(codes), CHUNK):
        row = rows[first : first + CHUNK]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] += np.add.reduceat(both[codes[first : first + CHUNK]], starts, axis=0)
    out /= np.maximum(counts, 1)[:, None]
    out[:, DIM:] = np.sqrt(np.maximum(out[:, DIM:] - out[:, :DIM] ** 2, 0))
    return out.astype(np.float32)


@dataclass
class Network:
    """Two dense layers over standardised features, and the temperature of the logits."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Network:
    """Adam on the rows outside ``check``; the temperature that makes the rows in it likeliest.

    Rows of one class only, or none, give that class's share (one half without rows) to every document.
    """
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(x) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        layers = [np.zeros((2 * DIM, 1)), np.zeros(1), np.zeros((1, 1)), np.array([np.log(share / (1 - share))])]
        return Network(np.zeros(2 * DIM), np.ones(2 * DIM), layers)
    learn = ~check if (~check).any() else check
    net = Network(x[learn].mean(axis=0), np.maximum(x[learn].std(axis=0), 1e-6), [])
    draw = np.random.default_rng(SEED)
    net.layers = [
        draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        draw.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1),
    ]
    rows, target = (x[learn] - net.mean) / net.scale, y[learn]
    first = [np.zeros_like(p) for p in net.layers]
    second = [np.zeros_like(p) for p in net.layers]
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), 128):
            pick, step = order[at : at + 128], step + 1
            w1, b1, w2, b2 = net.layers
            hidden = np.tanh(rows[pick] @ w1 + b1)
            error = ((_sigmoid((hidden @ w2 + b2)[:, 0]) - target[pick]) / len(pick))[:, None]
            back = (error @ w2.T) * (1 - hidden**2)
            slopes = [rows[pick].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, error.sum(axis=0)]
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                rate = STEP * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                net.layers[k] = net.layers[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    if check.any():
        logits, truth = net.logits(x[check]), y[check]
        heats = np.geomspace(0.25, 8, 121)
        loss = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in heats]
        net.temperature = float(heats[int(np.argmin(loss))])
    return net


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column("text")):
                data = [v.tobytes() for v in pooled(rows, vectors.value)]
                chosen = batch.slice(first, len(rows))
                yield pa.record_batch(
                    [chosen.column("doc_id"), chosen.column("quality"), pa.array(data, pa.binary())],
                    names=["doc_id", "quality", "features"],
                )

    return run


def learn(docs: DataFrame, labels: DataFrame, vectors, id_col: str, text_col: str) -> Network:
    """Fits on at most FIT_ROWS labelled ids outside fold 0; those of fold 1 set the temperature.

    Of rows that repeat an id one is fitted on, the one whose features are least as bytes.
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    one = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = settle(
        one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select(
            F.col("doc_id").alias("_label_id"), F.col("quality").cast("int").alias("quality"), fold("doc_id").alias("fold")
        ), "quality-labels",
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id"))
    named = rows.select(F.struct("_label_id", "fold").alias("doc_id"), "quality", "text")
    kind = named.schema["doc_id"].dataType.simpleString()
    one_each = named.mapInArrow(_features(vectors), f"doc_id {kind}, quality int, features binary").groupBy("doc_id").agg(
        F.first("quality").alias("quality"), F.min("features").alias("features")
    )
    found = one_each.select(F.col("doc_id.fold").alias("doc_id"), "quality", "features").collect()
    found.sort(key=lambda r: r["features"])
    x = np.array([np.frombuffer(r["features"], dtype=np.float32) for r in found]).reshape(len(found), 2 * DIM)
    y = np.array([r["quality"] for r in found], dtype=np.float64)
    return fit_network(x, y, np.array([r["doc_id"] == 1 for r in found], dtype=bool))


def _score(vectors, net: Network, score_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column(0)):
                score = net.probability(pooled(rows, vectors.value))
                kept = batch.slice(first, len(rows))
                yield pa.record_batch(
                    [*kept.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], score_col]
                )

    return run


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    keep: list[str] | None = None, score_col: str = "score",
) -> DataFrame:
    """The columns ``keep`` (all, if None) and a score (0 to 1, higher for quality 1) of every whole text.

    Word vectors come from all texts; the network learns from labels outside fold 0 only (crc32 of the id as
    text, modulo 5) and sees nothing of a document but its text. Null and empty texts pool to zeros and get the
    network's score of that. Rows that repeat an id are scored each; where labels repeat an id the highest
    counts; labels that are null are left out. Without usable labels every score is one half. Columns of other
    names are not looked at; ``score_col`` must not be among those kept. An empty table gives no rows.
    """
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs, text_col))
    net = learn(docs, labels, vectors, id_col, text_col)
    keep = docs.columns if keep is None else keep
    if score_col in keep:
        raise ValueError(f"{score_col} is a column of the documents; name another score_col")
    rows = docs.select(docs[text_col].alias("_quality_text"), *[docs[c] for c in keep])
    kind = StructType([*docs.select(*[docs[c] for c in keep]).schema.fields, StructField(score_col, DoubleType())])
    return rows.mapInArrow(_score(vectors, net, score_col), kind)
