"""Packing of documents into training sequences of equal attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_column, settle
from .words import encoder

#: Tokens of rests that are packed together: 1024 sequences at the usual capacity.
WINDOW_TOKENS = 1 << 20
#: Words kept in a worker's memory (twice, see ``words``): a word that is not kept costs a call of the library.
MEMORY = 400_000
#: Scan tasks whose last tokens, less than a sequence each, are packed by one task.
JOINED_TASKS = 1024
#: Sequences are numbered from a task's number times 2^40; tasks of the second pass come after all scan tasks.
FIRST_BITS, SECOND_PASS = 40, 1 << 22
PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " ids array<int>"
)
#: Pieces of the first pass; those without a sequence wait for the second one, in the order of ``task`` and ``place``.
WAITING = f"{PIECE}, task long, place long"


def capacities(total: int, capacity: int) -> np.ndarray:
    """Room of the sequences for ``total`` tokens: full ones, then the powers of two that make up the rest."""
    rest = total % capacity
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * (total // capacity) + powers, dtype=np.int64)


def balance(
    lengths: np.ndarray, capacity: int, linear: float, quadratic: float
) -> tuple[list[tuple[int, int, int, int]], int]:
    """(item, start in item, length, sequence) per piece, and the number of sequences.

    Items go by descending cost to the sequence of the lowest cost that still has room for the whole item; one
    that fits nowhere is cut over the sequences with the most room. All sequences end up full.
    """
    room = capacities(int(lengths.sum()), capacity)
    cost = np.zeros(len(room))
    pieces = []

    def put(item: int, start: int, length: int, at: int) -> None:
        pieces.append((item, start, length, at))
        room[at] -= length
        cost[at] += linear * length + quadratic * length * length

    for item in np.argsort(-lengths, kind="stable"):
        length, start = int(lengths[item]), 0
        fits = np.flatnonzero(room >= length)
        if len(fits):
            put(int(item), 0, length, int(fits[np.argmin(cost[fits])]))
            continue
        while start < length:
            at = int(np.argmax(room))
            part = min(length - start, int(room[at]))
            put(int(item), start, part, at)
            start += part
    return pieces, len(room)


class _Packer:
    """The rests of one task, packed window by window."""

    def __init__(self, part: int, capacity: int, linear: float, quadratic: float, window: int, with_ids: bool):
        self.first, self.capacity, self.window = part << FIRST_BITS, capacity, window
        self.costs, self.with_ids = (linear, quadratic), with_ids
        self.rests, self.held, self.out = [], 0, []

    def _emit(self, key, start: int, data: bytes, total: int, sequence: int, offset: int) -> None:
        ids = data if self.with_ids else b""
        self.out.append((key, start, len(data) // 4, zlib.crc32(data), total, sequence, offset, ids, None, None))

    def add(self, key, data: bytes) -> None:
        total, step = len(data) // 4, 4 * self.capacity
        whole = total // self.capacity
        for k in range(whole):
            self._emit(key, k * self.capacity, data[k * step : (k + 1) * step], total, self.first, 0)
            self.first += 1
        if total % self.capacity:
            self.add_rest(key, whole * self.capacity, data[whole * step :], total)

    def add_rest(self, key, start: int, data: bytes, total: int) -> None:
        self.rests.append((key, start, data, total))
        self.held += len(data) // 4
        if self.held >= self.window:
            self.pack()

    def leave(self, task: int) -> None:
        """Packs what fills sequences and hands on the rest, less than one sequence, without a sequence."""
        self.pack()
        for place, (key, start, data, total) in enumerate(self.rests):
            self.out.append((key, start, len(data) // 4, zlib.crc32(data), total, None, None, data, task, place))
        self.rests, self.held = [], 0

    def _held_back(self) -> list:
        """Takes off the tokens beyond a multiple of the capacity, for the next window."""
        back, more = [], self.held % self.capacity
        while more:
            key, start, data, total = self.rests.pop()
            kept = max(len(data) // 4 - more, 0)
            if kept:
                self.rests.append((key, start, data[: 4 * kept], total))
            back.append((key, start + kept, data[4 * kept :], total))
            more -= len(data) // 4 - kept
        return back

    def pack(self, last: bool = False) -> None:
        back = [] if last else self._held_back()
        if not self.rests:
            self.rests = back
            return
        lengths = np.array([len(r[2]) // 4 for r in self.rests], dtype=np.int64)
        pieces, sequences = balance(lengths, self.capacity, *self.costs)
        used = [0] * sequences
        for item, start, length, at in pieces:
            key, before, data, total = self.rests[item]
            self._emit(key, before + start, data[4 * start : 4 * (start + length)], total, self.first + at, used[at])
            used[at] += length
        self.first += sequences
        self.rests, self.held = back, sum(len(r[2]) // 4 for r in back)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            *columns, ids, task, place = zip(*self.out, strict=True)
            arrays = [*(pa.array(c, pa.int64()) for c in columns), list_column(list(ids))]
            arrays += [pa.array(c, pa.int64()) for c in (task, place)]
            self.out = []
            yield pa.record_batch(arrays, names=[f.split()[0] for f in WAITING.split(",")])


def _pack(path: str, end_id: int, memory: int, *settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, words = _Packer(task, *settings), encoder(path, memory)
        end = np.int32(end_id).tobytes()
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, lengths, ids in words.encode(batch.column("text")):
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    packer.add(keys[first + k], ids[a:b].tobytes() + end)
                yield from packer.batches()
        packer.leave(task)
        yield from packer.batches()

    return run


def _join_rests(*settings):
    """Packs what scan tasks handed on; rows come sorted, so a task that runs again gives the same sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(SECOND_PASS + TaskContext.get().partitionId(), *settings)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
            for key, start, total, ids in zip(*columns, batch.column("ids"), strict=True):
                packer.add_rest(key, start, ids.values.to_numpy().astype(np.int32).tobytes(), total)
            yield from packer.batches()
        packer.pack(last=True)
        yield from packer.batches()

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, linear: float = 1.0,
    quadratic: float = 1 / 1024, window_tokens: int = WINDOW_TOKENS, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text", word_memory: int = MEMORY,
) -> DataFrame:
    """Pieces of all documents, each with its sequence and its place there.

    A document's cost is estimated as linear * n + quadratic * n^2 tokens. A task encodes its own documents:
    whole multiples of the capacity become sequences at once, and the rests wait until ``window_tokens`` of them
    are there and are then packed by ``balance``. What a window holds beyond full sequences waits for the next one.
    What a task holds at its end, less than one sequence, is handed on, and these rests of JOINED_TASKS tasks are
    packed together: only that is exchanged, and only there sequences of a power of two tokens arise, so no
    sequence needs padding and short ones do not grow with the number of partitions. The pieces of the first pass
    are stored. Memory is one window and the ids of ``word_memory`` words, twice.

    A null or empty text has the end id only. Rows that repeat an id are packed as documents of their own; a
    null id is kept. Very long texts are cut, never shortened. Other columns are not looked at. An empty table
    gives no piece. ``ids`` is empty unless ``with_ids``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    settings = (capacity, linear, quadratic, window_tokens, with_ids)
    first = settle(rows.mapInArrow(_pack(tokenizer_path, end_id, word_memory, *settings), WAITING), "packed-pieces")
    names = [f.split()[0] for f in PIECE.split(",")]
    rests = first.filter("sequence_id is null")
    tasks = rests.agg(F.countDistinct("task")).first()[0]
    group = F.floor(F.col("task") / JOINED_TASKS)
    dealt = rests.repartition(-(-tasks // JOINED_TASKS) or 1, group).sortWithinPartitions("task", "place")
    joined = dealt.mapInArrow(_join_rests(*settings), WAITING)
    return first.filter("sequence_id is not null").select(*names).unionByName(joined.select(*names))
