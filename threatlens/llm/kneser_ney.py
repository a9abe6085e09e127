"""Interpolated modified Kneser-Ney model of any order from two: counted in Spark, stored as sorted hash arrays, memory-mapped.

Words are counted by 64-bit hash first and then numbered, frequent ones low, so that sorted n-grams are small
differences. Tasks send sorted arrays of what they counted, one row per shard, and a shard's task merges the
arrays it gets; no row is made per token or n-gram.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard
from .common import fold, fresh_folder, open_store, settle
from .tokens import coded, slices

#: Tokens of the corpus for each shard of the model; shards grow with the corpus.
SHARD_TOKENS = 2 << 20
#: Bytes of text that are counted, or scored, at once: the more, the fewer distinct words and n-grams are looked up, and
#: the closer together those lie in the arrays. Scoring 12 MB takes some 280 MB.
COUNT_BYTES, SCORE_BYTES = 8 << 20, 12 << 20
#: Words of the longest n-grams, in production.
ORDER = 3
#: A word that makes up more than one token in so many, or fills a shard, has the n-grams of contexts that end in it
#: dealt by all words.
HOT = 4096
#: Numbers of words: never seen, begin of a text, and the first that is given to a word.
UNSEEN, START, FIRST = 0, 1, 2
#: The begin and end of a text; words hold no white space, so none hashes like these on purpose.
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" begin ", b" end "))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUN = "shard int, body binary"
#: Sorted keys, then values, of each kind of file, whatever the number of words in its name. Two arrays of keys are
#: those counted once, which have no values, and the others.
LAYOUT = {"words": (1, 2), "grams": (2, 1), "left": (2, 4), "hot": (2, 4), "right": (1, 1)}


_hash = xxhash.xxh3_64_intdigest


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hash of two words in order."""
    h = (left * _MIX) ^ (right + (left >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def token_codes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens per row, place of each token's hash, hashes): A-Z lower-cased, words between ASCII white space, one
    end per text."""
    counts, codes, distinct = coded(pc.ascii_lower(texts))
    ends = np.cumsum(counts + 1) - 1
    tokens = np.zeros(int(counts.sum()) + len(counts), dtype=np.int64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[ends] = False
    tokens[inner] = codes + 1
    hashes = np.empty(len(distinct) + 1, dtype=np.uint64)
    hashes[0], hashes[1:] = END, np.fromiter(map(_hash, distinct), dtype=np.uint64, count=len(distinct))
    return counts + 1, tokens, hashes


def _spread(numbers: np.ndarray) -> np.ndarray:
    """Numbers as 64-bit hashes, each its own."""
    h = (numbers ^ (numbers >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(32))


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of numbered words in order."""
    return reduce(pair_hash, map(_spread, words))


def _left_words(counts: np.ndarray, tokens: np.ndarray, back: int) -> np.ndarray:
    """The token ``back`` places before each one; before a text stand begins."""
    within = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    has = np.flatnonzero(within >= back)
    left = np.full_like(tokens, START)
    left[has] = tokens[has - back]
    return left


def _grams(counts: np.ndarray, tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """The words of the n-gram that ends at each token, in order."""
    return [*(_left_words(counts, tokens, back) for back in range(order - 1, 0, -1)), tokens]


def _packed(keys: list[np.ndarray]) -> list[np.ndarray]:
    """The same order of rows in fewer columns: the keys' bits one after the other, cut into 64-bit numbers."""
    packs, room = [], 0
    for key in keys:
        width = max(int(key.max(initial=0)).bit_length(), 1)
        rest = width - room
        if rest <= 0:
            packs[-1] = (packs[-1] << np.uint64(width)) | key
        elif room:
            packs[-1] = (packs[-1] << np.uint64(room)) | (key >> np.uint64(rest))
            packs.append(key & np.uint64((1 << rest) - 1))
        else:
            packs.append(key)
        room = -rest if rest <= 0 else 64 - rest
    return packs


def _order(packs: list[np.ndarray]) -> np.ndarray:
    """Rows in order: sorted by the first number, then only rows that share it by the others."""
    order = np.argsort(packs[0])
    if len(packs) > 1:
        first = packs[0][order]
        new = np.ones(len(order) + 1, dtype=bool)
        new[1:-1] = first[1:] != first[:-1]
        tied = np.flatnonzero(~(new[:-1] & new[1:]))
        rows = order[tied]
        order[tied] = rows[np.lexsort([*(p[rows] for p in packs[:0:-1]), np.cumsum(new[:-1])[tied]])]
    return order


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows in key order, where in that order each distinct key starts)."""
    packs = _packed(keys)
    order = _order(packs)
    return order, _starts([p[order] for p in packs])


def _distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct rows in key order, place of each row among them)."""
    order, starts = _groups(keys)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return [k[order[starts]] for k in keys], place


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _summed(keys: list[np.ndarray], *values: np.ndarray) -> list[np.ndarray]:
    """Rows of equal keys added up, in key order."""
    order, starts = _groups(keys)
    firsts = order[starts]
    sums = [np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]
    return [*(k[firsts] for k in keys), *sums]


def _counted(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct rows in order and how often each occurs."""
    order, starts = _groups(keys)
    firsts = order[starts]
    return [*(k[firsts] for k in keys), np.diff(np.append(starts, len(order)))]


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def _body(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed buffer; bytes of one weight lie together."""
    sink = pa.BufferOutputStream()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    batch = pa.record_batch([pa.array([p], pa.large_binary()) for p in planes], names=[
        f"{i}:{a.dtype.str}" for i, a in enumerate(arrays)
    ])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _arrays(body: bytes) -> list[np.ndarray]:
    batch, out = pa.ipc.open_stream(body).read_next_batch(), []
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        kind = np.dtype(name.split(":", 1)[1])
        planes = np.frombuffer(column[0].as_buffer(), dtype=np.uint8).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return out


def _steps(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Differences of values that rise within runs; the first of a run stands as it is."""
    steps = np.diff(values, prepend=values[:1])
    steps[runs] = values[runs]
    return _small(steps)


def _risen(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """What ``_steps`` was given."""
    values = np.cumsum(steps, dtype=np.uint64)
    before = values[runs] - steps[runs].astype(np.uint64)
    return values - np.repeat(before, np.diff(np.append(runs, len(values))))


def _nested(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted distinct rows: of each column one value per run, as its step, and how many of the next one's are in it."""
    arrays, outer = [], np.zeros(1, dtype=np.int64)
    for k in range(len(columns)):
        starts = _starts(columns[: k + 1])
        within = np.searchsorted(starts, outer)
        arrays += [_small(np.diff(np.append(within, len(starts)))), _steps(columns[k][starts], within)]
        outer = starts
    return _body(*arrays[1:], _small(counts))


def _flat(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Columns and counts of what ``_nested`` packed."""
    columns = [_risen(arrays[0], np.zeros(1, dtype=np.int64))]
    for sizes, steps in zip(arrays[1:-1:2], arrays[2:-1:2], strict=True):
        sizes = sizes.astype(np.int64)
        columns = [*(np.repeat(c, sizes) for c in columns), _risen(steps, np.cumsum(sizes) - sizes)]
    return [*columns, arrays[-1].astype(np.int64)]


def _row(shard: int, body: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([shard], pa.int32()), pa.array([body])], names=["shard", "body"])


def _by_shard(shards: np.ndarray, n_shards: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    shards = _small(shards)
    order = np.argsort(shards, kind="stable")
    bounds = np.searchsorted(shards[order], np.arange(n_shards + 1))
    for shard in np.flatnonzero(np.diff(bounds)):
        chosen = order[bounds[shard] : bounds[shard + 1]]
        yield int(shard), [c[chosen] for c in columns]


def _shard_of(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return (((hashes * _MIX) >> np.uint64(33)) % np.uint64(n_shards)).astype(np.int64)


@dataclass
class Shelf:
    """Arrays that were written to a folder, one file for each kind and shard."""

    folder: str
    n_shards: int
    #: Names of the files that were written; a shard without any has no arrays.
    written: frozenset[str]
    files: dict = field(default_factory=dict, repr=False, kw_only=True)

    def __getstate__(self):
        return self.__dict__ | {"files": {}}

    def _file(self, name: str) -> list[np.ndarray]:
        """The arrays of one file, memory-mapped; from a store that is not mounted it is fetched once.

        A file that was written and is gone is an error: its words would count as never seen.
        """
        if name not in self.files:
            self.files[name] = _mapped(self.folder, name) if name in self.written else []
        return self.files[name]

    def look_up(self, kind: str, hashes: np.ndarray, shards: np.ndarray, out: list[np.ndarray]) -> list[np.ndarray]:
        """Puts the values of each hash into ``out``; what was not seen stays.

        A hash that was counted once has one, one and zeros: its total, and how many were seen once, twice, more often.
        """
        width = max((self.n_shards - 1).bit_length(), 1)
        rising = np.argsort((shards.astype(np.uint64) << np.uint64(64 - width)) | (hashes >> np.uint64(width)))
        hashes, ends = hashes[rising], np.cumsum(np.bincount(shards, minlength=self.n_shards))
        for shard in np.flatnonzero(np.diff(ends, prepend=0)):
            if not (arrays := self._file(f"{kind}-{shard:07d}")):
                continue
            part = slice(ends[shard - 1] if shard else 0, ends[shard])
            rows, wanted = rising[part], hashes[part]
            n_keys = LAYOUT[kind.rstrip("0123456789")][0]
            if n_keys == 2:
                _, found = _find(arrays[0], wanted)
                for o in out[:2]:
                    o[rows[found]] = 1
                rows, wanted = rows[~found], wanted[~found]
            at, found = _find(arrays[n_keys - 1], wanted)
            rows, at = rows[found], at[found]
            for o, v in zip(out, arrays[n_keys:], strict=True):
                o[rows] = v[at]
        return out

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, number) of words by their hashes."""
        shards = _shard_of(hashes, self.n_shards)
        count, rank = self.look_up("words", hashes, shards, _zeros(hashes, 2))
        return count, np.where(count > 0, rank * self.n_shards + shards + FIRST, UNSEEN).astype(np.uint64)


def _zeros(like: np.ndarray, width: int) -> list[np.ndarray]:
    return [np.zeros(len(like), dtype=np.int64) for _ in range(width)]


@dataclass
class Model(Shelf):
    """Where the arrays lie and the few numbers that all probabilities share."""

    tokens: int
    vocabulary: int
    order: int
    pair_types: int
    #: Discounts of n-grams by their number of words, from one.
    by: dict[int, np.ndarray]
    word_mass: float

    def _by_context(self, context: np.ndarray, hashes: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(contexts that end in a hot word, shards): by the context's last word, where that is hot by the hash."""
        often = np.isin(context, hot)
        return often, np.where(often, _shard_of(hashes, self.n_shards), _shard_of(context, self.n_shards))

    def gram_counts(self, words: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
        hashes = gram_hash(words)
        _, shards = self._by_context(words[-2], hashes, hot)
        return self.look_up(f"grams{len(words)}", hashes, shards, _zeros(hashes, 1))[0]

    def context_totals(self, words: list[np.ndarray], hot: np.ndarray) -> list[np.ndarray]:
        """Total of each context, and how many n-grams of it were counted once, twice, more often."""
        hashes = gram_hash(words)
        often, shards = self._by_context(words[-1], hashes, hot)
        out = _zeros(hashes, 4)
        for kind, rows in (("left", np.flatnonzero(~often)), ("hot", np.flatnonzero(often))):
            part = self.look_up(f"{kind}{len(words)}", hashes[rows], shards[rows], _zeros(rows, 4))
            for o, p in zip(out, part, strict=True):
                o[rows] = p
        return out

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the base probability of words by their counts."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))

    def chances(self, words: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
        """Probability of the last of numbered words in order; rows of one context should follow each other.

        Each distinct context and each distinct shorter n-gram is looked up once.
        """
        if len(words) == 1:
            (lefts,) = self.look_up("right", words[0], _shard_of(words[0], self.n_shards), _zeros(words[0], 1))
            return _taken(lefts, self.by[1]) / max(self.pair_types, 1) + self.word_mass / (self.vocabulary + 1)
        shorter, place = _distinct(words[1:])
        chance = self.chances(shorter, hot)[place]
        del shorter, place
        starts = _starts(words[:-1])
        total, *kinds = self.context_totals([w[starts] for w in words[:-1]], hot)
        by, known = self.by[len(words)], np.maximum(total, 1)
        runs = np.diff(np.append(starts, len(chance)))
        spare, known, total = (np.repeat(x, runs) for x in (np.stack(kinds, axis=1) @ by / known, known, total))
        return np.where(total > 0, _taken(self.gram_counts(words, hot), by) / known + spare * chance, chance)

    def log10(
        self, left: np.ndarray | list[np.ndarray], right: np.ndarray, hot: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, right word's training count, log10 base probability) of n-grams of word hashes.

        ``left`` holds the context's words in order, as many as the order needs, or is the one word of bigrams.
        """
        context = [
            np.where(w == BEGIN, np.uint64(START), self.numbers(w)[1]) for w in (left if isinstance(left, list) else [left])
        ]
        count, number = self.numbers(right)
        return np.log10(self.chances([*context, number], hot)), count, self.base(count)


class _Counter:
    """Counts of keys, merged whenever the new ones outgrow the merged ones, so memory follows distinct keys."""

    def __init__(self):
        self.done: list[np.ndarray] = []
        self.new: list[list[np.ndarray]] = []
        self.held = 0

    def add(self, *columns: np.ndarray) -> None:
        self.new.append(list(columns))
        self.held += len(columns[0])
        if self.held > max(1 << 20, len(self.done[0]) if self.done else 0):
            self.merge()

    def merge(self) -> list[np.ndarray]:
        parts = [p for p in [self.done, *self.new] if p]
        self.new, self.held = [], 0
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            self.done = _summed(columns[:-1], columns[-1])
        return self.done


#: Bytes of counted keys after which a task sends what it has: memory of a task whatever its share.
FLUSH = 3 << 20


def _count_words(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()

        def sent():
            keys, counts = counter.merge()
            for shard, (k, c) in _by_shard(_shard_of(keys, n_shards), n_shards, [keys, counts]):
                yield _row(shard, _body(k, _small(c)))
            counter.done = []

        for batch in batches:
            for _, rows in slices(batch.column("text"), COUNT_BYTES):
                _, tokens, hashes = token_codes(rows)
                counter.add(hashes, np.bincount(tokens, minlength=len(hashes)))
                if counter.done and len(counter.done[0]) > FLUSH:
                    yield from sent()
        if counter.done or counter.new:
            yield from sent()

    return run


def _deal_grams(columns: list[np.ndarray], counts: np.ndarray, n_shards: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of distinct n-grams to odd shards: by the last word of the context, where that is hot by all words.

    Columns are the context's words, the last one first, and then the word after it, as is the order of rows.
    """
    shards = _shard_of(columns[0], n_shards)
    if len(columns) > 1:
        often = np.isin(columns[0], hot)
        shards[often] = _shard_of(gram_hash([*(c[often] for c in columns[-2::-1]), columns[-1][often]]), n_shards)
    for shard, (*part, n) in _by_shard(shards, n_shards, [*columns, counts]):
        yield _row(2 * shard + 1, _nested(part, n))


#: Tokens that a task counts n-grams of at once.
CHUNK = 2 << 20


def _count_grams(known: Shelf, hot, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, tokens, held = [], [], 0

        def sent():
            *context, last = _grams(np.concatenate(sizes), np.concatenate(tokens), order)
            *columns, counts = _counted([*context[::-1], last])
            yield from _deal_grams(columns, counts, known.n_shards, hot.value)

        for batch in batches:
            for _, rows in slices(batch.column("text"), COUNT_BYTES):
                size, codes, hashes = token_codes(rows)
                sizes.append(size)
                tokens.append(known.numbers(hashes)[1][codes])
                held += len(codes)
                if held > CHUNK:
                    yield from sent()
                    sizes, tokens, held = [], [], 0
        if held:
            yield from sent()

    return run


def _store(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Writes raw arrays behind a header of lengths and widths under a temporary name, then renames."""
    store, root = open_store(folder)
    temporary = f"{root}/{name}.{uuid.uuid4().hex}.tmp"
    head = np.zeros(16, dtype=np.int64)
    head[: len(arrays)] = [len(a) for a in arrays]
    head[8 : 8 + len(arrays)] = [a.itemsize for a in arrays]
    with store.open_output_stream(temporary, compression=None) as out:
        out.write(head.tobytes())
        for array in arrays:
            out.write(array.tobytes())
    try:
        store.move(temporary, f"{root}/{name}")
    except OSError:  # an earlier attempt left the same bytes, on a store that does not overwrite
        store.delete_file(f"{root}/{name}")
        store.move(temporary, f"{root}/{name}")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """Rows come sorted by shard: all arrays of one shard at a time."""
    held, parts = None, []
    for batch in batches:
        for shard, body in zip(batch.column("shard").to_pylist(), batch.column("body"), strict=True):
            if shard != held and parts:
                yield held, parts
                parts = []
            held = shard
            parts.append(_arrays(body.as_py()))
    if parts:
        yield held, parts


def _merge_words(folder: str, n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _shards(batches):
            keys, counts = _summed([np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]).astype(np.int64))
            ranked = np.lexsort([keys, -counts])
            ranks = np.empty_like(ranked)
            ranks[ranked] = np.arange(len(ranked))
            _store(folder, f"words-{shard:07d}", keys, _small(counts), _small(ranks))
            often = ranked[: max(HOT, int((counts > SHARD_TOKENS).sum()))]
            yield pa.record_batch(
                [
                    pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()),
                    pa.array([(ranks[often] * n_shards + shard + FIRST).tolist()], pa.list_(pa.int64())),
                    pa.array([counts[often].tolist()], pa.list_(pa.int64())),
                ],
                names=["distinct", "total", "often", "times"],
            )

    return run


def _store_counted(folder: str, name: str, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> None:
    """Keys that were counted once apart from the others, which have values."""
    order = np.argsort(keys)
    once = counts[order] == 1
    many = order[~once]
    _store(folder, name, keys[order[once]], keys[many], *(_small(v[many]) for v in (counts, *more)))


def _merge_grams(folder: str, n_shards: int, hot, size: int):
    """Stores the n-grams of ``size`` words and their contexts' totals (odd shards), and the totals of contexts of
    ``size`` words that end in a hot word (even ones).

    The n-grams of a context meet in one shard, unless its last word is hot: such a context's totals are sent on.
    So is each n-gram without its first word with its number of distinct first words: the counts of the next
    shorter n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _shards(batches):
            if shard % 2 == 0:
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                merged = _summed([columns[0]], *(c.astype(np.int64) for c in columns[1:]))
                _store_counted(folder, f"hot{size}-{shard // 2:07d}", *merged)
                continue
            columns = [np.concatenate(c) for c in zip(*map(_flat, parts), strict=True)]
            parts.clear()
            *columns, counts = _summed(columns[:-1], columns[-1])
            words = [*columns[-2::-1], columns[-1]]
            kinds = [int((counts == k).sum()) for k in range(1, 5)]
            yield _row(-1, _body(np.array([*kinds, len(counts), (counts > 2).sum()], dtype=np.int64)))
            if size == 1:
                _store(folder, f"right-{shard // 2:07d}", words[0], _small(counts))
                continue
            _store_counted(folder, f"grams{size}-{shard // 2:07d}", gram_hash(words), counts)
            starts = _starts(columns[:-1])
            totals = [np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2, counts > 2)]
            context = [w[starts] for w in words[:-1]]
            often, hashes = np.isin(context[-1], hot.value), gram_hash(context)
            _store_counted(folder, f"left{size - 1}-{shard // 2:07d}", *(x[~often] for x in (hashes, *totals)))
            hashes, *totals = (x[often] for x in (hashes, *totals))
            for to, (keys, *sums) in _by_shard(_shard_of(hashes, n_shards), n_shards, [hashes, *totals]):
                yield _row(2 * to, _body(keys, *map(_small, sums)))
            *shorter, lefts = _counted([*columns[:-2], columns[-1]])
            yield from _deal_grams(shorter, lefts, n_shards, hot.value)

    return run


def discounts(kinds) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, from counts of counts.

    Where the corpus has no n-gram of a needed count, the discount is that of absolute discounting, or one half.
    """
    n = [float(k) for k in kinds[:4]]
    base = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out = [k + 1 - (k + 2) * base * n[k + 1] / n[k] if n[k] and n[k + 1] else base for k in range(3)]
    return np.array([min(max(d, 0.01), k + 0.99) for k, d in enumerate(out)])


def _taken(counts: np.ndarray, by: np.ndarray) -> np.ndarray:
    """counts less their discount; zero stays."""
    return np.where(counts > 0, counts - by[np.clip(counts, 1, 3) - 1], 0.0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 0:
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _mapped(folder: str, name: str) -> list[np.ndarray]:
    store, root = open_store(folder)
    path = f"{root}/{name}"
    if store.type_name != "local":
        local = os.path.join(tempfile.gettempdir(), f"{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}.model")
        if not os.path.exists(local):
            with store.open_input_stream(path) as stream, open(f"{local}.{os.getpid()}", "wb") as out:
                while data := stream.read(1 << 20):
                    out.write(data)
            os.replace(f"{local}.{os.getpid()}", local)
        path = local
    data = np.memmap(path, dtype=np.uint8, mode="r")
    head, at, out = data[:128].view(np.int64), 128, []
    n_keys, n_values = LAYOUT[name.split("-")[0].rstrip("0123456789")]
    for size, width in zip(head[: n_keys + n_values], head[8 : 8 + n_keys + n_values], strict=True):
        out.append(data[at : at + int(size * width)].view(f"u{width}"))
        at += int(size * width)
    return out


def train(docs: DataFrame, folder: str, order: int = ORDER) -> tuple[Model, np.ndarray]:
    """Counts the column ``text`` of all rows and stores the arrays below ``folder``; also the hot words.

    One exchange for words, one for n-grams of ``order`` words, and one for each shorter length, whose counts
    are numbers of distinct first words of the next longer one. Their rows are arrays, so their number follows
    tasks times shards, and what a length was counted from is deleted once the next one is stored. An n-gram goes
    by the last word of its context, and by all its words where that one is hot: one token in HOT, or more tokens
    than a shard has on average, so hot words are fewer than HOT and the shards together and no shard holds more
    than a bounded share. The driver sees totals and the hot words.
    """
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    letters = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_shards = 1 << max(3, int(letters // 6 // SHARD_TOKENS).bit_length())

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("shard").sortWithinPartitions("shard")

    counted = dealt(texts.mapInArrow(_count_words(n_shards), _RUN)).mapInArrow(
        _merge_words(folder, n_shards), "distinct long, total long, often array<long>, times array<long>"
    )
    counted = settle(counted, "kn-words")
    sums = counted.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    vocabulary, tokens = sums["v"] or 0, sums["n"] or 0
    pairs = counted.select(F.explode(F.arrays_zip("often", "times")).alias("x")).select("x.often", "x.times")
    hot = np.array(
        [r["often"] for r in pairs.filter(F.col("times") > min(tokens / HOT, SHARD_TOKENS)).collect()] + [START],
        dtype=np.uint64,
    )
    shared = spark.sparkContext.broadcast(hot)
    known = Shelf(folder, n_shards, _names(folder))
    rows, kinds, before = texts.mapInArrow(_count_grams(known, shared, order), _RUN), {}, None
    for size in range(order, 0, -1):
        path = fresh_folder(spark, f"kn-{size}")
        dealt(rows).mapInArrow(_merge_grams(folder, n_shards, shared, size), _RUN).write.parquet(path)
        if before:
            discard(spark, before)
        before, merged = path, spark.read.schema(_RUN).parquet(path)
        kinds[size] = _kinds(merged.filter("shard < 0"))
        rows = merged.filter("shard >= 0")
    discard(spark, before)
    by = {size: discounts(k) for size, k in kinds.items()}
    types, word_kinds = int(kinds[2][4]), kinds[1]
    mass = (by[1][0] * word_kinds[0] + by[1][1] * word_kinds[1] + by[1][2] * word_kinds[5]) / types if types else 1.0
    return Model(folder, n_shards, _names(folder), tokens, vocabulary, order, types, by, float(mass)), hot


def _names(folder: str) -> frozenset[str]:
    """Files of the folder."""
    store, root = open_store(folder)
    return frozenset(f.base_name for f in store.get_file_info(fs.FileSelector(root)))


def _kinds(rows: DataFrame) -> np.ndarray:
    """Sum of the shards' counts of counts."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_arrays(body.as_buffer().to_pybytes())[0] for body in batch.column(0)]
            if counts:
                yield pa.record_batch([pa.array(k) for k in np.stack(counts).T], names=names)

    names = [f"k{k}" for k in range(6)]
    counts = rows.select("body").mapInArrow(read, ", ".join(f"{n} long" for n in names))
    row = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    return np.array([row[n] for n in names], dtype=np.int64)


def _score(model: Model, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in slices(batch.column("text"), SCORE_BYTES):
                sizes, tokens, hashes = token_codes(rows)
                count, numbers = model.numbers(hashes)
                grams, place = _distinct(_grams(sizes, numbers[tokens], model.order))
                score = np.log10(model.chances(grams, hot.value))
                starts = np.cumsum(sizes) - sizes
                columns = [
                    pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64)[tokens], starts)),
                    pa.array(np.full(len(sizes), model.tokens)),
                    pa.array(np.add.reduceat(model.base(count)[tokens], starts)), pa.array(np.add.reduceat(score[place], starts)),
                ]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(first, len(sizes)), *columns],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_texts(
    docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    The model learns from the rows where ``training`` holds (crc32 of the id as text, modulo 5, is not 1). The
    probability of a word after the ``order`` - 1 words before it, begins before a text, is its discounted count
    there over the context's total, plus the mass taken times its probability after one word less; counts of
    shorter n-grams are their numbers of distinct words before. After no words it is the discounted share of
    bigram types that end in the word, plus what that leaves over the vocabulary and one
    unknown word. A null or empty text is one end token. A null id counts as the empty text in the remainder;
    rows that repeat an id are scored, and learned from, each. Other columns are not looked at. An empty table
    gives no rows; without training rows every token has the same probability.
    """
    folder = fresh_folder(docs.sparkSession, "kneser-ney")
    held = fold(id_col) == 1 if training is None else ~training
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    model, hot = train(rows.filter(~F.col("held_out")).select("text"), folder, order)
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kind = dict(docs.dtypes)[id_col]
    scored = rows.select("doc_id", "text").mapInArrow(
        _score(model, shared),
        f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumn("held_out", fold("doc_id") == 1) if training is None else scored
