"""Periodic runs of words: maximal pairs from a bottom-up LCP-interval tree with left-word class lists.

A run of smallest period q and length L shows as a maximal pair: two equal stretches of L - q words, q words
apart, that differ in the word before them and in the word after them. The other way round, a maximal pair of
l words at distance p with l >= 2p spans a run of length l + p >= 3p, which nothing extends; so the pairs at
an allowed distance are the runs, and the shortest distance of a span is its period.

Suffixes of the words are sorted by prefix doubling for a whole batch of documents at once. Since l >= 2p and
l + p >= MIN_LENGTH, only stretches of at least two thirds of MIN_LENGTH words matter: suffixes that share fewer
words with any other of their document drop out after a few doublings, and only the rest enters the tree.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import slices

#: Shortest run, in words, and the least number of its periods.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Bytes of text whose suffixes are sorted at once.
SORT_BYTES = 1 << 20
#: Positions that are put one by one into a longer list; more are merged by sorting.
FEW = 8
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = "doc_id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Interval:
    """An LCP interval: its depth in words and its positions, in order and listed by the word before them."""

    __slots__ = ("classes", "depth", "order")

    def __init__(self, depth: int, order: list[int], classes: dict[int, list[int]]):
        self.depth, self.order, self.classes = depth, order, classes


def merge(into: list[int], few: list[int]) -> None:
    """Puts the positions of a shorter ordered list into a longer one."""
    if few[0] > into[-1]:
        into.extend(few)
    elif len(few) <= FEW:
        for position in few:
            insort(into, position)
    else:
        into.extend(few)
        into.sort()


def join_child(node: Interval, child: Interval, left: list[int], least: int, found: dict[tuple[int, int], int]) -> None:
    """Lists the maximal pairs between two children of one interval, then joins the smaller to the larger one.

    Both positions of a pair have the interval's depth in words in common and differ in the word before. Occurrences
    that lie at most half the depth apart follow each other in steps of one period, so all but the first of them
    have the same word before them: a position has partners of one class only on its left and of one on its right,
    and its nearest neighbours tell which. So every look into a class list yields pairs, and nothing else is read.
    """
    depth = node.depth
    large, small = (node, child) if len(node.order) >= len(child.order) else (child, node)
    farthest, nearest = depth // 2, least - depth
    order, classes = large.order, large.classes
    for own, positions in small.classes.items():
        for x in positions:
            at = bisect_left(order, x - farthest)
            if at < len(order) and order[at] < x and left[order[at]] != own:
                partners = classes[left[order[at]]]
                for y in partners[bisect_left(partners, x - farthest):bisect_left(partners, x)]:
                    note(y, x - y, depth, nearest, found)
            at = bisect_right(order, x)
            if at < len(order) and order[at] <= x + farthest and left[order[at]] != own:
                partners = classes[left[order[at]]]
                for y in partners[bisect_right(partners, x):bisect_right(partners, x + farthest)]:
                    note(x, y - x, depth, nearest, found)
    for own, positions in small.classes.items():
        if own in classes:
            merge(classes[own], positions)
        else:
            classes[own] = positions
    merge(order, small.order)
    node.order, node.classes = order, classes


def note(start: int, distance: int, depth: int, nearest: int, found: dict[tuple[int, int], int]) -> None:
    """Keeps the shortest distance of each span that is long enough."""
    if distance >= nearest:
        span = (start, start + distance + depth)
        if distance < found.get(span, distance + 1):
            found[span] = distance


def runs_of_suffixes(
    suffixes: list[int], common: list[int], left: list[int], least: int = MIN_LENGTH
) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) by start and period, from suffixes in order and what each shares with the one before.

    ``common`` is 0 where two neighbours share too little to matter. The stack holds the open intervals, the deepest
    on top; ``last`` is the child that was finished last and waits for the interval around it.
    """
    found: dict[tuple[int, int], int] = {}
    stack: list[Interval] = []
    last = None
    for position, shared in zip([*suffixes, 0], [*common, 0], strict=True):
        while stack and stack[-1].depth > shared:
            node = stack.pop()
            join_child(node, last, left, least, found)
            last = node
        if shared:
            if stack and stack[-1].depth == shared:
                join_child(stack[-1], last, left, least, found)
            else:
                stack.append(Interval(shared, last.order, last.classes))
        last = Interval(0, [position], {left[position]: [position]})
    return sorted((start, end - start, period) for (start, end), period in found.items())


def repeated_suffixes(codes: np.ndarray, text_of: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions whose first ``depth`` words stand elsewhere in the same text too, suffixes in order.

    For a depth between two powers of two, those that share as many words as the lower one stay too.

    Prefix doubling: a suffix's rank by twice as many words is that by its first and by its second half. A rank
    is the number of smaller suffixes, so a suffix whose rank no other has is settled and is not sorted again.
    """
    count = len(codes)
    key = text_of * (int(codes.max()) + 1) + codes
    active, rank = np.arange(count), np.zeros(count, dtype=np.int64)
    order, kept, width, base = np.argsort(key, kind="stable"), None, 1, np.zeros(count, dtype=np.int64)
    while len(active):
        active, values = active[order], key[order]
        fresh = np.ones(len(active), dtype=bool)
        fresh[1:] = values[1:] != values[:-1]
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(active)))
        group = np.cumsum(fresh) - 1
        # Those of one earlier rank stand together: a new rank is the old one plus the place among them.
        old = base[order]
        opens = np.ones(len(active), dtype=bool)
        opens[1:] = old[1:] != old[:-1]
        place = np.arange(len(active))
        before = np.maximum.accumulate(np.where(opens, place, 0))
        rank[active] = old + first[group] - before
        active = active[size[group] > 1]
        if kept is None and 2 * width > depth:
            kept = np.sort(active)
        if not len(active):
            break
        second = active + width
        base = rank[active]
        key = base * (count + 1) + np.where(second < ends[text_of[active]], rank[np.minimum(second, count - 1)] + 1, 0)
        order, width = np.argsort(key, kind="stable"), width * 2
    if kept is None:
        return np.empty(0, dtype=np.int64)
    return kept[np.argsort(rank[kept])]


def shared_words(suffixes: list[int], codes: list[int], depth: int) -> list[int]:
    """Words of one text that each suffix has in common with the one before it in order; 0 if fewer than ``depth``.

    Walked in text order, where a suffix shares at most one word less than the suffix one word earlier did. That
    holds for neighbours among all suffixes, so it is used only as long as ``depth`` words are certain: then both
    neighbours are among those given.
    """
    place = {position: at for at, position in enumerate(suffixes)}
    common = [0] * len(suffixes)
    known, previous, end = 0, -2, len(codes)
    for position in sorted(suffixes):
        known = known - 1 if position == previous + 1 and known > depth else 0
        previous, at = position, place[position]
        if not at:
            known = 0
            continue
        other = suffixes[at - 1]
        room = end - max(position, other)
        while known < room and codes[position + known] == codes[other + known]:
            known += 1
        if known >= depth:
            common[at] = known
    return common


def runs_of_texts(codes: np.ndarray, ends: np.ndarray, least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts whose words stand one after the other; ``ends`` are the places of their ends."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    sizes = np.diff(ends, prepend=0)
    if not sizes.sum():
        return runs
    text_of = np.repeat(np.arange(len(ends)), sizes)
    depth = least - least // MIN_PERIODS
    suffixes = repeated_suffixes(codes, text_of, ends, depth)
    if not len(suffixes):
        return runs
    holder = text_of[suffixes]
    begins = np.concatenate([[0], ends[:-1]])
    for text in np.unique(holder):
        start, end = int(begins[text]), int(ends[text])
        own = codes[start:end].tolist()
        mine = (suffixes[holder == text] - start).tolist() if len(ends) > 1 else suffixes.tolist()
        common = shared_words(mine, own, depth)
        runs[text] = runs_of_suffixes(mine, common, [-1, *own], least)
    return runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the runs and those of each run's first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    stays = np.cumsum(change[:-1]) == 0
    return b" ".join([words[at] for at in np.flatnonzero(stays)])


def _find(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), SORT_BYTES):
                words = [text.split() for text in texts.cast(pa.large_binary()).to_pylist()]
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = number.__len__  # a new word's number is how many were seen before
                codes = np.array([number[word] for text in words for word in text], dtype=np.int64)
                ends = np.cumsum([len(text) for text in words])
                runs = runs_of_texts(codes, ends, least)
                named = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(text) for text in words], pa.int64()),
                        pa.array(named, _RUNS),
                        pa.array([collapsed(*pair) for pair in zip(words, runs, strict=True)], pa.binary())
                        .cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH
) -> DataFrame:
    """All periodic runs of every text: doc_id, n_words, runs (start, length, period), collapsed.

    Words lie between white space; a run is a stretch that repeats its first ``period`` words at least three times,
    is at least ``min_length`` words long and cannot be extended. Runs are listed by start, then period, and may
    overlap. ``collapsed`` keeps the first period of each run and all that lies outside, with single spaces.

    Null and empty texts, and those of white space alone, have no words, no runs and an empty ``collapsed``. Repeated
    rows are searched each by itself, an empty table gives no rows, other columns, whatever their names, are not
    looked at. No row is exchanged. A text of any length is searched whole, by one task, in memory linear in its
    words; shorter ones are sorted together in slices of a megabyte.
    """
    if min_length < MIN_PERIODS:
        raise ValueError(f"a run of {MIN_PERIODS} periods has at least {MIN_PERIODS} words")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_find(min_length), _FOUND.format(kind))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equals the earliest, then the shortest period."""
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))),
        F.get(runs, 0),
        lambda best, run: F.when(
            run["length"] * best["period"] > best["length"] * run["period"], run
        ).otherwise(best),
    )


def listing(runs: Column) -> Column:
    """One line ``start,length,period`` for each run."""
    return F.array_join(
        F.transform(runs, lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])), "\n"
    )
