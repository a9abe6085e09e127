"""Fill-in-the-middle examples: cut places come from a piecewise-linear learned index over unit boundaries.

The rank index of a text maps a unit's number to the byte at which the unit begins. Straight segments are fitted
to all of its boundaries so that no boundary lies more than ``error`` bytes off its segment; what is left of each
boundary is kept as one signed byte. A cut is one prediction plus one residual, so an index that is stored once
serves any number of seeds and rates without reading the texts' units again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES
from .tokens import slices

#: Marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Farthest that a boundary may lie from its segment, in bytes; a residual is one signed byte.
ERROR = 127
#: Boundaries that a segment is first tried on; four times as many each time that all of them fit.
FIRST_REACH = 256
_INDEX = (
    "text string, n long, segment_rank array<int>, segment_start array<long>, segment_slope array<double>, "
    "residuals array<tinyint>"
)


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[list[int], list[float], np.ndarray]:
    """Segments (first rank, slope), each through its first boundary, and the residual of every boundary.

    A segment takes in boundaries as long as some slope keeps all of them within ``error`` (the cone of
    slopes shrinks with each boundary), and the middle of what is left of the cone becomes its slope.
    """
    ranks, slopes, residuals = [], [], np.empty(len(offsets), dtype=np.int8)
    first = 0
    while first < len(offsets):
        low, high, end, reach = -np.inf, np.inf, first + 1, FIRST_REACH
        while end < len(offsets):
            rise = offsets[end:end + reach] - offsets[first]
            run = np.arange(end - first, end - first + len(rise))
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            outside = lows > highs
            fitting = int(outside.argmax()) if outside.any() else len(rise)
            if fitting:
                low, high = lows[fitting - 1], highs[fitting - 1]
            end += fitting
            if fitting < len(rise):
                break
            reach *= 4
        slope = float(low + high) / 2 if end > first + 1 else 0.0
        guess = offsets[first] + np.floor(slope * np.arange(end - first) + 0.5).astype(np.int64)
        residuals[first:end] = offsets[first:end] - guess
        ranks.append(first)
        slopes.append(slope)
        first = end
    return ranks, slopes, residuals


def boundaries(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all units in UTF-8 bytes of several texts, and the number of units before each text's end.

    A unit is a word with the white space before it; white space at a text's end is a unit of its own.
    ``ends`` are the places at which the texts end.
    """
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    stop = np.zeros(len(data), dtype=bool)
    stop[:-1] = ~space[:-1] & space[1:]
    stop[ends[ends > 0] - 1] = True
    places = np.flatnonzero(stop) + 1
    return places, np.searchsorted(places, ends, side="right")


def _index(error: int):
    def rows(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        raw = texts.cast(pa.large_binary())
        bounds = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
        held = raw.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8)[bounds[0]:bounds[-1]] if held else np.empty(0, np.uint8)
        ends = bounds[1:] - bounds[0]
        places, upto = boundaries(data, ends)
        starts, before = ends - np.diff(bounds), np.concatenate([[0], upto[:-1]])
        found = []
        for start, a, b in zip(starts, before, upto, strict=True):
            offsets = np.concatenate([[0], places[a:b] - start])
            found.append((offsets, *fit(offsets, error)))
        yield pa.record_batch(
            [
                keys, texts, pa.array(upto - before),
                pa.array([ranks for _, ranks, _, _ in found], pa.list_(pa.int32())),
                pa.array([offsets[ranks] for offsets, ranks, _, _ in found], pa.list_(pa.int64())),
                pa.array([slopes for _, _, slopes, _ in found], pa.list_(pa.float64())),
                pa.array([rest for _, _, _, rest in found], pa.list_(pa.int8())),
            ],
            names=["doc_id", "text", "n", "segment_rank", "segment_start", "segment_slope", "residuals"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1), BATCH_BYTES):
                yield from rows(batch.column(0).slice(first, len(texts)), texts)

    return run


def index_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: int = ERROR) -> DataFrame:
    """The rank index of every text: doc_id, text, n (units), the segments and the residuals.

    ``residuals`` has n + 1 entries: the text's begin and the end of each unit. Null texts are empty; empty texts
    have no units and one boundary. Repeated rows are indexed each by itself, an empty table gives no rows, other
    columns, whatever their names, are not looked at. A text of any length is indexed whole, by one task, in
    memory linear in its bytes; texts are read in slices of a few megabytes, so only a longer text takes more.
    """
    if not 0 < error <= ERROR:
        raise ValueError(f"a residual is one signed byte: error must lie within 1 and {ERROR}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_index(error), f"doc_id {kind}, {_INDEX}")


def byte_of(rank: Column) -> Column:
    """The byte before which the units up to ``rank`` end: the segment's prediction, set right by the residual."""
    at = F.size(F.filter("segment_rank", lambda first: first <= rank))
    run = rank - F.element_at("segment_rank", at)
    guess = F.floor(F.element_at("segment_slope", at) * run + F.lit(0.5))
    return F.element_at("segment_start", at) + guess + F.element_at("residuals", (rank + 1).cast("int"))


def draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and decimal id; a null id counts as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut(indexed: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One training example per indexed text: doc_id, n, form, output, prefix_chars, middle_chars.

    Two cuts fall on unit boundaries drawn from (seed, id). Form psm is prefix, suffix, middle; spm is suffix,
    prefix, middle, each after its mark; ``fim_percent`` of the texts are cut, ``spm_percent`` of these as spm.
    Texts that are empty or hold a mark themselves stay plain, so that ``restore`` is exact for every row.
    """
    h1, h2, h3, h4 = draws(seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = (
        F.when((F.col("n") == 0) | marked | (h3 % 100 >= fim_percent), "plain")
        .when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    )
    drawn = indexed.withColumns({
        "form": form, "one": h1 % (F.col("n") + 1), "other": h2 % (F.col("n") + 1), "bytes": F.col("text").cast("binary"),
    })
    placed = drawn.withColumns({"a": byte_of(F.least("one", "other")), "b": byte_of(F.greatest("one", "other"))})

    def part(begin: Column, size: Column) -> Column:
        return F.substring("bytes", (begin + 1).cast("int"), size.cast("int")).cast("string")

    a, b = F.col("a"), F.col("b")
    pieces = placed.withColumns({
        "prefix": part(F.lit(0), a), "middle": part(a, b - a), "suffix": part(b, F.octet_length("text") - b),
    })
    head, tail, mid = F.concat(F.lit(PREFIX), "prefix"), F.concat(F.lit(SUFFIX), "suffix"), F.concat(F.lit(MIDDLE), "middle")
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "spm", F.concat(tail, head, mid)).otherwise(F.concat(head, tail, mid))
    )
    is_cut = F.col("form") != "plain"
    return pieces.select(
        "doc_id", "n", "form", output.alias("output"),
        F.when(is_cut, F.char_length("prefix").cast("long")).alias("prefix_chars"),
        F.when(is_cut, F.char_length("middle").cast("long")).alias("middle_chars"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text an example was made of, from the example and its form alone."""
    marks = {"psm": (PREFIX, SUFFIX), "spm": (SUFFIX, PREFIX)}

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = between(*marks["psm"])
    late, early, mid = between(*marks["spm"])
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(early, mid, late)).otherwise(output)
    )


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50,
    spm_percent: int = 80,
) -> DataFrame:
    """Index and cut in one pass without a shuffle; rows, nulls and other columns as in ``index_units`` and ``cut``."""
    return cut(index_units(docs, id_col, text_col), seed, fim_percent, spm_percent)
