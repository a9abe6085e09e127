"""White-space tokens of Arrow texts as integer codes of their distinct words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once.
SLICE_BYTES = 4 << 20


def slices(texts: pa.StringArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.StringArray]]:
    """(first row, rows) of about ``size`` bytes or one longer text; null is empty."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // size)) + 1
    for first, last in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        if last > first:
            yield int(first), texts.slice(first, last - first)
    pa.default_memory_pool().release_unused()


def coded(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(words per row, place of each word, in order, among the distinct ones, these) for words between runs of
    ASCII white space."""
    cut = pc.ascii_split_whitespace(texts)
    offsets = cut.offsets.to_numpy().astype(np.int64)
    found = cut.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    distinct = found.filter(pa.array(full)).dictionary_encode()
    return np.diff(before[offsets]), distinct.indices.to_numpy(zero_copy_only=False), distinct.dictionary.to_pylist()


def words(texts: pa.StringArray, code: Callable[[str], int], dtype) -> tuple[np.ndarray, np.ndarray]:
    """(words per row, code of each word in order) for words between runs of ASCII white space."""
    counts, places, distinct = coded(texts)
    codes = np.array([code(word) for word in distinct], dtype=dtype)
    return counts, codes[places] if len(codes) else np.zeros(0, dtype)
