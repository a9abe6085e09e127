"""Whole-text BPE ids through the tokenizers library, with a bounded memory of words seen before.

A BPE vocabulary cuts a text into words first and merges within a word only, so a word's ids do not
depend on its neighbours. The distinct words of a batch are found by Arrow, the library is asked once
per word and task, and the ids are gathered by index. A text with characters for which that cut is not
plainly at the spaces goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import slices

#: Words kept in memory, twice: the recent ones and those before them.
MEMORY = 100_000
#: Characters per word on average up to which so many are kept; of longer words fewer.
WORD_CHARS = 16
#: Bytes of text that are cut and gathered at once.
CUT_BYTES = 2 << 20
#: Control characters, exotic white space, combining marks, a capital whose small form holds such a mark,
#: and what opens a special token.
_ODD = (
    r"[\x00-\x08\x0b-\x1f\x7f-\xa0\x{0300}-\x{036f}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}"
    r"\x{205f}-\x{206f}\x{3000}\x{feff}\x{0130}]|<[|]"
)
#: White space other than single spaces and single line ends within the text.
_GAPS = r"^\s|\s$|\s\s|\t"
#: Signs at which the library cuts a word in two, whatever stands before them.
_SIGNS = r"[.,;:!?%*$&#|()_=+/@~^-]"
#: Marks a word that no space stands before.
_BARE = "\x01"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PLAIN_SIGNS = re.compile(f"{_SIGNS}+|\n")
_TOKENIZERS: dict[str, object] = {}
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def tokenizer(path: str):
    """The library's tokenizer; one per worker."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def encoder(path: str, memory: int = MEMORY) -> WordEncoder:
    """The encoder of this worker; its memory of words outlives the task."""
    if (path, memory) not in _ENCODERS:
        _ENCODERS[path, memory] = WordEncoder(path, memory)
    return _ENCODERS[path, memory]


class Memo(dict):
    """Word to the bytes of its ids; recent words in self, older ones in ``old`` until they are used."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old, self.chars = make, limit, {}, 0

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.limit or self.chars >= self.limit * WORD_CHARS:
            self.old, self.chars = dict(self), 0
            self.clear()
        self[word] = ids
        self.chars += len(word)
        return ids


class WordEncoder:
    """Ids equal to the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.tok = tokenizer(path)
        self.model = self.tok.model
        self.spaced = self.tok.normalizer is None  # byte level: a space belongs to the word after it
        self.table = str.maketrans({chr(b): _byte_char(b) for b in range(256)})
        self.memo = Memo(self._spaced_word if self.spaced else self._word, memory)

    def encode(self, texts: pa.StringArray, size: int = CUT_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, lengths, ids) for slices of the rows; lengths has one entry per row, null is empty."""
        for first, rows in slices(texts, size):
            yield first, *self._slice(rows)

    def _slice(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD if not self.spaced else f"{_ODD}|{_GAPS}")
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts)
        usual = self._plain(texts.filter(pa.array(~odd)))
        bounds = np.cumsum(usual[0])[:-1]
        usual_rows = iter(np.split(usual[1], bounds) if len(usual[0]) else [])
        rows = [
            np.array(self.tok.encode(text.as_py(), add_special_tokens=False).ids, dtype=np.int32)
            if is_odd else next(usual_rows)
            for text, is_odd in zip(texts, odd, strict=True)
        ]
        return np.array([len(r) for r in rows], dtype=np.int64), np.concatenate(rows)

    def _words(self, texts: pa.StringArray) -> pa.ListArray:
        """The words of each text, with signs and line ends cut off."""
        if self.spaced:
            texts = pc.replace_substring_regex(texts, rf"(\p{{L}})({_SIGNS})", rf"\1 {_BARE}\2")
            texts = pc.replace_substring(texts, "\n", f" {_BARE}\n {_BARE}")
            return pc.split_pattern(pc.binary_join_element_wise(_BARE, texts, ""), " ")
        return pc.ascii_split_whitespace(pc.replace_substring_regex(texts, rf"(\p{{L}})({_SIGNS})", r"\1 \2"))

    def _plain(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        cut = self._words(texts)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        words = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        codes = words.indices.to_numpy()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        known = [*map(self.memo.__getitem__, distinct)]
        sizes = np.array([*map(len, known)], dtype=np.int64) // 4
        places = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(known), dtype=np.int32)
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(places[codes] - ends[:-1], lengths)
        at += np.arange(ends[-1])
        return np.diff(ends[bounds - bounds[0]]), flat[at]

    def _spaced_word(self, word: str) -> bytes:
        return self._word(word[1:], "") if word[:1] == _BARE else self._word(word, " ")

    def _word(self, word: str, before: str = "") -> bytes:
        if _LETTERS.fullmatch(word):
            piece = before + (word if self.spaced else word.lower())
        elif _PLAIN_SIGNS.fullmatch(word):
            piece = before + word
        else:
            return array("i", self.tok.encode(before + word, add_special_tokens=False).ids).tobytes()
        piece = piece.encode().decode("latin-1").translate(self.table)
        return array("i", [t.id for t in self.model.tokenize(piece)]).tobytes()


def _byte_char(byte: int) -> str:
    """Byte-level alphabets show printable bytes as themselves and shift the others past 255, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    if byte in shown:
        return chr(byte)
    return chr(256 + [b for b in range(256) if b not in shown].index(byte))
