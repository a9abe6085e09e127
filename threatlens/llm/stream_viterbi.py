"""SentencePiece-style encoding by a streaming Viterbi search over a given model's pieces, and decoding."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_column
from .tokens import slices
from .words import Memo

#: The mark that stands for a space at the start of a piece.
SPACE = "▁"
#: Words kept in memory, twice, and the length up to which a word is kept.
MEMORY, KEPT = 200_000, 48
#: Log probability of a byte piece relative to the rarest piece.
BYTE_COST = 4.0
#: Signs before which words may be cut, if the pieces allow it.
SIGNS = ".,;:!?%*$&#|"
#: Documents that are decoded at once.
DECODED = 512
#: Marks a word that no space stands before.
BARE = "\x01"


class Pieces:
    """The pieces of a SentencePiece model with a log probability each.

    The model's file orders pieces by the merge that made them and gives no probabilities; a piece's is taken
    from its place by Zipf's law. Characters without a piece become byte pieces.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.scores: dict[str, tuple[float, int]] = {}
        self.raw: list[bytes] = []
        self.byte_ids = [0] * 256
        size = model.get_piece_size()
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.raw.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.scores[piece] = (-math.log(i + 2), i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.scores), default=1)
        self.byte_score = -math.log(size + 2) - BYTE_COST
        crossing = re.compile(f"[^{SPACE}]{SPACE}|.\n|\n.", re.DOTALL)
        #: No piece goes on over the start of a word, so each word is a stretch of its own.
        self.words_apart = not any(crossing.search(p) for p in self.scores)
        #: Signs that no piece has after a letter: a word can be cut before them.
        joined = {b for p in self.scores for a, b in itertools.pairwise(p) if a.isalpha()}
        self.cuts = "".join(sorted(set(SIGNS) - joined))


class Viterbi:
    """The best segmentation of a character stream, committed as soon as it is certain.

    Only the last ``longest`` places can be a piece's start, so the window holds as many scores. When the
    paths of all places in the window go through one boundary, everything before it is final: its ids are
    handed out and the window begins there.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # what is not committed
        self.best = [0.0]  # score of the best path to each place of it
        self.back: list[tuple[int, tuple[int, ...]]] = [(0, ())]  # its last piece: start and ids
        self.ids: list[int] = []

    def feed(self, text: str) -> list[int]:
        """Ids that are certain after these characters."""
        for first in range(0, len(text), 4 * self.pieces.longest):
            self.extend(text[first : first + 4 * self.pieces.longest])
            self._commit()
        out, self.ids = self.ids, []
        return out

    def finish(self) -> list[int]:
        """The remaining ids; the stream can begin anew."""
        out = self._path(len(self.text))
        self.text, self.best, self.back = "", [0.0], [(0, ())]
        return out

    def extend(self, more: str) -> None:
        scores, longest, best, back = self.pieces.scores, self.pieces.longest, self.best, self.back
        first = len(self.text)
        text = self.text = self.text + more
        for end in range(first + 1, len(text) + 1):
            top, chosen = -math.inf, None
            for start in range(end - 1, max(end - longest, 0) - 1, -1):
                found = scores.get(text[start:end])
                if found is not None and best[start] + found[0] > top:
                    top, chosen = best[start] + found[0], (start, (found[1],))
            if text[end - 1] not in scores:  # bytes are for characters without a piece
                data = text[end - 1].encode()
                score = best[end - 1] + self.pieces.byte_score * len(data)
                if score > top:
                    top, chosen = score, (end - 1, tuple(self.pieces.byte_ids[b] for b in data))
            best.append(top)
            back.append(chosen)

    def _path(self, end: int) -> list[int]:
        parts = []
        while end:
            end, ids = self.back[end]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def _commit(self) -> None:
        end = len(self.text)
        alive = {*range(max(end - self.pieces.longest + 1, 0), end + 1)}
        while len(alive) > 1:  # the later places step back until all paths have met
            late = max(alive)
            alive.remove(late)
            alive.add(self.back[late][0])
        (meet,) = alive
        if meet:
            self.ids += self._path(meet)
            self.text = self.text[meet:]
            base = self.best[meet]
            self.best = [b - base for b in self.best[meet:]]
            self.back = [(0, ()), *((start - meet, ids) for start, ids in self.back[meet + 1 :])]


class Encoder:
    """Whole texts to ids and back; words seen before are taken from memory."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.memo = Memo(self._stretch, MEMORY)
        self.words = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+").findall if pieces.words_apart else lambda t: [t]
        sizes = np.array([len(r) for r in pieces.raw], dtype=np.int64)
        self.sizes, self.places = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(pieces.raw), dtype=np.uint8)

    def _stretch(self, text: str) -> bytes:
        search = Viterbi(self.pieces)
        if len(text) <= KEPT:  # a window's worth: nothing to commit early
            search.extend(text)
            return array("i", search.finish()).tobytes()
        return array("i", search.feed(text) + search.finish()).tobytes()

    def _part(self, text: str) -> bytes:
        if len(text) <= KEPT:
            return self.memo[text]
        return self._stretch(text)

    def encode(self, text: str) -> bytes:
        """Little-endian int32 ids; a space mark in the text itself becomes bytes, so decoding is exact."""
        if not text:
            return b""
        mark = array("i", [self.pieces.byte_ids[b] for b in SPACE.encode()]).tobytes()
        first, *rest = text.split(SPACE)
        parts = [f" {first}", *rest]
        return mark.join([b"".join(map(self._part, self.words(p.replace(" ", SPACE)))) for p in parts])

    def encode_all(self, texts: pa.StringArray) -> list[bytes]:
        """``encode`` of each text; the distinct words of plain texts are found by Arrow."""
        odd = pc.match_substring_regex(texts, f"^ |  |{BARE}|{SPACE}|^$").to_numpy(zero_copy_only=False)
        if not self.pieces.words_apart or odd.all():
            return [self.encode(t) for t in texts.to_pylist()]
        plain = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", f" {BARE}\n {BARE}")
        if self.pieces.cuts:
            signs = re.escape(self.pieces.cuts)
            plain = pc.replace_substring_regex(plain, rf"(\p{{L}})([{signs}])", rf"\1 {BARE}\2")
        cut = pc.split_pattern(pc.binary_join_element_wise("", plain, " "), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        words = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        codes = words.indices.to_numpy().copy()
        bounds -= bounds[0]
        known = [self._part(w[1:] if w[:1] == BARE else SPACE + w) for w in words.dictionary.to_pylist()]
        codes[bounds[:-1]] = len(known)  # nothing stands before the first space
        known.append(b"")
        sizes = np.array([*map(len, known)], dtype=np.int64) // 4
        ids = _gather(np.frombuffer(b"".join(known), dtype=np.int32), np.cumsum(sizes) - sizes, sizes, codes)
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[bounds]
        found = iter([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return [self.encode(t.as_py()) if o else next(found) for t, o in zip(texts, odd, strict=True)]

    def decode_bytes(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts whose ids lie between the bounds."""
        data = _gather(self.bytes, self.places, self.sizes, ids)
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[bounds]
        return [data[a + 1 : b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0].decode()


def _gather(flat: np.ndarray, places: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that the codes name, one after the other."""
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    at = np.repeat(places[codes] - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat[at]


_ENCODERS: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """The encoder of this worker."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = Encoder(Pieces(model_file))
    return _ENCODERS[model_file]


def _encode(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(model_file)
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                keys = batch.column("doc_id").slice(first, len(texts))
                yield pa.record_batch([keys, list_column(words.encode_all(texts))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every whole text.

    A null or empty text has no ids. Ids are kept as they are, null and repeated ones too. Texts of any length
    are searched within a window of the longest piece. Other columns are not looked at; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(model_file), "doc_id long, ids array<int>")


def _digest(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(model_file)
        for batch in batches:
            ids = batch.column("ids")
            flat, bounds = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            rows = []
            for first in range(0, len(ids), DECODED):
                some = bounds[first : first + DECODED + 1]
                part = flat[some[0] : some[-1]]
                texts = words.decode_bytes(part, some - some[0])
                for a, b, text in zip(some[:-1], some[1:], texts, strict=True):
                    chars = len(text.decode())
                    rows.append((int(b - a), zlib.crc32(flat[a:b].tobytes()), chars, hashlib.sha256(text).hexdigest()))
            columns = [*zip(*rows, strict=True)] or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "decoded_sha256"],
            )

    return run


def decode_digests(tokens: DataFrame, model_file: str) -> DataFrame:
    """Per document: number and crc32 of its ids, and length and SHA-256 of the text that they decode to."""
    return tokens.mapInArrow(
        _digest(model_file), "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, decoded_sha256 string"
    )
