import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threatlens.llm import stream_viterbi as sv
from threatlens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def encoder():
    return sv.encoder(tokenizer_path("piece_bpe_32k.model"))


def whole(pieces, text):
    """The best segmentation by a search over the whole text."""
    best, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        top = (-math.inf, None)
        for start in range(end - 1, max(0, end - pieces.longest) - 1, -1):
            found = pieces.scores.get(text[start:end])
            if found and best[start] + found[0] > top[0]:
                top = (best[start] + found[0], (start, [found[1]]))
        if text[end - 1] not in pieces.scores:
            data = text[end - 1].encode()
            score = best[end - 1] + pieces.byte_score * len(data)
            if score > top[0]:
                top = (score, (end - 1, [pieces.byte_ids[b] for b in data]))
        best.append(top[0])
        back.append(top[1])
    out, end = [], len(text)
    while end:
        end, ids = back[end]
        out = ids + out
    return out


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aehnortst ▁\n日é", max_size=120), st.integers(0, 99))
def test_stream_is_the_whole_search(encoder, text, seed):
    draw, search, ids, at = random.Random(seed), sv.Viterbi(encoder.pieces), [], 0
    while at < len(text):
        step = draw.randrange(1, 30)
        ids += search.feed(text[at : at + step])
        at += step
    ids += search.finish()
    assert ids == whole(encoder.pieces, text)


def test_window_is_bounded(encoder):
    search, most = sv.Viterbi(encoder.pieces), 0
    text = "the of and restoration " * 3000
    for at in range(0, len(text), 100):
        search.feed(text[at : at + 100])
        most = max(most, len(search.text))
    assert most < 4 * encoder.pieces.longest


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab ▁\n\t日\x01", max_size=80) | st.text(alphabet="ab \n", max_size=20))
def test_round_trip(encoder, text):
    import numpy as np

    ids = np.frombuffer(encoder.encode(text), dtype=np.int32)
    assert encoder.decode(ids.tolist()) == text
    assert encoder.encode_all(pa.array([text, "plain text\nof lines", text])) == [encoder.encode(t) for t in (text, "plain text\nof lines", text)]
    if "▁" not in text and text:
        assert ids.tolist() == whole(encoder.pieces, " ".join(["", text]).replace(" ", "▁"))


def test_query_shape(spark):
    import hashlib

    model = tokenizer_path("piece_bpe_32k.model")
    rows = [(1, None), (2, ""), (3, "some text"), (3, "some text"), (None, "no id"), (4, "x" * 200_000), (5, " a  b\n")]
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in rows], SCHEMA).repartition(3)
    got = sv.decode_digests(sv.encode(docs, model), model).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted(
        (str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
    )
    assert sv.decode_digests(sv.encode(docs.limit(0), model), model).count() == 0
