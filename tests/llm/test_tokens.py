import glob
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatlens.llm import cost_packing, token_files, words
from threatlens.llm.queries import op8_packing, tokenizer_path
from threatlens.llm.words import WordEncoder, tokenizer
from threatlens.session import fresh_folder

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids int, part string, start string, sequence_id string"
ROWS = [
    (3, "Some words, and more.", 1, "", "", ""), (1, None, 1, "", "", ""), (2, "", 1, "", "", ""), (None, "no id", 1, "", "", ""),
    (5, "twice", 1, "", "", ""), (5, "twice", 1, "", "", ""), (5, "twice other", 1, "", "", ""), (4, "long text é " * 20_000, 1, "", "", ""),
    (9, "a<|endoftext|>b  c\n\n d e", 1, "", "", ""),
]


def library(name, text):
    return tokenizer(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


ODD = st.text(alphabet="abS'.,!19é ß\n\t<|>日€İΣς́‍　\x1f\x01\x85endoftx", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(ODD | st.text(max_size=20), min_size=1, max_size=12))
@pytest.mark.parametrize("name", NAMES)
def test_ids_are_the_librarys(name, texts):
    encoder = WordEncoder(tokenizer_path(name), memory=50)
    got = [ids.tolist() for _, sizes, flat in encoder.encode(pa.array(texts)) for ids in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [library(name, t) for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_documents(spark, name):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [ids.tolist() for _, sizes, flat in WordEncoder(tokenizer_path(name)).encode(pa.array(texts)) for ids in np.split(flat, np.cumsum(sizes)[:-1])]
    assert got == [library(name, t) for t in texts]


def test_token_files(spark):
    docs, folder = spark.createDataFrame(ROWS, SCHEMA).repartition(3), fresh_folder(spark, "tokens-test")
    token_files.write_tokens(docs, folder, tokenizer_path(NAMES[0]), end_id=2)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 5, 9]
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        assert r.ids in [[*library(NAMES[0], t), 2] for i, t, *_ in ROWS if i == r.doc_id]
        start += r.n_tokens
    assert [tuple(r) for r in token_files.read_metadata(spark, folder).orderBy("start").collect()] == [(r.doc_id, r.start, r.n_tokens) for r in got]
    part = token_files.read_tokens(spark, folder, F.col("doc_id") == 4).collect()
    assert [(r.doc_id, r.start, r.ids) for r in part] == [(r.doc_id, r.start, r.ids) for r in got if r.doc_id == 4]
    sums = {(r.start): r.ids_crc32 for r in token_files.digests(token_files.read_tokens(spark, folder)).collect()}
    assert sums == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}


def test_the_library_is_asked_once_for_many_words(monkeypatch):
    """More words than one memory of 100,000 and the one before it hold, seen three times by a task."""
    asked = []
    monkeypatch.setattr(WordEncoder, "_word", lambda self, word, before="": asked.append(word) or b"\1\0\0\0")
    monkeypatch.setattr(words, "_ENCODERS", {})
    monkeypatch.setattr(token_files, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": lambda: 0}))
    texts = [" ".join(f"w{i}" for i in range(first, first + 1000)) for first in range(0, 350_000, 1000)] * 3
    batches = [pa.record_batch([pa.array(range(k, k + 35)), pa.array(texts[k : k + 35])], names=["doc_id", "text"]) for k in range(0, len(texts), 35)]
    out = list(token_files._encode(tokenizer_path(NAMES[0]), 2, "doc_id", "text")(iter(batches)))
    assert sum(b.num_rows for b in out) == len(texts) and {n for b in out for n in b.column("n_tokens").to_pylist()} == {1001}
    assert len(asked) == len(set(asked)) == 350_000


def test_packing_asks_the_library_once_for_many_words(spark, monkeypatch):
    """The registered query's scan function, given the same 350,000 words three times."""
    made, real = [], cost_packing._pack
    monkeypatch.setattr(cost_packing, "_pack", lambda *a: made.append(real(*a)) or made[-1])
    op8_packing(spark, "/root/testdata/sf0.001")
    asked = []
    monkeypatch.setattr(WordEncoder, "_word", lambda self, word, before="": asked.append(word) or b"\1\0\0\0")
    monkeypatch.setattr(words, "_ENCODERS", {})
    monkeypatch.setattr(cost_packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": lambda: 0}))
    texts = [" ".join(f"w{i}" for i in range(first, first + 1000)) for first in range(0, 350_000, 1000)] * 3
    batches = [pa.record_batch([pa.array(range(k, k + 35)), pa.array(texts[k : k + 35])], names=["doc_id", "text"]) for k in range(0, len(texts), 35)]
    out = pa.Table.from_batches(made[0](iter(batches)))
    assert sum(out.column("length").to_pylist()) == 1001 * len(texts) and set(out.column("doc_tokens").to_pylist()) == {1001}
    assert len(asked) == len(set(asked)) == 350_000


def test_long_words_are_kept_in_smaller_number():
    memo = words.Memo(lambda word: b"", 100)
    for i in range(1000):
        assert memo[f"{i:0200d}"] == b""
    assert sum(map(len, memo)) + sum(map(len, memo.old)) <= 2 * (100 * words.WORD_CHARS + 200)


def test_layout(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    folder = fresh_folder(spark, "tokens-layout")
    token_files.write_tokens(docs.coalesce(1), folder, tokenizer_path(NAMES[0]), 2, layout={"parquet.block.size": "20000", "parquet.page.size": "4096"})
    chunks = [pq.ParquetFile(f).metadata.row_group(g).column(c) for f in glob.glob(folder.removeprefix("file://") + "/*.parquet")
              for g in range(pq.ParquetFile(f).metadata.num_row_groups) for c in (0, 4)]
    assert len(chunks) > 4
    assert all(c.has_offset_index and c.has_column_index for c in chunks)
    assert any("DICTIONARY" in e for c in chunks for e in c.encodings)


def test_empty_tables(spark):
    empty, folder = spark.createDataFrame([], SCHEMA), fresh_folder(spark, "tokens-none")
    token_files.write_tokens(empty, folder, tokenizer_path(NAMES[0]), 2)
    assert token_files.read_tokens(spark, folder).count() == 0
    assert cost_packing.pack(empty, tokenizer_path(NAMES[1]), 0).count() == 0


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    pieces = cost_packing.pack(docs, tokenizer_path(NAMES[1]), 0, capacity=64, window_tokens=200, with_ids=True).collect()
    check_packed(pieces, 64)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: p.start):
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        by_doc.setdefault(p.doc_id, []).append(p)
    for key in (1, 2, 3, 4, 9, None):
        ids = [i for p in by_doc[key] for i in p.ids]
        assert ids == [*library(NAMES[1], next(t for i, t, *_ in ROWS if i == key)), 0]
        assert {p.doc_tokens for p in by_doc[key]} == {len(ids)}
    assert sum(p.length for p in by_doc[5]) == sum(len(library(NAMES[1], t)) + 1 for i, t, *_ in ROWS if i == 5)


def check_packed(pieces, capacity):
    """Sequences are gapless, within the capacity, and need no padding."""
    rows = {}
    for p in pieces:
        rows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in rows.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= capacity and end & (end - 1) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=60))
def test_balance(lengths):
    pieces, sequences = cost_packing.balance(np.array(lengths), 64, 1.0, 1 / 64)
    covered = {}
    for item, start, length, at in pieces:
        covered.setdefault(item, []).append((start, length))
        assert 0 <= at < sequences
    for item, parts in covered.items():
        assert sum(n for _, n in parts) == lengths[item]
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
    assert len(covered) == len(lengths)


def test_costs_are_closer_than_in_order():
    lengths = np.random.default_rng(0).integers(1, 400, 2000)
    pieces, sequences = cost_packing.balance(lengths, 1024, 1.0, 1 / 1024)
    cost = np.zeros(sequences)
    for _, _, n, at in pieces:
        cost[at] += n + n * n / 1024
    full = cost[: int(lengths.sum()) // 1024]
    edges = np.cumsum(lengths)
    plain = np.bincount((edges - 1) // 1024, lengths + lengths**2 / 1024)
    assert full.std() < 0.5 * plain[:-1].std()


@pytest.mark.parametrize("window", [1, 64, 200, 1 << 20])
def test_only_the_last_window_ends_in_short_sequences(window):
    draw = np.random.default_rng(5)
    texts = [np.arange(n, dtype=np.int32) + 1000 * i for i, n in enumerate(draw.integers(1, 200, 120))]
    packer = cost_packing._Packer(0, 64, 1.0, 1 / 64, window, True)
    for key, ids in enumerate(texts):
        packer.add(key, ids.tobytes())
    packer.pack(last=True)
    found, room = {}, {}
    for key, start, length, _, total, sequence, offset, data, *_ in packer.out:
        found.setdefault(key, []).append((start, np.frombuffer(data, dtype=np.int32)))
        room.setdefault(sequence, []).append((offset, length))
        assert total == len(texts[key])
    for key, ids in enumerate(texts):
        assert (np.concatenate([d for _, d in sorted(found[key], key=lambda x: x[0])]) == ids).all()
    for pieces in room.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:]))
    sizes = sorted(sum(n for _, n in p) for p in room.values())
    rest = sum(map(len, texts)) % 64
    assert sizes == sorted([64] * (sum(map(len, texts)) // 64) + [1 << b for b in range(6) if rest >> b & 1])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_few_short_sequences_whatever_the_partitions(spark, parts):
    """Short sequences make up one rest of the whole table, as long as one task joins the rests."""
    words = [" ".join(f"w{i * j % 97}" for j in range(1 + i * 37 % 150)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(words)], "doc_id long, text string, ids string, task string")
    pieces = cost_packing.pack(docs.repartition(parts), tokenizer_path(NAMES[1]), 0, capacity=64, with_ids=True).collect()
    check_packed(pieces, 64)
    ids = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(ids.setdefault(p.doc_id, [])) and p.length == len(p.ids)
        ids[p.doc_id] += p.ids
    assert ids == {i: [*library(NAMES[1], t), 0] for i, t in enumerate(words)}
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    rest = sum(sizes.values()) % 64
    assert sorted(n for n in sizes.values() if n < 64) == [1 << b for b in range(6) if rest >> b & 1]
