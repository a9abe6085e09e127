import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threatlens.llm import kneser_ney
from threatlens.session import fresh_folder

SCHEMA = "doc_id long, text string, score string, n_tokens int, shard int"


def discounts(kinds):
    """Modified Kneser-Ney: k - (k + 1) Y n[k + 1] / n[k], Y = n1 / (n1 + 2 n2); Y, or a half, where a count is missing."""
    n1, n2, n3, n4 = kinds
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 and n2 else y
    d2 = 2 - 3 * y * n3 / n2 if n2 and n3 else y
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else y
    return [min(max(d, 0.01), most) for d, most in ((d1, 0.99), (d2, 1.99), (d3, 2.99))]


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + [None]


def brute(rows):
    """doc_id and text to (held, n_tokens, n_known, N, base, score) with plain dictionaries."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    lists = [tokens(t) for _, t in rows]
    train = [x for x, h in zip(lists, held, strict=True) if not h]
    words = Counter(w for x in train for w in x)
    pairs = Counter(p for x in train for p in zip([0, *x[:-1]], x, strict=True))
    n, v = sum(words.values()), len(words)
    lefts = Counter(b for _, b in pairs)

    def kinds(values):
        c = Counter(values)
        return [c[k] for k in range(1, 5)]

    d2, d1 = discounts(kinds(pairs.values())), discounts(kinds(lefts.values()))

    def less(d, c):
        return d[min(c, 3) - 1]

    mass = sum(less(d1, c) for c in lefts.values()) / len(pairs) if pairs else 1.0
    total, spare = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        spare[a] += less(d2, c)

    def prob(a, b):
        low = (lefts[b] - less(d1, lefts[b]) if lefts[b] else 0) / max(len(pairs), 1) + mass / (v + 1)
        if not total[a]:
            return low
        c = pairs[a, b]
        return ((c - less(d2, c)) if c else 0) / total[a] + spare[a] / total[a] * low

    out = []
    for (i, _), x, h in zip(rows, lists, held, strict=True):
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        score = sum(math.log10(prob(a, b)) for a, b in zip([0, *x[:-1]], x, strict=True))
        out.append((i, h, len(x), sum(words[w] > 0 for w in x), n, base, score))
    return out, prob, words


def rounded(rows):
    return sorted(((str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6)) for r in rows), key=str)


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "", 1, 1) for i, t in rows], SCHEMA).repartition(parts)
    got = kneser_ney.score_texts(docs, order=2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return [tuple(r) for r in got.collect()]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rounded(run(spark, rows)) == rounded(brute(rows)[0])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "The the THE é É"), (3, "The the THE é É"), (None, "a b\x1fc\x0bd"), (4, "w x " * 50_000), (6, "unseen words"), (7, " lead trail \n")]
    assert rounded(run(spark, rows)) == rounded(brute(rows)[0])


def test_hot_words_are_dealt_by_both_words(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "HOT", 20)
    rows = [(i, " ".join(f"the w{i * j % 37} the v{i + j}" for j in range(20))) for i in range(60)]
    assert rounded(run(spark, rows)) == rounded(brute(rows)[0])


def test_no_training_rows(spark):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(held, "a b c")]
    assert rounded(run(spark, rows)) == rounded(brute(rows)[0])
    assert run(spark, rows)[0][-1] == pytest.approx(0.0)
    empty = spark.createDataFrame([], SCHEMA)
    assert kneser_ney.score_texts(empty).count() == 0


def test_probabilities_add_up_to_one(spark):
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(12))) for i in range(30)]
    _, prob, words = brute(rows)
    for left in [0, *list(words)[:5]]:
        assert sum(prob(left, w) for w in words) + prob(left, "never seen") == pytest.approx(1)
    docs = spark.createDataFrame([(t,) for _, t in rows], "text string")
    model, hot = kneser_ney.train(docs, fresh_folder(spark, "kn-test"), order=2)
    known = np.array([kneser_ney._hash(f"w{k}") for k in range(11)] + [int(kneser_ney.END), 12345], dtype=np.uint64)
    for left in (kneser_ney.BEGIN, known[3], np.uint64(99)):
        score, _, _ = model.log10(np.full(len(known), left), known, hot)
        assert (10**score).sum() == pytest.approx(1)
    assert docs.select(F.length("text")).count() == 30


def brute_scores(rows, order):
    """Scores of texts by the recursion over n-grams as tuples of words."""
    lists = [[0] * (order - 1) + tokens(t) for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    grams = [[tuple(x[k : k + order]) for k in range(len(x) - order + 1)] for x in lists]
    counts = {order: Counter(g for x, h in zip(grams, held, strict=True) if not h for g in x)}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    words = len(counts[1])
    by = {n: discounts([Counter(c.values())[k] for k in range(1, 5)]) for n, c in counts.items()}

    def prob(g):
        if not g:
            return 1 / (words + 1)
        n, low = len(g), prob(g[1:])
        after = totals[n].get(g[:-1])
        if not after:
            return low
        c = counts[n][g]
        return ((c - by[n][min(c, 3) - 1] if c else 0) + after[1] * low) / after[0]

    totals = {n: {} for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            total, spare = totals[n].get(g[:-1], (0, 0.0))
            totals[n][g[:-1]] = (total + k, spare + by[n][min(k, 3) - 1])
    return [sum(math.log10(prob(g)) for g in x) for x in grams], prob, counts


@pytest.mark.parametrize("order", [3, 4])
def test_longer_contexts(spark, monkeypatch, order):
    monkeypatch.setattr(kneser_ney, "HOT", 20)
    rows = [(i, " ".join(f"the w{i * j % 7} of v{(i + j) % 5}" for j in range(i % 9))) for i in range(60)] + [(None, None), (60, "unseen the w1")]
    docs = spark.createDataFrame([(i, t, "", 1, 1) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in kneser_ney.score_texts(docs, order=order).collect())
    want, prob, counts = brute_scores(rows, order)
    assert got == sorted((str(i), round(s, 6)) for (i, _), s in zip(rows, want, strict=True))
    for left in [g[:-1] for g in list(counts[order])[:5]] + [("the",) * (order - 1)]:
        assert sum(prob((*left, w)) for (w,) in counts[1]) + prob((*left, "never seen")) == pytest.approx(1)


def test_query_uses_two_words_of_context(spark, tmp_path):
    from threatlens.llm import queries

    rows = [(i, f"{a} b {c}") for i, (a, c) in enumerate([("p", "x"), ("q", "y")] * 40)] + [(80, "p b x"), (81, "p b y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.score for r in queries.op10_kneser_ney(spark, str(tmp_path)).collect()}
    assert scores[80] > scores[81] + 1


def test_a_missing_shard_is_an_error(spark):
    """Gone arrays would make their words unseen; files that were never written are empty shards."""
    import os

    docs = spark.createDataFrame([(i, "a b c d a b c e") for i in range(20)], "doc_id long, text string")
    folder = fresh_folder(spark, "kn-gone")
    model, hot = kneser_ney.train(docs, folder)
    assert model.order == kneser_ney.ORDER == 3
    rows = pa.record_batch([pa.array([1]), pa.array(["a b c"])], names=["doc_id", "text"])

    class Sent:
        value = hot

    assert len(list(kneser_ney._score(model, Sent)(iter([rows])))) == 1
    path = folder.removeprefix("file://")
    for name in os.listdir(path):
        if name.startswith("grams3"):
            os.remove(f"{path}/{name}")
    fresh = kneser_ney.Model(**{k: v for k, v in model.__dict__.items() if k != "files"})
    with pytest.raises(FileNotFoundError):
        list(kneser_ney._score(fresh, Sent)(iter([rows])))


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 40])
def test_packed_rows_come_back(top):
    """Steps within runs, whatever fits into one 64-bit number or does not."""
    draw = np.random.default_rng(top)
    columns = [draw.integers(1, top, 4000, dtype=np.uint64) for _ in range(3)]
    *rows, counts = kneser_ney._counted([c[draw.integers(0, 2000, 4000)] for c in columns])
    assert list(zip(*map(np.ndarray.tolist, rows), strict=True)) == sorted(set(zip(*map(np.ndarray.tolist, rows), strict=True)))
    assert counts.sum() == 4000
    back = kneser_ney._flat(kneser_ney._arrays(kneser_ney._nested(rows, counts)))
    assert all((a == b).all() for a, b in zip(back, [*rows, counts], strict=True))


def test_a_word_that_fills_a_shard_is_hot(spark, monkeypatch):
    """Hot is not a share of the corpus alone: a shard has the same size in a corpus of any size."""
    monkeypatch.setattr(kneser_ney, "HOT", 1)
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 50)
    rows = [(i, " ".join(f"the w{i * j % 37}" for j in range(20))) for i in range(60)]
    docs = spark.createDataFrame([(t,) for _, t in rows], "text string")
    _, hot = kneser_ney.train(docs, fresh_folder(spark, "kn-hot"))
    assert len(hot) > 2
    assert rounded(run(spark, rows)) == rounded(brute(rows)[0])


@pytest.mark.parametrize("widths", [(22, 22, 22), (1, 64, 3), (64, 64), (30, 30, 4, 1), (22,) * 5, (40, 40, 40, 40)])
def test_rows_sort_by_as_few_numbers_as_hold_their_bits(widths):
    """Of three words of 22 bits the third lies in the first number too, so few rows are left to the second."""
    draw = np.random.default_rng(sum(widths))
    full = [draw.integers(0, 1 << w, 40, dtype=np.uint64, endpoint=False) if w < 64 else draw.integers(0, 2**64, 40, dtype=np.uint64) for w in widths]
    for column, width in zip(full, widths, strict=True):
        column[0] = (1 << width) - 1
    columns = [c[draw.integers(0, 40, 3000)] for c in full]
    for column, width in zip(columns, widths, strict=True):
        column[0] = (1 << width) - 1
    assert len(kneser_ney._packed(columns)) == -(-sum(widths) // 64)
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    order, starts = kneser_ney._groups(columns)
    assert [rows[k] for k in order] == sorted(rows) and sorted(order.tolist()) == list(range(3000))
    assert [rows[k] for k in order[starts]] == sorted(set(rows))
    distinct, place = kneser_ney._distinct(columns)
    assert [tuple(c[k] for c in distinct) for k in place] == rows
    assert [len(o) for o in kneser_ney._groups([c[:0] for c in columns])] == [0, 0]


def test_texts_of_ten_megabytes_are_looked_up_at_once(spark):
    docs = spark.createDataFrame([(i, "a b c d a b c e") for i in range(20)], "doc_id long, text string")
    model, hot = kneser_ney.train(docs, fresh_folder(spark, "kn-wide"))
    texts = ["a b c d e f " * 90_000] * 10
    batch = pa.record_batch([pa.array(range(10)), pa.array(texts)], names=["doc_id", "text"])

    class Sent:
        value = hot

    out = list(kneser_ney._score(model, Sent)(iter([batch])))
    assert [b.num_rows for b in out] == [10]
    assert len({s for b in out for s in b.column("score").to_pylist()}) == 1
