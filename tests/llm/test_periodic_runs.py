import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from threatlens.llm import periodic_runs as runs_of
from threatlens.llm import queries

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, runs int, left string, start long"


def brute(words, least=24):
    """For each period all stretches that keep it; a span's smallest period counts."""
    n, spans = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                spans.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in spans.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts():
    rng = random.Random(3)
    out = [None, "", " \n", "a", "a " * 23, "a " * 24, "a " * 25 + "b", "ab cd " * 12, "ab cd " * 11 + "ab", "a b c d e f g h " * 3]
    out += ["x y " * 11 + "x", "x y " * 12 + "x", "a\x0b" * 30 + "\xa0 " * 30, "é\x85 " * 40]
    period = [f"w{i}" for i in range(40)]
    out += [" ".join(period * 3), " ".join(period * 3)[:-4], " ".join((period * 9)[7:200]), "p q r " * 3000]
    passage = " ".join(f"k{i}" for i in range(20))
    out += [" ".join(f"{passage} x{i}" for i in range(60)), " ".join(f"x{i % 2} {passage}" for i in range(60))]
    for _ in range(60):  # runs within runs, with breaks
        words = []
        while len(words) < rng.choice([30, 120, 400]):
            unit = [rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 5, 13]))]
            if rng.random() < 0.3:
                unit = unit * rng.randint(2, 9) + [rng.choice("abcd")]
            words += (unit * rng.randint(1, 12))[: rng.randint(1, 90)]
        out.append(" ".join(words))
    out.append(" ".join(rng.choices("ab", k=900)))
    return out


@pytest.mark.parametrize("least", [24, 3, 9])
def test_runs_against_brute_force(least):
    words = [WORD.findall(t or "") for t in some_texts()]
    number = {}
    codes = np.array([number.setdefault(w, len(number)) for t in words for w in t])
    found = runs_of.runs_of_texts(codes, np.cumsum([*map(len, words)]), least)
    for own, got in zip(words, found, strict=True):
        if len(own) < 1000:
            assert got == brute(own, least), " ".join(own)


def test_operator(spark):
    given = [*enumerate(some_texts()), (7, "again " * 30), (7, "again " * 30), (None, "no id " * 20)]
    docs = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in given], SCHEMA).repartition(3)
    got = sorted(
        ((r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed)
         for r in runs_of.find_runs(docs).collect()), key=repr)
    want = []
    for key, text in given:
        words = WORD.findall(text or "")
        found = brute(words)
        want.append((key, len(words), found, collapse(words, found)))
    assert got == sorted(want, key=repr)
    assert runs_of.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs_of.find_runs(docs, min_length=2)


def test_long_text_of_one_word_takes_linear_time():
    codes = np.zeros(200_000, dtype=np.int64)
    assert runs_of.runs_of_texts(codes, np.array([200_000])) == [[(0, 200_000, 1)]]
    codes = np.tile(np.arange(1000), 150)
    assert runs_of.runs_of_texts(codes, np.array([150_000])) == [[(0, 150_000, 1000)]]


def test_passage_after_many_different_words_is_not_paired_with_itself():
    """3000 copies of a passage, each after a word of its own: one class each, and nothing periodic."""
    codes = np.concatenate([np.append(np.arange(30), 100 + i) for i in range(3000)])
    assert runs_of.runs_of_texts(codes, np.array([len(codes)])) == [[]]


def test_query_digests(spark, tmp_path):
    rng = random.Random(8)
    given = [(k, " ".join(rng.choices("abcdefgh", k=rng.choice([0, 1, 5, 30, 200])))) for k in range(300)]
    given += [(400 + i, t) for i, t in enumerate(some_texts()) if t is None or len(t) < 5000]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(given)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    planted = 0
    for key, text in given:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        planted += h % 10 == 0 and bool(runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        head = (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert got[key] == (*head, sha(lines), sha(collapse(words, runs)))
    assert planted > 5
