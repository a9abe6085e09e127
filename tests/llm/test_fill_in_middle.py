import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatlens.llm import fill_in_middle as fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n int, bytes string, prefix string, form int, residuals string"


def brute(key, text, seed=42, fim_percent=50, spm_percent=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted([h[0] % (len(units) + 1), h[1] % (len(units) + 1)])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return (key, len(units), "plain", text, None, None)
    if h[3] % 100 < spm_percent:
        return (key, len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m))
    return (key, len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def texts():
    rng = random.Random(5)
    spaces, letters = [" ", "  ", "\n", "\t", "\x0b ", "\x0c\r"], "aé漢𝄞<>PSM  "
    rows = [None, "", " ", "\n\n", "one", " one", "one ", "a <P> b", "x<S", "<M>", "<P", "a" * 5000 + " b " + "é" * 3000]
    for size in [1, 2, 3, 10, 40, 300, 2500]:
        for _ in range(12):
            rows.append("".join(
                "".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(spaces) for _ in range(size)
            ) + rng.choice(["", "end"]))
    rows += ["ab " * 60_000, " ".join("w" * (1 + 700 * (i % 2)) for i in range(600)), "<" * 400, "<S <P <M " * 30]
    return rows


def rows_of(made):
    return sorted(map(tuple, made.collect()), key=repr)


@pytest.mark.parametrize("fim_percent,spm_percent,seed", [(50, 80, 42), (100, 50, 7), (0, 0, 1)])
def test_examples_and_round_trip(spark, fim_percent, spm_percent, seed):
    given = [*enumerate(texts()), (3, "again"), (3, "again"), (None, "no id at all")]
    docs = spark.createDataFrame([(k, t, 1, "x", "y", 2, "z") for k, t in given], SCHEMA).repartition(5)
    made = fim.fill_in_middle(docs, seed=seed, fim_percent=fim_percent, spm_percent=spm_percent)
    assert rows_of(made) == sorted([brute(k, t, seed, fim_percent, spm_percent) for k, t in given], key=repr)
    back = made.select("doc_id", fim.restore(F.col("output"), F.col("form")))
    assert rows_of(back) == sorted([(k, t or "") for k, t in given], key=repr)


def test_index_predicts_every_boundary(spark):
    given = [*enumerate(texts())]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    for error in (1, 20, 127):
        for row in fim.index_units(docs, error=error).collect():
            ends = np.cumsum([0] + [len(u.encode()) for u in UNIT.findall(row.text)])
            assert row.n == len(ends) - 1 and len(row.residuals) == len(ends)
            assert max(map(abs, row.residuals)) <= error
            ranks = np.arange(len(ends))
            at = np.searchsorted(row.segment_rank, ranks, side="right") - 1
            guess = np.array(row.segment_start)[at] + np.floor(
                np.array(row.segment_slope)[at] * (ranks - np.array(row.segment_rank)[at]) + 0.5
            )
            assert (guess + np.array(row.residuals) == ends).all()


def test_one_index_serves_many_seeds(spark):
    given = [*enumerate(texts())]
    stored = fim.index_units(spark.createDataFrame(given, "doc_id long, text string"))
    for seed in (1, 2):
        assert rows_of(fim.cut(stored, seed)) == sorted([brute(k, t, seed) for k, t in given], key=repr)


def test_regular_text_needs_few_segments():
    offsets = np.arange(0, 400_000, 4)
    assert len(fim.fit(offsets)[0]) == 1
    rng = np.random.default_rng(0)
    offsets = np.concatenate([[0], np.cumsum(rng.integers(2, 12, 100_000))])
    assert len(fim.fit(offsets)[0]) < 200


def test_empty_table_and_bad_error(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fim.fill_in_middle(empty).count() == 0
    with pytest.raises(ValueError):
        fim.index_units(empty, error=128)
