import random
import re

import pytest
from pyspark.sql import functions as F

from threatlens.llm import decision_list as lists
from threatlens.llm import queries

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n_words string, w int, bad string, part int, rule int"


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows, places = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    for starts in windows.values():
        if len(starts) > 1:
            places.update(i + j for i in starts for j in range(8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 20 or 100 * len(places) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(places), failed,
    )


def some_texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "a", "a " * 19, "a " * 20, "a b c d e f g h", "a b c d e f g h " * 2, "é漢𝄞 #*$ <x> \n \n" * 9]
    out += ["x\n" * 7 + " x\n", "l1 a\nl2 b\n\nl1 a\nl1 a \n", "a\xa0b \x0b c\x0cd\r\n", "w " * 8, "w " * 9]
    passage = " ".join(f"p{i}" for i in range(11))
    out += [f"{passage} {' '.join(f'q{i}' for i in range(k))} {passage}" for k in (0, 3, 30, 60, 90)]
    out += [" ".join(rng.choices("ab", k=n)) for n in (8, 9, 15, 40, 200, 800)]
    out += ["long " + " ".join(str(i) for i in range(30_000)), "t " * 20_000]
    return out


def test_statistics_against_brute_force(spark):
    given = [*enumerate(some_texts()), (3, "again"), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame([(k, t, "x", 1, "y", 2, 3) for k, t in given], SCHEMA).repartition(4)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted((tuple(r) for r in lists.statistics(docs).select(columns).collect()), key=repr)
    assert got == sorted([(k, *brute(t)) for k, t in given], key=repr)
    assert lists.statistics(docs.limit(0)).count() == 0


def prose(rng, n=60):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))


def corpus(size, seed=1):
    """Clean prose, prose full of symbols, and shouted prose; every twentieth clean text has some symbols too."""
    rng, docs, labels = random.Random(seed), [], []
    for key in range(size):
        text, kind = prose(rng), key % 5
        if kind == 0:
            text = text.replace(" ", "*** ")
        elif kind == 1:
            text = text.upper()
        elif key % 20 == 2:
            text = text.replace(" ", " & ", 5)
        docs.append((key, text))
        if key % 3:
            labels.append((key, int(kind > 1)))
    return docs, labels


def test_rules_find_what_was_planted(spark):
    docs, labels = corpus(900)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = lists.learn(lists.labelled(lists.statistics(frame), known).cache())
    used = {c.statistic for rule in rules for c in rule.conditions}
    assert len(rules) == 2 and used & {"symbol_share", "sign_share"} and "upper_share" in used
    judged = lists.judge(frame, known).collect()
    assert {r.doc_id for r in judged if not r.kept} == {k for k, _ in docs if k % 5 < 2}
    assert all((r.rule is None) == r.kept for r in judged)
    assert "drop" in str(rules[0])


def brute_best(rows):
    """Every condition on every border that occurs, by the definition of the gain."""
    import math

    bad, good = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
    best = None
    for place, name in enumerate(lists.STATISTICS):
        bins = sorted({r[name] for r in rows})
        for border in [bins[0]] + [(a + b + 1) // 2 for a, b in zip(bins, bins[1:], strict=False)]:
            for at_least in (False, True):
                inside = [r for r in rows if (r[name] >= border) == at_least]
                x, y = sum(r["bad"] for r in inside), sum(not r["bad"] for r in inside)
                if not x:
                    continue
                gain = x * (math.log2(x / (x + y)) - math.log2(bad / (bad + good)))
                if gain > 0 and (best is None or (gain, -place, x + y) > best[0]):
                    best = (gain, -place, x + y), lists.Condition(name, at_least, border), y
    return best


@pytest.mark.parametrize("seed", range(4))
def test_best_condition_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        {"bad": rng.random() < 0.3, "part": 1, **{name: rng.choice([0, 1, 2, 3, 5, 9, 14]) for name in lists.STATISTICS}} for _ in range(80)
    ]
    for r in rows:
        r["repeat_share"] += 3 * r["bad"]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], "bad boolean, part int, " + ", ".join(
        f"{name} int" for name in lists.STATISTICS))
    got, want = lists.best_condition(lists._sums(frame)), brute_best(rows)
    assert got[0] == want[1] and got[1] == pytest.approx(want[0][0]) and got[2] == want[2]


def test_pruning_cuts_what_does_not_help(spark):
    helps, noise = lists.Condition("symbol_share", True, 5), lists.Condition("text_words", False, 3)
    rows = [(True, 0, 6, 2)] * 9 + [(True, 0, 6, 4)] * 9 + [(False, 0, 1, 2)] * 20 + [(False, 0, 6, 2)]
    frame = spark.createDataFrame(rows, "bad boolean, part int, symbol_share int, text_words int")
    rule = lists.prune(frame, [helps, noise])
    assert rule == lists.Rule((helps,), 18, 1)


def test_noise_teaches_no_rule_and_keeps_every_clean_document(spark):
    rng = random.Random(6)
    frame = spark.createDataFrame([(k, prose(rng)) for k in range(400)], "doc_id long, text string")
    known = spark.createDataFrame([(k, int(rng.random() < 0.7)) for k in range(400)], "doc_id long, quality int")
    assert lists.judge(frame, known).filter("not kept").count() == 0


def test_labels_with_nulls_and_repeats(spark):
    docs, _ = corpus(60)
    stats = lists.statistics(spark.createDataFrame([*docs, docs[0], (None, prose(random.Random(1)))], "doc_id long, text string"))
    known = spark.createDataFrame(
        [(0, 0), (0, 0), (1, 0), (1, 1), (2, None), (None, 0), (7777, 0)], "doc_id long, quality int")
    rows = lists.labelled(stats, known)
    assert sorted(r.bad for r in rows.collect()) == [False, True, True]
    assert lists.learn(rows.limit(0)) == []
    none = lists.judge(spark.createDataFrame(docs, "doc_id long, text string"), known.limit(0))
    assert none.filter("kept").count() == none.filter("not base_failed").count()


def test_thresholds_apply_as_learned(spark):
    docs, _ = corpus(50)
    stats = lists.statistics(spark.createDataFrame(docs, "doc_id long, text string"))
    for name in lists.STATISTICS:
        binned = stats.withColumn("b", lists.bin_of(name))
        for border in {r.b for r in binned.collect()}:
            for at_least in (True, False):
                want = F.col("b") >= border if at_least else F.col("b") < border
                assert binned.filter(lists.Condition(name, at_least, border).column() != want).count() == 0


def test_query(spark):
    rows = queries.op12_decision_list(spark, "/root/testdata/sf0.001")
    assert rows.columns[:8] == [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows.filter("base_failed and kept").count() == 0 and rows.count() == 200
