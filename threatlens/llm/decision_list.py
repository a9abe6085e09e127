"""Quality rules as a learned decision list over text statistics, in DataFrame operations only.

Statistics of whole texts come from built-in functions, one row per document and no exchange of text. Sequential
covering learns from labelled rows: a rule is a conjunction of thresholds that grows by the condition of the
greatest information gain on two thirds of the rows, is cut back to the conditions that serve it best on the other
third, and takes the rows that it covers out of play. Every step reads sums over labelled rows by (statistic, bin),
of a number that does not depend on the rows. The list is a plain conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window that counts as repeated when it stands twice in a text.
WINDOW = 8
#: Fewest words, and largest percentage of repeated ones, with which a text is looked at by the learned rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Statistics that rules may use: name, value, and the width of a bin. Thresholds lie on borders of bins.
STATISTICS: dict[str, tuple[str, float]] = {
    "symbol_share": ("n_symbols / word_chars", 0.005),
    "upper_share": ("n_upper / word_chars", 0.005),
    "sign_share": ("n_signs / word_chars", 0.005),
    "digit_share": ("n_digits / word_chars", 0.005),
    "repeat_share": ("n_repeat_words / n_words", 0.01),
    "distinct_share": ("n_distinct / n_words", 0.01),
    "dup_line_share": ("n_dup_lines / n_lines", 0.01),
    "word_length": ("word_chars / n_words", 0.1),
    "line_words": ("least(n_words / n_lines, 1000)", 1.0),
    "text_words": ("log2(n_words + 1)", 0.25),
}
#: Conditions that a rule may have, rules that a list may have.
MAX_CONDITIONS, MAX_RULES = 4, 16
#: A rule stays if at least this share of what it covers in the pruning rows is bad, one good row more assumed
#: than there are, and it covers at least so many.
MIN_PRECISION, MIN_COVER = 0.9, 10


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of words found at least twice, windows by 64-bit hash."""
    def spread(starts: Column) -> Column:
        """Each window start covers the words up to the next start, at most a window."""
        gaps = F.zip_with(
            starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def starts(ranked: Column) -> Column:
        """Starts of the windows that have an equal neighbour among the windows in order of their hashes."""
        pairs = F.zip_with(
            ranked, F.slice(ranked, 2, F.size(ranked)),
            lambda a, b: F.when(a["hash"] == b["hash"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")),
        )
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    def of_windows(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            bound(ranked, lambda r: bound(starts(r), spread))
        )

    def of_words(hashed: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(hashed) - (window - 1)), lambda i: F.xxhash64(F.slice(hashed, i, window))
        )
        return F.when(F.size(hashed) <= window, F.lit(0).cast("long")).otherwise(bound(windows, of_windows))

    return bound(F.transform(words, lambda word: F.xxhash64(word)), of_words)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of its whole text, base_failed.

    Null texts count as empty; repeated rows each give a row; an empty table gives none; other columns, whatever
    their names, are not looked at. No text is exchanged; a text's words are held by the task that reads it.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = F.filter(F.split("text", SPACE), lambda word: word != "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0)
    of_words = bound(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        repeated_words(w).alias("n_repeat_words"),
    ))
    of_lines = bound(lines, lambda found: F.struct(
        F.size(found).cast("long").alias("n_lines"),
        (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
    ))

    def count(pattern: str) -> Column:
        return (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")

    found = rows.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        count(r"\p{Lu}+").alias("n_upper"), count(r"\p{Nd}+").alias("n_digits"),
        count(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+").alias("n_signs"),
    )
    counts = found.select(
        "doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_distinct", "l.n_lines",
        "n_upper", "n_digits", "n_signs",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Condition:
    """``statistic >= threshold`` or ``statistic < threshold``; the threshold is a border of bins."""

    statistic: str
    at_least: bool
    bin: int

    @property
    def threshold(self) -> float:
        return round(self.bin * STATISTICS[self.statistic][1], 6)

    def column(self) -> Column:
        """On counts, through the bin, so that learning and applying agree on every value."""
        return self.on(bin_of(self.statistic))

    def on(self, bins: Column) -> Column:
        return bins >= self.bin if self.at_least else bins < self.bin

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Conditions that all hold, and the bad and good rows that the rule covered in pruning."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return reduce(Column.__and__, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return f"if {' and '.join(map(str, self.conditions))}: drop ({self.bad} bad, {self.good} good)"


def bin_of(statistic: str) -> Column:
    """Number of the bin of a statistic; a text without words or lines lies in bin 0."""
    value, width = STATISTICS[statistic]
    return F.coalesce(F.floor(F.expr(f"CASE WHEN n_words > 0 AND n_lines > 0 THEN {value} END") / width), F.lit(0)).cast("int")


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Bins of the rows with a label that pass the base rules; ``bad`` is label 0; ``part`` 0 prunes, 1 and 2 grow.

    A row is labelled by id; null ids and null labels take no part, and an id with several labels has the largest.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
        .groupBy("_id").agg((F.max("_label") == 0).alias("bad"))
    )
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)).cast("int").alias("part")
    bins = [bin_of(name).alias(name) for name in STATISTICS]
    rows = stats.filter(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_id"))
    return rows.select("bad", part, *bins)


def _covered(conditions: list[Condition] | tuple[Condition, ...]) -> Column:
    return reduce(Column.__and__, [c.on(F.col(c.statistic)) for c in conditions], F.lit(True))


def _sums(rows: DataFrame) -> list[tuple[str, int, int, int]]:
    """(statistic, bin, bad rows, good rows); as many as there are bins, whatever the rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("bin")) for name in STATISTICS]))
    found = rows.select("bad", cells.alias("c")).groupBy("c.name", "c.bin").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")
    )
    return [tuple(row) for row in found.collect()]


def best_condition(sums: list[tuple[str, int, int, int]]) -> tuple[Condition, float, int] | None:
    """The condition of the greatest information gain, its gain, and the good rows that it lets in.

    Gain of p bad and n good rows, of P and N before: p (log2(p / (p + n)) - log2(P / (P + N))). Of equal gains the
    earlier statistic, then the wider side. A border lies in the middle of the bins that no row is in.
    """
    best = None
    for place, name in enumerate(STATISTICS):
        cells = sorted((b, p, n) for found, b, p, n in sums if found == name)
        all_bad, all_good = sum(c[1] for c in cells), sum(c[2] for c in cells)
        if not all_bad:
            return None
        before = math.log2(all_bad / (all_bad + all_good))
        bad = good = 0
        last = cells[0][0]
        for bin_, p, n in cells:
            border = (last + bin_ + 1) // 2
            for at_least, x, y in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                if x:
                    gain = x * (math.log2(x / (x + y)) - before)
                    key = (gain, -place, x + y)
                    if gain > 0 and (best is None or key > best[0]):
                        best = key, Condition(name, at_least, border), y
            bad, good, last = bad + p, good + n, bin_
    return None if best is None else (best[1], best[0][0], best[2])


def grow(rows: DataFrame) -> list[Condition]:
    """Conditions in the order of their choice, until no good row is covered or none gains."""
    conditions: list[Condition] = []
    while len(conditions) < MAX_CONDITIONS:
        found = best_condition(_sums(rows.filter(_covered(conditions))))
        if found is None:
            break
        conditions.append(found[0])
        if not found[2]:
            break
    return conditions


def prune(rows: DataFrame, conditions: list[Condition]) -> Rule:
    """The first conditions, as many as make the difference of bad and good shares largest; fewer on a tie."""
    counted = rows.agg(*[
        F.count_if(_covered(conditions[:size]) & (F.col("bad") == bad)).alias(f"{size}_{bad}")
        for size in range(1, len(conditions) + 1) for bad in (True, False)
    ]).first()
    best = None
    for size in range(1, len(conditions) + 1):
        bad, good = counted[f"{size}_True"], counted[f"{size}_False"]
        worth = (bad - good) / (bad + good) if bad + good else -1.0
        if best is None or worth > best[0]:
            best = worth, Rule(tuple(conditions[:size]), bad, good)
    return best[1]


def learn(examples: DataFrame) -> list[Rule]:
    """The decision list: rules in order, each learned on what no earlier one covers; [] without bad rows.

    ``examples`` as from ``labelled``. A rule that is not precise enough on the pruning rows ends the list.
    """
    rules: list[Rule] = []
    left = examples
    while len(rules) < MAX_RULES:
        conditions = grow(left.filter("part > 0"))
        if not conditions:
            break
        rule = prune(left.filter("part = 0"), conditions)
        if rule.bad < MIN_COVER or rule.bad / (rule.bad + rule.good + 1) < MIN_PRECISION:
            break
        rules.append(rule)
        left = left.filter(~_covered(rule.conditions))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null where none does: one ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("int")
    column = F.when(rules[0].column(), F.lit(1))
    for number, rule in enumerate(rules[1:], 2):
        column = column.when(rule.column(), F.lit(number))
    return column


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every document, the number of the rule that drops it (``rule``), and ``kept``.

    A document that fails the base rules is not kept; others are kept unless a rule holds. Without labelled bad
    rows there are no rules. Nulls, repeated rows and empty tables as in ``statistics`` and ``labelled``.
    """
    stats = settle(statistics(docs, id_col, text_col), "text-statistics")
    rules = learn(settle(labelled(stats, labels), "labelled-statistics"))
    ruled = stats.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return ruled.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
