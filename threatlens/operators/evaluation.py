"""Threshold tuning and ranking metrics from score counts.

All curves start from one row per distinct score, so their size is bounded by the scores' precision
and running totals are distributed (see ``cumulative_by_value``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import flag
from ..session import settle
from .ordered import cumulative_by_value


def join_labels(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Scored flows that have a label; a flow with contradictory labels counts as an attack."""
    known = labels.where(F.col("is_attack").isNotNull()).groupBy("flow_id").agg(F.max("is_attack").alias("is_attack"))
    return scored.join(known, "flow_id", "inner")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns(
        {
            "fpr": _ratio(fp, fp + tn),
            "recall": _ratio(tp, tp + fn),
            "precision": _ratio(tp, tp + fp),
            "n_flagged": tp + fp,
        }
    )


def confusion_at_threshold(
    df: DataFrame, threshold: float, score: str = "attack_probability", label: str = "is_attack"
) -> DataFrame:
    """One row: confusion counts and rates when scores >= threshold are flagged."""
    hit, pos = F.coalesce(F.col(score) >= threshold, F.lit(False)), F.coalesce(F.col(label), F.lit(False))
    counts = df.agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )
    return _rates(counts.withColumn("threshold", F.lit(float(threshold))))


def threshold_sweep(
    df: DataFrame, score: str = "attack_probability", label: str = "is_attack", steps: int = 100
) -> DataFrame:
    """Confusion counts for the thresholds 1/steps … (steps-1)/steps in one pass.

    Each score falls into the bucket of the largest threshold it reaches; counts per bucket (at most
    ``steps`` rows) are then summed from the top.
    """
    spark = df.sparkSession
    s, n = F.col(score), F.lit(float(steps))
    near = F.floor(s * n)
    bucket = (
        F.when((near + 1) / n <= s, near + 1).when(near / n > s, near - 1).otherwise(near)
    )
    bucket = F.least(F.greatest(F.coalesce(bucket, F.lit(0)), F.lit(0)), F.lit(steps - 1)).cast("long")
    pos = F.coalesce(F.col(label), F.lit(False))
    counts = df.groupBy(bucket.alias("k")).agg(
        F.count_if(pos).alias("p"), F.count_if(~pos).alias("q")
    )
    table = spark.range(0, steps).withColumnRenamed("id", "k").join(counts, "k", "left").fillna(0)
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.orderBy(F.asc("k")).rowsBetween(Window.unboundedPreceding, -1)
    swept = table.select(
        "k",
        F.sum("p").over(above).alias("tp"),
        F.sum("q").over(above).alias("fp"),
        F.coalesce(F.sum("q").over(below), F.lit(0)).alias("tn"),
        F.coalesce(F.sum("p").over(below), F.lit(0)).alias("fn"),
    ).where("k >= 1")
    return _rates(swept.withColumn("threshold", F.col("k") / n)).drop("k")


def tune_threshold(
    df: DataFrame, max_fpr: float = 0.10, default: float = 0.50,
    score: str = "attack_probability", label: str = "is_attack",
) -> DataFrame:
    """One row: the threshold with the best recall among those within the false alarm limit.

    Ties take the lowest threshold; without any such threshold the one with fewest false alarms;
    without labelled rows the default.
    """
    sweep = threshold_sweep(df, score, label)
    fits = F.col("fpr") <= max_fpr
    best = F.min(F.when(fits, F.struct((-F.col("recall")).alias("r"), "threshold")))
    least = F.min(F.struct("fpr", "threshold"))
    rows = F.max(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return sweep.agg(best.alias("b"), least.alias("l"), rows.alias("n")).select(
        F.when(F.col("n") == 0, F.lit(default))
        .otherwise(F.coalesce("b.threshold", "l.threshold")).alias("threshold")
    )


def score_counts(df: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    pos = F.coalesce(F.col(label).cast("boolean"), F.lit(False))
    return (
        df.where(F.col(score).isNotNull())
        .groupBy(*(groups or []), F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))
    )


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: counts at or above it, false and true positive rate, precision.

    ``is_corner`` is false for points on a straight piece of the curve (the next score adds just
    as many positives and negatives); the operating point rules only look at corners.
    """
    both = ["pos", "neg"]
    counts = settle(score_counts(df, score, label), "scores")
    cum = cumulative_by_value(counts, "threshold", both, following=both)
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    whole = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("w"))
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return cum.withColumn("whole", whole.scalar()).select(
        "threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"),
        F.col("whole.p").alias("n_pos"), F.col("whole.n").alias("n_neg"),
        _ratio(fp, F.col("whole.n")).alias("fpr"),
        _ratio(tp, F.col("whole.p")).alias("tpr"),
        _ratio(tp, tp + fp).alias("precision"),
        (first | F.col("next_pos").isNull() | bends).alias("is_corner"),
    )


def roc_points(df: DataFrame, score: str = "attack_probability", label: str = "is_attack") -> DataFrame:
    """The curve without its class totals."""
    return curve(df, score, label).drop("n_pos", "n_neg")


def auroc(
    df: DataFrame, score: str = "attack_probability", label: str = "is_attack",
    groups: list[str] | None = None,
) -> DataFrame:
    """Rank AUC with tie averaging, one row (or one per group); null when a class is missing."""
    groups = groups or []
    counts = settle(score_counts(df, score, label, groups), "scores")
    cum = cumulative_by_value(counts, "threshold", ["neg"], groups, descending=False)
    below = F.col("cum_neg") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
    p, n = F.sum("pos"), F.sum("neg")
    return cum.groupBy(*groups).agg(
        F.when((p > 0) & (n > 0), won / (p.cast("double") * n)).alias("auroc")
    )


def metrics_at_fpr(
    df: DataFrame, fpr: float = 0.05, rule: str = "closest",
    score: str = "attack_probability", label: str = "is_attack",
) -> DataFrame:
    """Operating point at a false positive rate.

    ``closest``: the point nearest to the rate, the higher threshold on a tie. ``last_below``: the
    last point that does not exceed it. The curve starts at the point that flags nothing.
    """
    points = curve(df, score, label)
    corner = F.col("is_corner")
    point = F.struct("threshold", "tp", "fp", "fpr", "tpr", "precision")
    if rule == "closest":
        near = F.struct(F.abs(F.col("fpr") - fpr).alias("d"), (-F.col("threshold")).alias("t"), point.alias("p"))
        best = F.min(F.when(corner, near))
        usable = F.col("p.d") < fpr
    else:
        best = F.min(
            F.when(corner & (F.col("fpr") <= fpr), F.struct(F.col("threshold").alias("d"), F.lit(0).alias("t"), point.alias("p")))
        )
        usable = F.col("p").isNotNull()
    row = points.agg(best.alias("p"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")).select(
        F.when(usable, F.col("p.p")).alias("p"), "n_pos", "n_neg"
    )
    tp, fp = F.coalesce("p.tp", F.lit(0)), F.coalesce("p.fp", F.lit(0))
    precision, recall = F.coalesce("p.precision", F.lit(0.0)), F.coalesce("p.tpr", F.lit(0.0))
    return row.select(
        F.col("p.threshold").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        (F.col("n_neg") - fp).alias("tn"), (F.col("n_pos") - tp).alias("fn"),
        F.coalesce("p.fpr", F.lit(0.0)).alias("fpr"), precision.alias("precision"), recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))
        .otherwise(F.lit(0.0)).alias("f1"),
    )


def average_precision(df: DataFrame, score: str = "attack_probability", label: str = "is_attack") -> DataFrame:
    """Sum over distinct scores of (recall gained × precision there)."""
    points = roc_points(df, score, label)
    return points.agg(
        _ratio(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")).alias("average_precision")
    )


def best_f1_threshold(df: DataFrame, score: str = "attack_probability", label: str = "is_attack") -> DataFrame:
    """Threshold with the best F1; the lowest one on a tie."""
    p, r = F.col("precision"), F.col("tpr")
    points = roc_points(df, score, label).withColumn("f1", 2 * p * r / (p + r + 1e-12))
    best = F.min(F.struct((-F.col("f1")).alias("o"), "threshold", "f1", "precision", "tpr"))
    return points.agg(best.alias("b")).select(
        "b.threshold", "b.f1", "b.precision", F.col("b.tpr").alias("recall")
    )


def threshold_at_recall(
    df: DataFrame, targets=(0.7, 0.8, 0.9), score: str = "attack_probability", label: str = "is_attack"
) -> DataFrame:
    """For each recall target, the highest threshold that reaches it, with its precision."""
    points = roc_points(df, score, label)
    wanted = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target_recall")
    reached = points.select(wanted, "threshold", "precision", "tpr").where("tpr >= target_recall")
    return reached.groupBy("target_recall").agg(
        F.max(F.struct("threshold", "precision", F.col("tpr").alias("recall"))).alias("b")
    ).select("target_recall", "b.threshold", "b.precision", "b.recall")


def attack_rate(df: DataFrame, label: str = "is_attack") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label)).alias("n_attacks"),
        F.avg(F.col(label).cast("int")).alias("attack_rate"),
    )


def classification_report(
    df: DataFrame, threshold: float, score: str = "attack_probability", label: str = "is_attack",
    names=("Normal", "Anomaly"),
) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    c = confusion_at_threshold(df, threshold, score, label)
    both = F.array(
        F.struct(
            F.lit(names[0]).alias("class"), F.col("tn").alias("hit"),
            (F.col("tn") + F.col("fn")).alias("said"), (F.col("tn") + F.col("fp")).alias("support"),
        ),
        F.struct(
            F.lit(names[1]).alias("class"), F.col("tp").alias("hit"),
            (F.col("tp") + F.col("fp")).alias("said"), (F.col("tp") + F.col("fn")).alias("support"),
        ),
    )
    rows = c.select(F.explode(both).alias("r")).select("r.*")
    precision, recall = _ratio(F.col("hit"), F.col("said")), _ratio(F.col("hit"), F.col("support"))
    out = rows.select("class", precision.alias("precision"), recall.alias("recall"), "support")
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def _unpivot(df: DataFrame, features: list[str], label: str) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    )
    return df.select(F.col(label).alias("label"), F.explode(pairs).alias("e")).select("label", "e.*")


def feature_auroc(df: DataFrame, features: list[str], label: str = "is_attack") -> DataFrame:
    """AUROC of every feature taken alone."""
    return auroc(_unpivot(df, features, label), "value", "label", ["feature"])


def class_means(df: DataFrame, features: list[str], label: str = "is_attack") -> DataFrame:
    """Mean of every feature per class: one aggregate over the rows as they are, turned round afterwards."""
    hit = F.col(label)
    means = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.when(hit, F.col(c).cast("double"))).alias("attack_mean"),
            F.avg(F.when(~hit, F.col(c).cast("double"))).alias("normal_mean"),
        )
        for c in features
    ])
    return df.agg(means.alias("means")).select(F.explode("means").alias("m")).select("m.*")


def disjoint_features(df: DataFrame, features: list[str], label: str = "is_attack") -> DataFrame:
    """Features that have no value in common between the classes."""
    values = _unpivot(df, features, label).groupBy("feature", "value").agg(
        F.max(flag(F.col("label"))).alias("in_attack"), F.max(flag(~F.col("label"))).alias("in_normal")
    )
    return values.groupBy("feature").agg(
        F.sum("in_attack").alias("attack_values"),
        F.sum("in_normal").alias("normal_values"),
        F.sum(F.col("in_attack") * F.col("in_normal")).alias("shared_values"),
    ).withColumn("disjoint", F.col("shared_values") == 0)


def importance_share(importances: DataFrame) -> DataFrame:
    """Share of importance per feature family (name up to the first underscore)."""
    family = F.substring_index("feature", "_", 1)
    return importances.groupBy(family.alias("family")).agg(F.sum("importance").alias("share"))
