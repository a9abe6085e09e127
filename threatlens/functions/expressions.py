"""Column expressions shared by the operators; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key, table: dict, default) -> Column:
    """Constant map lookup with a default, written as a CASE so it is generated code."""
    key = col(key)
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def ladder(value, steps: list[tuple[float, str]], default: str) -> Column:
    """Tier of the first lower bound that the value reaches."""
    value = col(value)
    out = None
    for bound, tier in steps:
        hit = value >= F.lit(bound)
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return out.otherwise(default)


def first_match(cases: list[tuple[Column, object]], default) -> Column:
    out = None
    for condition, result in cases:
        out = F.when(condition, F.lit(result)) if out is None else out.when(condition, F.lit(result))
    return out.otherwise(F.lit(default))


def clip01(value) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(value)))


def as_bool(value) -> Column:
    """True, 'True', 1 and '1' are true; everything else, null included, is false."""
    return F.coalesce(F.lower(col(value).cast("string")).isin("true", "1"), F.lit(False))


def flag(condition: Column) -> Column:
    """0/1 column; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def finite(value) -> Column:
    """Null, NaN and infinities become 0."""
    value = col(value).cast("double")
    bad = value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def finite_or_null(value) -> Column:
    value = col(value)
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def round_even(value, decimals: int) -> Column:
    """Scaled rounding to the nearest even number, the way numeric arrays are rounded; no minus zero."""
    scale = float(10**decimals)
    return F.rint(col(value) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def is_blank(value) -> Column:
    value = col(value)
    return value.isNull() | (F.trim(value) == "")


def off_hours_clock(ts) -> Column:
    """Before 8, from 18 on, or at the weekend; an unknown time is not off-hours."""
    ts = col(ts)
    return F.coalesce(
        (F.hour(ts) < 8) | (F.hour(ts) >= 18) | (F.weekday(ts) >= 5), F.lit(False)
    )


def high_value_name(*names) -> Column:
    out = F.lit(False)
    for name in names:
        for part in K.HIGH_VALUE_NAME_PARTS:
            out = out | col(name).contains(part)
    return F.coalesce(out, F.lit(False))


def gated_fusion(flow, behavior, packet) -> Column:
    """Sigmoid gate between flow and behavior score, 85/15 blend with the packet score."""
    flow, behavior, packet = col(flow), col(behavior), col(packet)
    gate = F.lit(1.0) / (F.lit(1.0) + F.exp(-(flow - behavior)))
    fused = gate * flow + (F.lit(1.0) - gate) * behavior
    return clip01(F.lit(0.85) * fused + F.lit(0.15) * packet)


def hybrid_score(ml, rule) -> Column:
    """Larger of both scores; raised when both are strong, model alone is damped when rules are weak."""
    ml, rule = col(ml), col(rule)
    best = F.greatest(ml, rule)
    return F.least(
        F.lit(1.0),
        F.when((ml >= 0.55) & (rule >= 0.55), F.least(best + 0.10, F.lit(1.0)))
        .when(rule < 0.10, ml * 0.50)
        .when(rule < 0.20, ml * 0.70)
        .when(rule < 0.35, ml * 0.85)
        .otherwise(best),
    )


def model_only(ml, rule) -> Column:
    """The model is sure while the rules are not."""
    return (col(ml) > 0.70) & (col(rule) < 0.50)


def ensemble(classifier, anomaly, classifier_weight=0.7, anomaly_weight=0.3) -> Column:
    return clip01(col(classifier) * classifier_weight + col(anomaly) * anomaly_weight)


def flow_severity(probability) -> Column:
    """Right-closed bins over (0, 1]; exactly 0 lies in no bin and stays null."""
    p = col(probability)
    return (
        F.when((p > 0) & (p <= 0.6), "NORMAL")
        .when((p > 0.6) & (p <= 0.75), "MEDIUM")
        .when((p > 0.75) & (p <= 0.9), "HIGH")
        .when((p > 0.9) & (p <= 1.0), "CRITICAL")
    )


def fused_severity(score) -> Column:
    return ladder(score, K.FUSED_LADDER, "NORMAL")


def response_severity(score) -> Column:
    return ladder(score, K.RESPONSE_LADDER, "LOW")


def technique_of(category) -> Column:
    return lookup(category, K.CATEGORY_TECHNIQUE, "")


def ip_is_internal(ip) -> Column:
    out = F.lit(False)
    for prefix in K.INTERNAL_PREFIXES:
        out = out | col(ip).startswith(prefix)
    return out


def technique_pairs(flags: list[tuple[Column, str]], table: dict) -> Column:
    """Array of (tactic, technique) for each condition that holds, in the given order."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    cond, F.struct(F.lit(table[name][0]).alias("tactic"), F.lit(table[name][1]).alias("technique"))
                )
                for cond, name in flags
            ]
        )
    )


def flag_array(flags: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in flags]))


def join_flags(flags) -> Column:
    return F.array_join(col(flags), "|")


def join_techniques(pairs) -> Column:
    return F.array_join(
        F.transform(col(pairs), lambda p: F.concat(p["tactic"], F.lit(":"), p["technique"])), "|"
    )
