"""Packet agent: address features of both logs, anomaly model, indicators, fingerprint signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..models import iforest, trees
from ..operators import ip_features as ipf
from ..operators import sessions as ss
from ..operators.evaluation import best_f1_threshold
from ..session import settle


def address_features(windows: DataFrame, zeek: DataFrame) -> DataFrame:
    busy = ipf.busy_hours(windows)
    return ipf.combined_ip_features(
        ipf.windows_ip_features(windows, busy), ipf.zeek_ip_features(zeek, busy)
    )


def run(windows: DataFrame, zeek: DataFrame, contamination: float = 0.05) -> DataFrame:
    """One row per address: features, threat_score, is_anomaly, indicators, fingerprint counts."""
    features = settle(address_features(windows, zeek), "addresses")
    model = iforest.fit(features, "source_ip", K.PACKET_FEATURES)
    scored = iforest.packet_calibration(iforest.score(features, model), contamination)
    marked = ipf.quantile_indicators(scored)
    signal = ipf.ja3_ip_signal(ipf.ja3_row_flags(zeek, ipf.ja3_baseline_frequency(zeek)))
    return ipf.join_ja3_signal(marked, signal)


def packet_scores(result: DataFrame) -> DataFrame:
    """Score table for fusion: the packet score is the threat score of the address."""
    return result.select(F.col("source_ip").alias("src_ip"), F.col("threat_score").alias("packet_score"))


def ja3_signal(result: DataFrame) -> DataFrame:
    """Addresses with their known-fingerprint mark, for fusion."""
    return result.select(F.col("source_ip").alias("src_ip"), "ind_ja3_c2_match")


def labelled_sessions(windows: DataFrame, zeek: DataFrame) -> DataFrame:
    busy = ipf.busy_hours(windows)
    aligned = ss.align_sessions(ss.windows_sessions(windows, busy), ss.zeek_sessions(zeek, busy))
    key = F.concat_ws(
        "|", "source_ip",
        F.coalesce(F.unix_micros("win_session_start").cast("string"), F.lit("")),
        F.coalesce(F.unix_micros("zeek_session_start").cast("string"), F.lit("")),
    )
    return ss.label_sessions(aligned).withColumn("session_key", key)


def score_sessions(
    sessions: DataFrame, n_trees: int = 300, test_share: float = 0.30, seed: int = 42
):
    """Random forest over sessions: (model, all sessions with score and both flags).

    The second flag uses the threshold with the best F1 on the held-out part.
    """
    split = settle(
        trees.stratified_split(settle(sessions, "sessions"), "session_key", "session_label", test_share, seed),
        "split",
    )
    model = trees.fit_rf(
        split.where("not is_test"), "session_key", K.PACKET_FEATURES, "session_label", n_trees, 2, seed
    )
    scored = settle(trees.probability(split, model, "rf_threat_score"), "rf-scores")
    best = best_f1_threshold(scored.where("is_test"), "rf_threat_score", "session_label")
    cut = best.select("threshold").scalar()
    return model, scored.withColumns(
        {
            "rf_flag_default": (F.col("rf_threat_score") >= 0.5).cast("int"),
            "rf_flag_best_f1": F.coalesce(F.col("rf_threat_score") >= cut, F.lit(False)).cast("int"),
        }
    )
