"""Behavior agent: user events, Windows events and query velocity to one score per address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..models import iforest
from ..operators import behavior as bh
from ..operators import user_rules as ur
from ..operators import windows_rules as wr
from ..operators.cleaning import dedupe_windows_events, host_context, impute_local_ip
from ..session import settle


def clean_windows(events: DataFrame) -> DataFrame:
    return impute_local_ip(dedupe_windows_events(events))


def user_model_scores(events: DataFrame) -> DataFrame:
    """(ueba_id, ml_score) of the calibrated anomaly model."""
    features = settle(ur.ueba_features(events), "user-features")
    model = iforest.fit(features, "ueba_id", K.USER_FEATURES)
    return iforest.user_calibration(iforest.score(features, model)).select("ueba_id", "ml_score")


def results(
    ueba: DataFrame, windows: DataFrame, hosts: DataFrame, ml_scores: DataFrame | None = None
) -> DataFrame:
    """All results in one layout. Without given model scores the anomaly model is trained first."""
    ml_scores = user_model_scores(ueba) if ml_scores is None else ml_scores
    windows = settle(clean_windows(windows), "windows")
    hosts = settle(host_context(hosts), "hosts")  # its own context, so every rule reads the stored rows
    return bh.union_results(
        ur.score_ueba(ueba, hosts, ml_scores),
        wr.windows_results(wr.windows_event_rules(windows, hosts)),
        ur.velocity_results(ur.swift_query_velocity(ueba, hosts)),
    )


def behavior_scores(all_results: DataFrame) -> DataFrame:
    """Largest score per address, for fusion."""
    return all_results.where(F.col("source_ip").isNotNull()).groupBy(
        F.col("source_ip").alias("src_ip")
    ).agg(F.max("score").alias("behavior_score"))
