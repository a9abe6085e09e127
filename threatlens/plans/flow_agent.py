"""Flow agent: training statistics, both models, scoring, and their storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.expressions import ensemble, flow_severity
from ..models import iforest, trees
from ..models.boosting import BoostedTrees
from ..operators import flow_features as ff
from ..operators.cleaning import dedupe_flows
from ..operators.live_rules import cti_overrides
from ..session import folder_exists, settle
from ..sources.readers import clean_netflow


@dataclass
class FlowArtifacts:
    """Everything scoring needs: baseline fingerprints, rate and source statistics, models."""

    baseline: DataFrame
    rate_stats: DataFrame
    src_stats: DataFrame
    anomaly: iforest.IsolationForestModel
    classifier: BoostedTrees | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        for name in ("baseline", "rate_stats", "src_stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.anomaly.save(spark, f"{path}/anomaly")
        if self.classifier is not None:
            self.classifier.save(spark, f"{path}/classifier")

    @staticmethod
    def load(spark: SparkSession, path: str, with_classifier: bool = True) -> "FlowArtifacts":
        return FlowArtifacts(
            *[spark.read.parquet(f"{path}/{n}") for n in ("baseline", "rate_stats", "src_stats")],
            iforest.IsolationForestModel.load(spark, f"{path}/anomaly"),
            BoostedTrees.load(spark, f"{path}/classifier") if with_classifier else None,
        )


def prepare_flows(flows: DataFrame, zeek: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Cleaned, one row per flow_id, with fingerprint and (if labels are given) flow_label; stored."""
    out = dedupe_flows(clean_netflow(flows))
    if zeek is not None:
        out = ff.join_ja3_mode(out, zeek)
    elif "ja3_hash" not in out.columns:
        out = out.withColumn("ja3_hash", F.lit("UNKNOWN"))
    return settle(out if labels is None else ff.join_flow_labels(out, labels), "flows")


def training_stats(flows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        ff.normal_fingerprints(flows),
        ff.swift_rate_stats(ff.swift_rolling_counts(flows)),
        ff.source_stats(flows),
    )


def train(flows: DataFrame, kind: str = "both", **gbt) -> FlowArtifacts:
    """Trains on labelled flows: the anomaly model on NORMAL rows only, the classifier on all."""
    if "flow_label" not in flows.columns:
        raise ValueError("training needs flow_label")
    features = settle(ff.flow_feature_vector(flows, keep=["flow_label"]), "features")
    normal = features.where("flow_label = 'NORMAL'")
    anomaly = iforest.fit(normal, "flow_id", K.ANOMALY_FEATURES)
    classifier = None
    if kind == "both":
        labelled = features.withColumn("label", (F.col("flow_label") != "NORMAL").cast("int"))
        classifier = trees.fit_gbt(labelled, "flow_id", K.CLASSIFIER_FEATURES, **gbt)
    return FlowArtifacts(*training_stats(flows), anomaly, classifier)


def train_or_load(
    spark: SparkSession, path: str, flows: DataFrame, kind: str = "both", retrain: bool = False, **gbt
) -> FlowArtifacts:
    """Artifacts stored below ``path``; trained and stored first if none of that kind are there, or on demand.

    The mark that a set is complete is written last, so a broken off training is not taken for one.
    """
    mark = f"{path}/complete-{kind}"
    if retrain or not folder_exists(spark, mark):
        train(flows, kind, **gbt).save(spark, path)
        spark.range(1).write.mode("overwrite").parquet(mark)
    return FlowArtifacts.load(spark, path, with_classifier=kind == "both")


def score(
    flows: DataFrame, art: FlowArtifacts, classifier_weight: float = 0.7, anomaly_weight: float = 0.3
) -> DataFrame:
    """Flows with anomaly_score, attack_probability and severity."""
    features = ff.flow_feature_vector(flows, art.baseline, art.rate_stats, art.src_stats)
    scored = iforest.score(features, art.anomaly)
    scored = scored.withColumn("anomaly_score", iforest.flow_calibration())
    if art.classifier is not None:
        scored = trees.probability(scored, art.classifier, "classifier_score")
        blend = ensemble("classifier_score", "anomaly_score", classifier_weight, anomaly_weight)
    else:
        blend = F.col("anomaly_score")
    scores = scored.select("flow_id", "anomaly_score", blend.alias("attack_probability"))
    return flows.join(scores, "flow_id").withColumn("severity", flow_severity("attack_probability"))


def flow_scores(scored: DataFrame) -> DataFrame:
    return scored.select("flow_id", F.col("attack_probability").alias("flow_score"))


GRADED_COLUMNS = [
    "flow_id", "src_ip", "dst_ip", "segment", "dst_port", "attack_probability", "severity", "attack_type",
]


def grade(flows: DataFrame, art: FlowArtifacts) -> DataFrame:
    """Scores a flow table with stored artifacts and applies the known signatures."""
    return cti_overrides(score(flows, art)).select(*GRADED_COLUMNS)


def threat_report(graded: DataFrame) -> DataFrame:
    """Threats (see ``count_threats``) by severity and kind of attack, and their highest probability."""
    return graded.where(F.coalesce(F.col("severity") != "NORMAL", F.lit(False))).groupBy("severity", "attack_type").agg(
        F.count(F.lit(1)).alias("n_flows"), F.countDistinct("src_ip").alias("n_sources"),
        F.max("attack_probability").alias("max_probability"),
    )


def count_threats(graded: DataFrame) -> DataFrame:
    """Flows above NORMAL; a flow in no severity bin is not a threat."""
    threat = F.coalesce(F.col("severity") != "NORMAL", F.lit(False))
    return graded.agg(
        F.count(F.lit(1)).alias("n_flows"), F.count_if(threat).alias("n_threats")
    ).withColumn("n_normal", F.col("n_flows") - F.col("n_threats"))
