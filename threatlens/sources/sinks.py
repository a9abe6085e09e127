"""Result writers: fixed column order and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import round_even

CORRELATION_COLUMNS = [
    "flow_id", "attack_probability", "severity", "agents_fired", "boost_applied",
    "mitre_technique", "predicted_category",
]
TRIAGE_COLUMNS = ["flow_id", "predicted_tp", "attack_probability", "severity_label"]
SHORTLIST_COLUMNS = [
    "flow_id", "affected_asset", "attack_probability", "severity_label", "segment", "mitre_technique",
]
FINAL_COLUMNS = [
    "flow_id", "attack_probability", "attack_decision", "attack_category_predicted",
    "mitre_technique_predicted",
]


def shaped(df: DataFrame, columns: list[str], decimals: dict[str, int] | None = None) -> DataFrame:
    """The output columns in their order, scores rounded."""
    decimals = decimals or {}
    return df.select(
        *[round_even(c, decimals[c]).alias(c) if c in decimals else F.col(c) for c in columns]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested findings as JSON lines."""
    findings.write.mode(mode).json(path)
