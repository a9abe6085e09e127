"""Standard scaling with population variance; a constant column keeps scale 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, scale), from one aggregate over the data."""
    stats = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.avg(c).alias("mean"),
                    F.stddev_pop(c).alias("scale"),
                )
                for c in features
            ]
        ).alias("s")
    )
    return stats.select(F.explode("s").alias("e")).select(
        "e.feature", "e.mean",
        F.when(F.col("e.scale") > 0, F.col("e.scale")).otherwise(F.lit(1.0)).alias("scale"),
    )


def as_dict(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """Means and scales on the driver: one small row per feature."""
    return {r["feature"]: (r["mean"] or 0.0, r["scale"]) for r in scaler.collect()}


def scaled(feature: str, stats: dict[str, tuple[float, float]]) -> Column:
    mean, scale = stats[feature]
    return (F.col(feature) - F.lit(mean)) / F.lit(scale)


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """Lazy form: the statistics are read by a scalar subquery."""
    row = scaler.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("m")
    )
    return df.withColumn("_s", row.scalar()).withColumns(
        {c: (F.col(c) - F.col("_s")[c]["mean"]) / F.col("_s")[c]["scale"] for c in features}
    ).drop("_s")
