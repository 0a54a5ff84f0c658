"""Rows ready to plot; drawing is left to other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import running_sums


def roc_points(df: DataFrame, y: Column, score: str) -> DataFrame:
    """threshold, fpr, tpr at every distinct score."""
    t = df.groupBy(F.col(score).alias("s")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    total = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    c = running_sums(t, "s", ["pos", "neg"]).crossJoin(F.broadcast(total))
    return c.select(F.col("s").alias("threshold"), ((F.col("n") - F.col("cum_neg") + F.col("neg")) / F.col("n")).alias("fpr"), ((F.col("p") - F.col("cum_pos") + F.col("pos")) / F.col("p")).alias("tpr"))


def residual_bins(df: DataFrame, y: str, p: str, width: float) -> DataFrame:
    """Counts of residuals by bin of a width."""
    return df.groupBy(F.floor((F.col(y) - F.col(p)) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def partial_dependence(model, df: DataFrame, feature: str, values: list[float]) -> DataFrame:
    """Mean prediction with a feature set to each value."""
    out = df.withColumn(feature, F.explode(F.array(*[F.lit(float(v)) for v in values]))).withColumn("__v", F.col(feature))
    value = "prediction" if model.task == "regression" else f"probability_{model.classes[-1]}"
    return model.predict(out).groupBy(F.col("__v").alias("value")).agg(F.avg(value).alias("mean"))


def waterfall(importances: dict[str, float]) -> list[tuple[str, float, float]]:
    """Name, start and end of each bar."""
    out, at = [], 0.0
    for name, v in sorted(importances.items(), key=lambda x: (-x[1], x[0])):
        out.append((name, at, at + v))
        at += v
    return out
