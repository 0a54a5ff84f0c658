"""An extension: profiles and drift over event streams, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf
from ..operators.drift import chi2_statistic, together


def window_profile(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows, mean and extremes of a value for each level and time window; works on streams and tables alike."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    marked = events.withWatermark(time, late) if events.isStreaming else events
    t = marked.groupBy(window.alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return t.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "mean", "low", "high")


def session_profile(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each user's sessions, which end after a gap."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    t = marked.groupBy(F.session_window(time, gap).alias("w"), F.col(user)).agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")


def watch_drift(events: DataFrame, reference: DataFrame, column: str, sink, checkpoint: str, threshold: float = 0.05):
    """For every micro-batch, ``sink(batch id, chi2, p_value, shifted)`` of a column against a reference table."""

    def step(batch: DataFrame, number: int) -> None:
        r = chi2_statistic(together(reference.select(column), batch.select(column)), column, F.col("__new")).first()
        p = chi2_sf(r["chi2"], r["dof"]) if r and r["dof"] else 1.0
        sink(number, float(r["chi2"] or 0.0) if r else 0.0, p, p < threshold)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_table(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
