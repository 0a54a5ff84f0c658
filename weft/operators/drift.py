"""Drift between a reference table and a new one: KS and chi-square by column, and an adversarial classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import roc_auc
from ..functions.stats import chi2_sf, ks_p
from ..plans.ordering import hash_index, percentiles, running_sums
from .transforms import numeric_columns


def ks_statistic(df: DataFrame, value: str, is_new: Column) -> DataFrame:
    """One row: d, n_ref, n_new. The largest distance of the two distribution functions, over distinct values."""
    t = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(~is_new).alias("a"), F.count_if(is_new).alias("b"))
    c = running_sums(t, "v", ["a", "b"])
    total = t.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    c = c.crossJoin(F.broadcast(total))
    return c.groupBy("na", "nb").agg(F.max(F.abs(F.col("cum_a") / F.col("na") - F.col("cum_b") / F.col("nb"))).alias("d")).select("d", F.col("na").alias("n_ref"), F.col("nb").alias("n_new"))


def chi2_statistic(df: DataFrame, value: str, is_new: Column) -> DataFrame:
    """One row: chi2, dof, over the union of levels (as text), without correction; dof 0 for a single level."""
    t = df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("nan")).alias("v")).agg(F.count_if(~is_new).alias("a"), F.count_if(is_new).alias("b"))
    total = t.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), (F.count(F.lit(1)) - 1).alias("dof"))
    t = t.crossJoin(F.broadcast(total))
    n, m = F.col("na") + F.col("nb"), F.col("a") + F.col("b")
    ea, eb = m * F.col("na") / n, m * F.col("nb") / n
    return t.groupBy("dof").agg(F.sum(F.pow(F.col("a") - ea, 2) / ea + F.pow(F.col("b") - eb, 2) / eb).alias("chi2")).select("chi2", "dof")


def together(reference: DataFrame, new: DataFrame) -> DataFrame:
    common = [c for c in reference.columns if c in new.columns]
    return reference.select(*common, F.lit(False).alias("__new")).unionByName(new.select(*common, F.lit(True).alias("__new")))


def drift(reference: DataFrame, new: DataFrame, threshold: float = 0.05, exclude: tuple[str, ...] = ()) -> DataFrame:
    """feature, test, statistic, p_value, shifted: KS for numbers, chi-square for others."""
    both, rows = together(reference, new), []
    numbers = set(numeric_columns(reference))
    for c in both.columns:
        if c == "__new" or c in exclude:
            continue
        if c in numbers:
            r = ks_statistic(both, c, F.col("__new")).first()
            p = ks_p(r["d"], r["n_ref"], r["n_new"]) if r and r["d"] is not None else 1.0
            rows.append((c, "ks", float(r["d"] or 0.0) if r else 0.0, p, p < threshold))
        else:
            r = chi2_statistic(both, c, F.col("__new")).first()
            p = chi2_sf(r["chi2"], r["dof"]) if r and r["dof"] else 1.0
            rows.append((c, "chi2", float(r["chi2"] or 0.0) if r else 0.0, p, p < threshold))
    return reference.sparkSession.createDataFrame(rows, "feature string, test string, statistic double, p_value double, shifted boolean")


def verdict(found: DataFrame) -> DataFrame:
    """One row: shifted, share of shifted features, severity (none, low below a tenth, medium below three tenths, high)."""
    share = F.avg(F.col("shifted").cast("double"))
    return found.agg(F.coalesce(F.max("shifted"), F.lit(False)).alias("shifted"), F.coalesce(share, F.lit(0.0)).alias("share")).withColumn(
        "severity", F.when(F.col("share") == 0, "none").when(F.col("share") < 0.1, "low").when(F.col("share") < 0.3, "medium").otherwise("high")
    )


def adversarial(reference: DataFrame, new: DataFrame, id_cols: list[str], folds: int = 5, seed: int = 42, trees: int = 100) -> dict:
    """How well a forest tells the two tables apart, out of fold: auc, distinguishable (above 0.6), severity and importances."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    numbers = [c for c in numeric_columns(reference) if c in new.columns and c not in id_cols]
    both = together(reference, new)
    medians = {c: v[0] for c, v in percentiles(both, {c: [0.5] for c in numbers}).items()}
    both = both.na.fill({c: v for c, v in medians.items() if v is not None}).withColumn("__y", F.col("__new").cast("double"))
    both = hash_index(both, [*id_cols, "__new"], seed, ["__new"]).withColumn("__fold", ((F.col("__rn") - 1) % folds).cast("int"))
    ready = VectorAssembler(inputCols=numbers, outputCol="__x", handleInvalid="skip").transform(both).select("__x", "__y", "__fold").persist()
    scored, importance = None, [0.0] * len(numbers)
    for k in range(folds):
        model = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, seed=seed + k).fit(ready.where(F.col("__fold") != k))
        importance = [a + b / folds for a, b in zip(importance, model.featureImportances.toArray(), strict=True)]
        one = model.transform(ready.where(F.col("__fold") == k)).select("__y", vector_to_array("probability")[1].alias("p"))
        scored = one if scored is None else scored.unionByName(one)
    auc = roc_auc(scored, F.col("__y") == 1, "p").first()["auc"]
    ready.unpersist()
    severity = "none" if auc < 0.55 else "low" if auc < 0.65 else "medium" if auc < 0.8 else "high"
    top = sorted(zip(numbers, importance, strict=True), key=lambda x: (-x[1], x[0]))[:10]
    return {"auc": auc, "distinguishable": auc > 0.6, "severity": severity, "importances": top}


def windowed_counts(events: DataFrame, time: str, column: str, width: str) -> DataFrame:
    """Counts of levels by time window, for drift over time."""
    return events.groupBy(F.window(time, width).alias("w"), F.col(column)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), column, "n", (F.col("n") / F.sum("n").over(Window.partitionBy("w"))).alias("share"))
