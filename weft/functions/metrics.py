"""Scoring metrics as Spark aggregates over a table of truths and predictions.

Each function takes a DataFrame and column names and returns a one-row DataFrame or a small one; nothing but the answer
comes to the driver. Labels order by value; the positive class of precision, recall and F1 is 1 where it occurs among integers, else the
minority class; that of AUC, log loss and Brier is the larger class.
"""

from __future__ import annotations

from difflib import get_close_matches

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import running_sums


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def per_label(df: DataFrame, y: str, p: str) -> DataFrame:
    """Label, tp, fp, fn, support, precision, recall and f1 for the union of labels."""
    cells = confusion(df, y, p)
    sides = cells.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(True).alias("truth")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("truth")))).alias("s"), "actual", "predicted", "n")
    hit = F.col("actual") == F.col("predicted")
    t = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.sum(F.when(F.col("s.truth") & hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("s.truth") & ~hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("s.truth") & ~hit, F.col("n")).otherwise(0)).alias("fn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    t = t.withColumn("support", F.col("tp") + F.col("fn"))
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averaged(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: macro and weighted precision, recall and f1."""
    t = per_label(df, y, p)
    out = []
    for m in ("precision", "recall", "f1"):
        out.append(F.avg(m).alias(f"{m}_macro"))
        out.append(F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"{m}_weighted"))
    return t.agg(*out)


def positive_label(df: DataFrame, y: str):
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).orderBy("n", y).collect()
    labels = [r[y] for r in counts]
    if all(isinstance(v, int) and not isinstance(v, bool) for v in labels):
        return 1 if 1 in labels else max(labels)
    return labels[0]


def binary(df: DataFrame, y: str, p: str, positive) -> DataFrame:
    """One row: precision, recall, f1 of the positive label, in one aggregate."""
    a, b = F.coalesce(F.col(y) == F.lit(positive), F.lit(False)), F.coalesce(F.col(p) == F.lit(positive), F.lit(False))
    t = df.agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"))
    zero = lambda x, d: F.when(d > 0, x / d).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.select(zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def accuracy(y: str, p: str) -> Column:
    return F.coalesce(F.avg((F.col(y) == F.col(p)).cast("double")), F.lit(0.0))


def roc_auc(df: DataFrame, y: Column, score: str) -> DataFrame:
    """One row: auc. ``y`` is a boolean column, true for the positive class. Ties count half."""
    t = df.select(y.cast("int").alias("y"), F.col(score).alias("s")).groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    c = running_sums(t, "s", ["neg"])
    area = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2))
    return c.agg((area / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))


def roc_auc_ovr(df: DataFrame, y: str, probabilities: dict) -> DataFrame:
    """One row: one-versus-rest AUC weighted by class counts. ``probabilities``: class -> column."""
    parts = F.array(*[F.struct(F.lit(k).alias("c"), F.col(v).cast("double").alias("s")) for k, v in sorted(probabilities.items())])
    t = df.select(F.col(y).alias("y"), F.explode(parts).alias("x")).select(F.col("x.c").alias("c"), F.col("x.s").alias("s"), (F.col("y") == F.col("x.c")).cast("int").alias("pos"))
    t = t.groupBy("c", "s").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    t = running_sums(t, "s", ["neg"], ["c"]).withColumn("below", F.col("cum_neg") - F.col("neg"))
    t = t.groupBy("c").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p > 0 and n > 0")
    return t.agg(F.coalesce(F.sum(F.col("area") / (F.col("p") * F.col("n")) * F.col("p")) / F.sum("p"), F.lit(0.5)).alias("auc"))


def log_loss(y: Column, prob: Column) -> Column:
    """Mean binary log loss; ``y`` is 1 for the positive class."""
    p = F.least(F.greatest(prob, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))


def brier(y: Column, prob: Column) -> Column:
    return F.avg((prob - y) * (prob - y))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST; 0 where the truth is constant."""
    total = F.var_pop(y)
    return F.when(total > 0, 1 - F.avg((y - p) * (y - p)) / total).otherwise(F.lit(0.0))


def mape(y: Column, p: Column) -> Column:
    return F.coalesce(F.avg(F.when(y != 0, F.abs((y - p) / y))), F.lit(float("inf")))


def smape(y: Column, p: Column) -> Column:
    scale = F.abs(y) + F.abs(p)
    return F.avg(F.when(scale > 0, 2 * F.abs(y - p) / scale).otherwise(F.lit(0.0)))


def rmsle(y: Column, p: Column) -> Column:
    gap = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(F.greatest(y, F.lit(0.0)))
    return F.sqrt(F.avg(gap * gap))


def log_cosh(y: Column, p: Column) -> Column:
    x = F.abs(p - y)
    return F.avg(x + F.log1p(F.exp(-2 * x)) - F.lit(0.6931471805599453))


def mcc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Matthews correlation for any number of classes, from confusion counts; 0 where undefined."""
    t = per_label(df, y, p).agg(
        F.sum("tp").alias("c"), F.sum("support").alias("s"),
        F.sum((F.col("tp") + F.col("fp")) * F.col("support")).alias("pt"),
        F.sum(F.pow(F.col("tp") + F.col("fp"), 2)).alias("pp"), F.sum(F.pow("support", F.lit(2))).alias("tt"),
    )
    s2 = F.col("s").cast("double") * F.col("s")
    below = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    return t.select(F.when(below > 0, (F.col("c").cast("double") * F.col("s") - F.col("pt")) / below).otherwise(F.lit(0.0)).alias("mcc"))


def kappa(df: DataFrame, y: str, p: str, weights: str | None = None) -> DataFrame:
    """Cohen's kappa; linear or quadratic weights use the distance between label positions, not values."""
    cells = confusion(df, y, p)
    labels = cells.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    place = labels.select("label", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1).alias("i"))
    t = cells.join(place.toDF("actual", "i"), "actual").join(place.toDF("predicted", "j"), "predicted")
    rows = t.groupBy("i").agg(F.sum("n").alias("a"))
    columns = t.groupBy("j").agg(F.sum("n").alias("b"))
    gap = F.abs(F.col("i") - F.col("j"))
    cost = {None: (gap > 0).cast("double"), "linear": gap.cast("double"), "quadratic": (gap * gap).cast("double")}[weights]
    seen = t.agg(F.sum(cost * F.col("n")).alias("o"), F.sum("n").alias("n"))
    # Label positions against label positions: as many rows as the confusion matrix has cells.
    hoped = rows.crossJoin(F.broadcast(columns)).agg(F.sum(cost * F.col("a") * F.col("b")).alias("e"))
    share = F.col("o") * F.col("n") / F.col("e")
    return seen.crossJoin(F.broadcast(hoped)).select(F.when(F.col("e") > 0, 1 - share).otherwise(F.lit(0.0)).alias("kappa"))


def weighted(y: Column, p: Column, w: Column, task: str) -> list[Column]:
    """Sample-weighted metrics."""
    mean = lambda x: F.sum(w * x) / F.sum(w)
    if task == "classification":
        return [mean((y == p).cast("double")).alias("accuracy_weighted")]
    sse, centre = mean((y - p) * (y - p)), F.sum(w * y * y) / F.sum(w) - F.pow(F.sum(w * y) / F.sum(w), 2)
    return [F.sqrt(sse).alias("rmse_weighted"), mean(F.abs(y - p)).alias("mae_weighted"), F.when(centre > 0, 1 - sse / centre).otherwise(F.lit(0.0)).alias("r2_weighted")]


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weight n / (K * n_c) of each class."""
    t = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    every = Window.partitionBy(F.lit(0))
    return t.withColumn("weight", F.sum("n_c").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_c")))


def calibration_bins(df: DataFrame, y: Column, prob: str, bins: int = 10) -> DataFrame:
    """Reliability diagram: bin, n, mean predicted and observed share."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_predicted"), F.avg(y.cast("double")).alias("observed"))


def bootstrap(df: DataFrame, id_cols: list[str], metric: Column, replicates: int = 200, seed: int = 42, weight: str = "__w") -> DataFrame:
    """Metric of each replicate, of rows weighted by Poisson(1) counts drawn from a hash of row and replicate.

    ``metric`` is an aggregate over the column ``weight``. All replicates are one job, and a row's draws don't depend on
    where it is computed.
    """
    draw = F.pmod(F.xxhash64(*id_cols, F.col("replicate"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cuts, total, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        cuts.append(total)
        term /= k + 1
    count = sum(((draw >= c).cast("int") for c in cuts[1:]), (draw >= cuts[0]).cast("int"))
    t = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn(weight, count).where(F.col(weight) > 0)
    return t.groupBy("replicate").agg(metric.alias("value"))


def interval(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """One row: standard error (10 replicates or more) and percentile interval (100 or more)."""
    a = (1 - level) / 2
    n = F.count("value")
    return replicates.agg(
        F.when(n >= 10, F.stddev_samp("value")).alias("se"),
        F.when(n >= 100, F.expr(f"percentile(value, {a})")).alias("low"),
        F.when(n >= 100, F.expr(f"percentile(value, {1 - a})")).alias("high"),
    )


#: name -> (kind, greater is better). Kind: label (y, p), proba (y, probability), value (numeric y, p).
REGISTRY: dict[str, tuple[str, bool]] = {
    "accuracy": ("label", True), "precision": ("label", True), "recall": ("label", True), "f1": ("label", True), "f1_macro": ("label", True),
    "f1_weighted": ("label", True), "mcc": ("label", True), "kappa": ("label", True), "qwk": ("label", True), "roc_auc": ("proba", True),
    "gini": ("proba", True), "log_loss": ("proba", False), "brier": ("proba", False), "rmse": ("value", False), "mae": ("value", False),
    "r2": ("value", True), "mape": ("value", False), "smape": ("value", False), "rmsle": ("value", False), "log_cosh": ("value", False),
}


def score(df: DataFrame, metric: str, y: str, p: str | None = None, prob: str | None = None, positive=None) -> float:
    """One registered metric as a number."""
    if metric not in REGISTRY:
        near = get_close_matches(metric, REGISTRY, 3)
        raise ValueError(f"unknown metric {metric!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    kind, _ = REGISTRY[metric]
    if kind == "value":
        return df.agg(globals()[metric](F.col(y), F.col(p)).alias("v")).first()["v"]
    if kind == "proba":
        top = df.agg(F.max(y)).first()[0] if positive is None else positive
        is_top = F.col(y) == F.lit(top)
        if metric in ("roc_auc", "gini"):
            auc = roc_auc(df, is_top, prob).first()["auc"]
            return auc if metric == "roc_auc" or auc is None else 2 * auc - 1
        return df.agg({"log_loss": log_loss, "brier": brier}[metric](is_top.cast("double"), F.col(prob)).alias("v")).first()["v"]
    if metric == "accuracy":
        return df.agg(accuracy(y, p).alias("v")).first()["v"]
    if metric in ("precision", "recall", "f1"):
        return binary(df, y, p, positive_label(df, y) if positive is None else positive).first()[metric]
    if metric in ("f1_macro", "f1_weighted"):
        return averaged(df, y, p).first()[metric]
    if metric == "mcc":
        return mcc(df, y, p).first()["mcc"]
    return kappa(df, y, p, "quadratic" if metric == "qwk" else None).first()["kappa"]


class Scorer:
    """A metric by name, or a Python callable ``f(DataFrame) -> float``."""

    def __init__(self, metric, greater_is_better: bool | None = None):
        self.metric = metric
        self.name = metric if isinstance(metric, str) else getattr(metric, "__name__", "custom")
        if isinstance(metric, str) and metric not in REGISTRY:
            score(None, metric, "")
        self.greater_is_better = REGISTRY[metric][1] if isinstance(metric, str) else bool(greater_is_better is None or greater_is_better)
        self.needs_proba = isinstance(metric, str) and REGISTRY[metric][0] == "proba"

    def __call__(self, df: DataFrame, y: str, p: str | None = None, prob: str | None = None) -> float:
        return score(df, self.metric, y, p, prob) if isinstance(self.metric, str) else float(self.metric(df))
