"""Combining predictions: blends, threshold search, calibration and stacking."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, DataError
from ..plans.ordering import searchsorted, value_index


def blend(df: DataFrame, columns: list[str], method: str = "mean", weights: list[float] | None = None, power: float = 1.0, id_cols: list[str] | None = None, out: str = "blend") -> DataFrame:
    """Add a blend of prediction columns: mean (weighted), rank, geometric or power."""
    weights = weights or [1 / len(columns)] * len(columns)
    if len(weights) != len(columns) or abs(sum(weights) - 1) > 1e-6:
        raise ConfigError("weights must be one a column and sum to 1")
    if any(isinstance(df.schema[c].dataType, T.StringType) for c in columns):
        raise DataError("labels can't be blended; give probabilities or values")
    if method == "rank":
        if not id_cols:
            raise ConfigError("rank needs id_cols to order ties")
        for k, c in enumerate(columns):
            df = value_index(df, c, id_cols, f"__r{k}", f"__n{k}")
        value = _sum([w * F.col(f"__r{k}") / F.col(f"__n{k}") for k, w in enumerate(weights)])
        return df.withColumn(out, value).drop(*[f"__{x}{k}" for k in range(len(columns)) for x in "rn"])
    geometric = F.exp(_sum([w * F.log(_clip(F.col(c))) for c, w in zip(columns, weights, strict=True)]))
    values = {
        "mean": _sum([w * F.col(c) for c, w in zip(columns, weights, strict=True)]),
        "geometric": geometric,
        "power": geometric if abs(power) < 1e-12 else F.pow(_sum([w * F.pow(F.col(c), F.lit(float(power))) for c, w in zip(columns, weights, strict=True)]), F.lit(1 / power if power else 1.0)),
    }
    if method not in values:
        raise ConfigError(f"unknown method {method!r}")
    return df.withColumn(out, values[method])


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))


def threshold_table(df: DataFrame, y: Column, prob: str, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, fn, tn, precision, recall, f1, accuracy: all thresholds from one pass.

    Rows are counted by how many thresholds they reach; sums over those counts (as many as thresholds) give each cell.
    """
    ts = sorted(thresholds)
    reach = _sum([(F.col(prob) >= t).cast("int") for t in ts])
    cells = df.groupBy(reach.alias("k")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(ts)])).alias("s")
    t = cells.select("k", "pos", "neg", rows)
    hit = F.col("k") >= F.col("s.i")
    t = t.groupBy(F.col("s.threshold").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def optimize_threshold(df: DataFrame, y: Column, prob: str, metric: str = "f1") -> dict:
    """The best threshold: a grid of 0.05, then 0.005 within 0.1 of its best, never below max(0.001, 1 / positives)."""
    floor = max(0.001, 1 / max(1, df.agg(F.count_if(y)).first()[0]))

    def best(grid):
        grid = sorted({round(max(floor, t), 6) for t in grid})
        r = threshold_table(df, y, prob, grid).orderBy(F.desc(metric), "threshold").first()
        return r["threshold"], r[metric]

    first, _ = best([0.05 * k for k in range(1, 20)])
    t, v = best([first + 0.005 * k for k in range(-20, 21) if 0 < first + 0.005 * k < 1])
    return {"threshold": t, metric: v}


# Calibration


def pool_adjacent(x: list[float], y: list[float], w: list[float]) -> tuple[list[float], list[float]]:
    """Isotonic fit of points ordered by x: block means of x and y."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]


#: Distinct (binned) probabilities that calibration looks at on the driver.
POINTS = 10_000


def _points(df: DataFrame, y: Column, prob: str):
    """Mean probability, mean truth and weight of at most ``POINTS`` equal bins of the probability, in order."""
    b = F.least(F.floor(F.col(prob) * POINTS), F.lit(POINTS - 1))
    rows = df.where(F.col(prob).isNotNull()).groupBy(b.alias("b")).agg(F.avg(prob).alias("x"), F.avg(y.cast("double")).alias("y"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    return [r["x"] for r in rows], [r["y"] for r in rows], [float(r["n"]) for r in rows]


class Calibrator:
    """Maps a probability column: isotonic by interpolation between block means, or a sigmoid."""

    def __init__(self, method: str, x: list[float] | None = None, y: list[float] | None = None, a: float = 1.0, b: float = 0.0):
        self.method, self.x, self.y, self.a, self.b = method, x, y, a, b

    def column(self, p: Column) -> Column:
        if self.method == "sigmoid":
            return 1 / (1 + F.exp(-(self.a * p + self.b)))
        if len(self.x) == 1:
            return F.lit(self.y[0])
        xs, ys = (F.array(*[F.lit(float(v)) for v in values]) for values in (self.x, self.y))
        # The piece between the last point that a value reaches and the next one.
        k = F.least(F.greatest(searchsorted([float(v) for v in self.x], p), F.lit(1)), F.lit(len(self.x) - 1))
        x0, x1, y0, y1 = (F.element_at(v, k + d) for v in (xs, ys) for d in (0, 1))
        out = F.when(p <= self.x[0], F.lit(self.y[0])).when(p >= self.x[-1], F.lit(self.y[-1])).otherwise(y0 + (p - x0) * ((y1 - y0) / (x1 - x0)))
        return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))

    def transform(self, df: DataFrame, prob: str, out: str = "calibrated") -> DataFrame:
        return df.withColumn(out, self.column(F.col(prob)))


def calibrate(df: DataFrame, y: Column, prob: str, method: str = "auto") -> Calibrator:
    """isotonic for 1,000 rows or more, else sigmoid; at least 100 rows."""
    x, t, w = _points(df, y, prob)
    n = sum(w)
    if n < 100:
        raise DataError("calibration needs at least 100 rows")
    if method == "auto":
        method = "isotonic" if n >= 1000 else "sigmoid"
    if method == "isotonic":
        xs, ys = pool_adjacent(x, t, w)
        return Calibrator("isotonic", xs, ys)
    if method != "sigmoid":
        raise ConfigError(f"unknown method {method!r}")
    a, b = 1.0, 0.0
    xv, tv, wv = map(np.array, (x, t, w))
    for _ in range(1000):
        gap = wv * (1 / (1 + np.exp(-(a * xv + b))) - tv) / n
        a, b = a - 0.1 * float((gap * xv).sum()), b - 0.1 * float(gap.sum())
    return Calibrator("sigmoid", a=a, b=b)


def vote(df: DataFrame, columns: list[str], out: str = "vote") -> DataFrame:
    """The most frequent label of several columns, of ties the smallest."""
    labels = F.array(*[F.col(c) for c in columns])
    counted = F.transform(F.array_distinct(labels), lambda v: F.struct((-F.size(F.filter(labels, lambda x: x == v))).alias("n"), v.alias("v")))
    return df.withColumn(out, F.array_min(counted)["v"])


def seed_average(frames: list[DataFrame], on: list[str], prob: str) -> DataFrame:
    """Mean and deviation of predictions of several seeds."""
    both = reduce(lambda a, b: a.unionByName(b), [f.select(*on, prob) for f in frames])
    return both.groupBy(*on).agg(F.avg(prob).alias(prob), F.coalesce(F.stddev_samp(prob), F.lit(0.0)).alias("seed_std"))


def log_odds(p: float) -> float:
    return math.log(p / (1 - p))
