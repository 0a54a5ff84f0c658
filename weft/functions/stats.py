"""Probability functions of a few statistics (on the driver), p-value corrections and tests as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - h * front)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    return 1.0 if dof <= 0 or x <= 0 else 1 - gamma_p(dof / 2, x / 2)


def t_sf2(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_i(dof / 2, 0.5, dof / (dof + t * t))


def ks_p(d: float, n: int, m: int) -> float:
    """Asymptotic Kolmogorov p-value, without a small-sample correction."""
    if n == 0 or m == 0 or d <= 0:
        return 1.0
    lam = d * math.sqrt(n * m / (n + m))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k + 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 100))))


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> dict[str, float]:
    """McNemar's test with continuity correction of two predictions against the truth."""
    right_a, right_b = F.col(a).eqNullSafe(F.col(y)), F.col(b).eqNullSafe(F.col(y))
    r = df.agg(F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c")).first()
    n = r["b"] + r["c"]
    stat = 0.0 if n == 0 else (abs(r["b"] - r["c"]) - 1) ** 2 / n
    return {"b": r["b"], "c": r["c"], "statistic": stat, "p_value": 1.0 if n == 0 else chi2_sf(stat, 1)}


def paired_t(df: DataFrame, y: str, a: str, b: str) -> dict[str, float]:
    """Paired t-test of the absolute errors of two predictions."""
    gap = F.abs(F.col(y) - F.col(a)) - F.abs(F.col(y) - F.col(b))
    r = df.agg(F.count(gap).alias("n"), F.avg(gap).alias("m"), F.stddev_samp(gap).alias("s")).first()
    if not r["s"] or r["n"] < 2:
        return {"n": r["n"], "statistic": 0.0, "p_value": 1.0}
    t = r["m"] / (r["s"] / math.sqrt(r["n"]))
    return {"n": r["n"], "statistic": t, "p_value": t_sf2(t, r["n"] - 1)}


def adjust(df: DataFrame, p: str, method: str = "bh", alpha: float = 0.05, ties: list[str] | None = None) -> DataFrame:
    """Corrected p-values: ``p_adj`` and ``significant``. NULL and NaN stay uncorrected and don't count.

    A table of p-values holds one row a test, so the ordered window over it is small.
    """
    live = F.col(p).isNotNull() & ~F.isnan(p)
    order = [F.col(p).asc(), *map(F.col, ties or [])]
    m = F.count_if(live).over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(live).orderBy(*order))
    t = df.withColumn("__m", m).withColumn("__k", rank).withColumn("__live", live)
    by = Window.partitionBy("__live")
    if method == "bonferroni":
        raw = F.col(p) * F.col("__m")
        value = raw
    elif method == "holm":
        raw = F.col(p) * (F.col("__m") - F.col("__k") + 1)
        value = F.max(raw).over(by.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bh":
        raw = F.col(p) * F.col("__m") / F.col("__k")
        value = F.min(raw).over(by.orderBy(F.col("__k").desc()).rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(f"unknown correction {method!r}: bh, holm or bonferroni")
    out = t.withColumn("p_adj", F.when(F.col("__live"), F.least(value, F.lit(1.0))))
    return out.withColumn("significant", F.coalesce(F.col("p_adj") <= alpha, F.lit(False))).drop("__m", "__k", "__live")
