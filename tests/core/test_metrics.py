import math
import random

import pytest
from pyspark.sql import functions as F

from weft.functions import metrics as M
from weft.functions import plots, stats
from weft.operators import ensemble


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(300):
        y = int(rnd.random() < 0.35)
        p = round(min(0.99, max(0.01, rnd.gauss(0.35 + 0.2 * y, 0.2))), 2)
        data.append((i, y, p, int(p >= 0.5), rnd.choice("abc"), rnd.choice("abcd"), rnd.gauss(0, 1), rnd.gauss(0, 1)))
    return spark.createDataFrame(data, "id long, y int, p double, h int, a string, b string, u double, v double").cache()


def test_auc_equals_pairs(rows):
    data = rows.collect()
    pos, neg = [r.p for r in data if r.y], [r.p for r in data if not r.y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.score(rows, "roc_auc", "y", prob="p") == pytest.approx(want)
    assert M.score(rows, "gini", "y", prob="p") == pytest.approx(2 * want - 1)
    assert M.score(rows.withColumn("p", 1 - F.col("p")), "roc_auc", "y", prob="p") == pytest.approx(1 - want)
    top = plots.roc_points(rows, F.col("y") == 1, "p").orderBy("threshold").first()
    assert (top.fpr, top.tpr) == (1.0, 1.0)


def test_label_metrics(rows):
    data = rows.collect()
    labels = sorted({r.a for r in data} | {r.b for r in data})
    f1, support = {}, {}
    for k in labels:
        tp = sum(r.a == k == r.b for r in data)
        pred, true = sum(r.b == k for r in data), sum(r.a == k for r in data)
        f1[k], support[k] = (2 * tp / (pred + true) if pred + true else 0), true
    assert M.score(rows, "f1_macro", "a", "b") == pytest.approx(sum(f1.values()) / len(labels))
    assert M.score(rows, "f1_weighted", "a", "b") == pytest.approx(sum(f1[k] * support[k] for k in labels) / 300)
    n = len(data)
    o = sum(r.a == r.b for r in data) / n
    e = sum(support[k] * sum(r.b == k for r in data) for k in labels) / n**2
    assert M.score(rows, "kappa", "a", "b") == pytest.approx((o - e) / (1 - e))
    tp, fp, fn, tn = (sum(1 for r in data if (r.y, r.h) == c) for c in ((1, 1), (0, 1), (1, 0), (0, 0)))
    want = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    assert M.score(rows, "mcc", "y", "h") == pytest.approx(want)
    assert M.score(rows, "f1", "y", "h") == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert M.score(rows, "qwk", "y", "y") == pytest.approx(1)


def test_edges(rows, spark):
    one = rows.withColumn("c", F.lit(1.0))
    assert M.score(one, "r2", "c", "u") == 0.0 and M.score(one.withColumn("z", F.lit(0.0)), "mape", "z", "u") == float("inf")
    assert M.score(rows.limit(0), "accuracy", "a", "b") == 0.0 and M.score(rows.withColumn("k", F.lit("a")), "mcc", "k", "k") == 0.0
    assert M.score(rows, "rmse", "u", "u") == 0.0 and M.score(rows, "rmsle", "u", "v") >= 0
    with pytest.raises(ValueError, match="roc_auc"):
        M.score(rows, "roc_auk", "y")
    s = M.Scorer("log_loss")
    assert s.needs_proba and not s.greater_is_better and s(rows, "y", prob="p") > 0
    assert M.Scorer(lambda d: d.count())(rows, "y") == 300.0


def test_tables_of_probabilities():
    assert stats.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05) and stats.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert stats.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05) and stats.t_sf2(0, 5) == pytest.approx(1)
    assert stats.ks_p(1.3580986, 10**9, 10**9) == 0.0 and stats.ks_p(0.1, 368, 370) == pytest.approx(0.05, abs=3e-3)
    assert stats.chi2_sf(0, 3) == 1.0


def test_corrections(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None), (5, 0.005), (6, float("nan"))], "i int, p double")
    got = {m: {r.i: r.p_adj for r in stats.adjust(p, "p", m).collect()} for m in ("bh", "holm", "bonferroni")}
    assert got["bh"] == {1: pytest.approx(0.02), 2: pytest.approx(0.04), 3: pytest.approx(0.04), 4: None, 5: pytest.approx(0.02), 6: None}
    assert got["holm"] == {1: pytest.approx(0.03), 2: pytest.approx(0.06), 3: pytest.approx(0.06), 4: None, 5: pytest.approx(0.02), 6: None}
    assert got["bonferroni"][2] == pytest.approx(0.16)


def test_significance(rows):
    assert stats.mcnemar(rows, "y", "h", "h")["p_value"] == 1.0
    assert stats.paired_t(rows, "u", "v", "v")["p_value"] == 1.0
    assert 0 <= stats.paired_t(rows.withColumn("w", F.col("v") + 5), "u", "v", "w")["p_value"] < 1e-6


def test_bootstrap(rows):
    reps = M.bootstrap(rows, ["id"], F.sum(F.col("__w") * F.col("u")) / F.sum("__w"), 150).cache()
    assert reps.count() == 150
    r, mean = M.interval(reps).first(), rows.agg(F.avg("u"), F.stddev_samp("u")).first()
    assert r.low < mean[0] < r.high and r.se == pytest.approx(mean[1] / math.sqrt(300), rel=0.3)


def test_threshold_and_blends(rows):
    t = {r.threshold: r for r in ensemble.threshold_table(rows, F.col("y") == 1, "p", [0.2, 0.5]).collect()}
    data = rows.collect()
    assert t[0.5].tp == sum(r.y and r.p >= 0.5 for r in data) and t[0.2].fp == sum(not r.y and r.p >= 0.2 for r in data)
    best = ensemble.optimize_threshold(rows, F.col("y") == 1, "p")
    assert best["f1"] >= max(r.f1 for r in t.values())
    b = rows.withColumn("q", F.pow("p", F.lit(10)))
    ranks = ensemble.blend(b, ["p"], "rank", id_cols=["id"]).select("id", "blend").exceptAll(ensemble.blend(b, ["q"], "rank", id_cols=["id"]).select("id", "blend"))
    assert ranks.count() == 0
    for m, kw in (("mean", {}), ("geometric", {}), ("power", {"power": 2.0}), ("power", {"power": 0.0})):
        same = ensemble.blend(rows, ["p", "p"], m, **kw)
        assert same.where(F.abs(F.col("blend") - F.col("p")) > 1e-9).count() == 0
    with pytest.raises(Exception, match="sum to 1"):
        ensemble.blend(rows, ["p"], weights=[0.5])


def test_calibration(rows):
    assert ensemble.pool_adjacent([1, 2, 3, 4], [0, 1, 0, 1], [1, 1, 1, 1]) == ([1.0, 2.5, 4.0], [0.0, 0.5, 1.0])
    for method in ("isotonic", "sigmoid"):
        out = ensemble.calibrate(rows, F.col("y") == 1, "p", method).transform(rows, "p").orderBy("p").collect()
        values = [r.calibrated for r in out]
        assert all(0 <= v <= 1 for v in values) and all(a <= b + 1e-12 for a, b in zip(values, values[1:], strict=False))
