import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import metrics
from weft.operators.ensemble import Calibrator
from weft.plans import ordering as O


@pytest.fixture
def small(monkeypatch):
    """Bounds as if tables were large."""
    monkeypatch.setattr(O, "BUCKET_ROWS", 50)
    monkeypatch.setattr(O, "BUCKETS", 64)
    monkeypatch.setattr(O, "FEW_VALUES", 200)


def values(n=4000):
    rng = random.Random(5)
    some = [rng.choice([rng.gauss(0, 1), 0.25, float(rng.randrange(20)), -1e15]) for _ in range(n)]
    return [*some, 1e15, float("inf"), None, None]


def largest_bucket(df, bucket):
    return df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0]


def test_one_outlier_and_a_hot_value_do_not_fill_a_bucket(spark, small):
    df = spark.createDataFrame([(k, float(k % 1000) if k % 3 else 7.0) for k in range(3000)] + [(9999, 1e15)], "id long, v double")
    assert largest_bucket(df, O.value_bucket(df, F.col("v"), O._above, ["id"])) < 300
    day = dt.datetime(2024, 5, 1)
    times = spark.createDataFrame([(k, day + dt.timedelta(seconds=k % 800 if k % 4 else 0) if k < 2900 else day + dt.timedelta(days=k)) for k in range(3000)], "id long, t timestamp")
    assert largest_bucket(times, O.value_bucket(times, F.unix_micros("t"), lambda v: v + 1, ["id"])) < 300


def test_indexes_equal_a_global_sort(spark, small):
    rows = [(k * 7919 % 4001, v) for k, v in enumerate(values())]
    df = spark.createDataFrame(rows, "id long, v double")
    want = {(i, v): n + 1 for n, (i, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])))}
    assert {(r.id, r.v): r["__rn"] for r in O.value_index(df, "v", ["id"]).collect()} == want
    day = dt.datetime(2024, 5, 1)
    stamped = [(i, None if v is None else day + dt.timedelta(seconds=int(max(-1e6, min(1e6, v)) * 100))) for i, v in rows]
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(stamped, key=lambda r: (r[1] is not None, r[1] or day, r[0])))}
    df = spark.createDataFrame(stamped, "id long, t timestamp")
    assert {r.id: r["__rn"] for r in O.time_index(df, "t", ["id"]).collect()} == want
    assert O.time_index(df.limit(0), "t", ["id"]).count() == 0


def test_running_sums_by_part(spark, small):
    rows = [(p, float(v), v % 5) for p in ("a", "b", "c") for v in range(-300, 500)]
    got = O.running_sums(spark.createDataFrame(rows, "p string, v double, n long"), "v", ["n"], ["p"]).collect()
    assert len(got) == len(rows) and all(r.cum_n == sum(n for p, v, n in rows if p == r.p and v <= r.v) for r in got[::97])


def test_percentiles_close_in_on_ranks(spark, small):
    v = values()
    df = spark.createDataFrame([(x, None, 3.0, k % 700) for k, x in enumerate(v)], "a double, `b.c` double, c double, d int")
    shares = [0.0, 0.1, 0.25, 0.333, 0.5, 0.75, 0.999]
    found = O.percentiles(df, {"a": shares, "b.c": [0.5], "c": [0.5], "d": shares})
    want = df.agg(F.expr(f"percentile(a, array({', '.join(map(str, shares))}))"), F.expr(f"percentile(d, array({', '.join(map(str, shares))}))")).first()
    assert found["a"] == pytest.approx(want[0]) and found["d"] == pytest.approx(want[1])
    assert found["b.c"] == [None] and found["c"] == [3.0] and O.percentiles(df, {}) == {}


def test_searchsorted(spark):
    bounds = sorted(random.Random(1).uniform(-5, 5) for _ in range(83))
    tried = [*bounds, -9.0, 9.0, 0.0, float("inf")]
    rows = spark.createDataFrame([(x,) for x in tried], "v double").select("v", O.searchsorted(bounds, F.col("v")).alias("k")).collect()
    assert [r.k for r in rows] == np.searchsorted(bounds, tried, side="right").tolist()


def test_ovr_auc_and_many_calibration_pieces(spark, small):
    rng = random.Random(3)
    rows = [("xyz"[rng.randrange(3)], round(rng.random(), 3), rng.random(), rng.random()) for _ in range(1500)]
    df = spark.createDataFrame(rows, "y string, px double, py double, pz double")

    def auc(c, k):
        pos, neg = [r[k] for r in rows if r[0] == c], [r[k] for r in rows if r[0] != c]
        return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]), len(pos)

    parts = [auc(c, k) for k, c in enumerate("xyz", 1)]
    want = sum(a * n for a, n in parts) / sum(n for _, n in parts)
    assert metrics.roc_auc_ovr(df, "y", {"x": "px", "y": "py", "z": "pz"}).first()["auc"] == pytest.approx(want)
    xs = sorted({round(rng.random(), 6) for _ in range(2000)})
    ys = sorted(rng.random() for _ in xs)
    tried = spark.createDataFrame([(rng.random(),) for _ in range(300)] + [(xs[5],), (0.0,), (1.0,)], "p double")
    got = Calibrator("isotonic", xs, ys).transform(tried, "p").collect()
    assert [r.calibrated for r in got] == pytest.approx(np.interp([r.p for r in got], xs, ys))
