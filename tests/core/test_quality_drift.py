import pytest
from pyspark.sql import functions as F

from weft.errors import DataError
from weft.operators import drift as D
from weft.operators import quality as Q


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.range(300).selectExpr("id", "id % 2 AS y", "(id * 7919) % 300 / 300.0D AS x", "(id % 2) + ((id * 31) % 17) / 100.0D AS leak", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) AS k")
    return t.cache()


def test_profile(rows):
    p = {r["column"]: r for r in Q.profile(rows).collect()}
    assert p["k"].missing == 100 and p["k"].missing_pct == 33.3 and p["k"].top == "a" and p["k"].top_freq == 100
    assert p["id"].unique == 300 and p["id"].median == 149.5 and p["x"].dtype == "double"
    assert Q.condition_number(rows.select("x", (F.col("x") * 2).alias("z"))) > 1e6


def test_check_data(rows, spark):
    found = {(r.check, r.feature) for r in Q.check_data(rows.withColumn("one", F.lit(1)), "y").collect()}
    assert ("id_like", "id") in found and ("zero_variance", "one") in found
    bad = rows.withColumn("y", F.when(F.col("id") > 5, F.col("y"))).withColumn("x", F.lit(float("inf")))
    with pytest.raises(DataError):
        Q.check_data(bad, "y", severity="error")
    twice = rows.drop("id").limit(20)
    assert "duplicates" in {r.check for r in Q.check_data(twice.union(twice)).collect()}


def stages(spark):
    """Rows that each stage wrote to a shuffle, by the stage's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}


def test_checks_count_a_column_at_a_time(spark):
    """No stage shuffles a row for each column of each row, and rows that an id tells apart aren't compared."""
    t = spark.createDataFrame([(i, f"n{i}", i % 7, float(i % 500), float(i % 1000)) for i in range(2000)], "id long, name string, seven long, x double, z double")
    for run in (lambda: Q.check_data(t), lambda: Q.leak(t, "seven")):
        before = max(stages(spark), default=-1)
        run().collect()
        assert 0 < max(n for s, n in stages(spark).items() if s > before) <= 2000


def test_distinct_counts(spark):
    t = spark.sql("SELECT * FROM VALUES (double('NaN'), 'a', null), (double('NaN'), 'A', null), (0.0D, null, null), (-0.0D, 'a', null) AS t(x, k, nothing)").withColumn("one", F.lit(1))
    assert Q.distinct_counts(t, t.columns) == {"x": 2, "k": 2, "nothing": 0, "one": 1} and Q.distinct_counts(t, []) == {}
    assert tuple(t.agg(*[F.countDistinct(c) for c in t.columns]).first()) == (2, 2, 0, 1)
    empty = {(r.check, r.feature) for r in Q.check_data(t.where("false")).collect()}
    assert ("duplicates", "*") not in empty and ("zero_variance", "x") in empty


def test_leak_checks(rows):
    found = {(r.check, r.feature): r for r in Q.leak(rows, "y", rows.limit(50)).collect()}
    assert found["correlation", "leak"].severity == "critical" and ("single_auc", "leak") in found and ("mutual_information", "leak") in found
    assert ("id_column", "id") in found and found["shared_rows", "*"].value == 1.0 and ("correlation", "x") not in found
    assert Q.suspects(Q.leak(rows, "y")).count() <= 3


def test_feature_clusters(rows):
    t = rows.select("x", (F.col("x") * 3).alias("x3"), F.hash("id").alias("noise"))
    assert Q.cluster_features(t) == [["x", "x3"], ["noise"]]


def test_ks_and_chi2_by_hand(spark):
    t = spark.createDataFrame([(1.0, False), (2.0, False), (3.0, False), (2.0, True), (4.0, True)], "v double, n boolean")
    assert D.ks_statistic(t, "v", F.col("n")).first().d == pytest.approx(0.5)
    c = spark.createDataFrame([("a", False)] * 30 + [("b", False)] * 10 + [("a", True)] * 10 + [("b", True)] * 30, "v string, n boolean")
    r = D.chi2_statistic(c, "v", F.col("n")).first()
    assert (r.chi2, r.dof) == (pytest.approx(20.0), 1)


def test_drift_verdicts(rows):
    a, b = rows.where("id < 150"), rows.where("id >= 150")
    same = D.drift(a.select("x", "k"), a.select("x", "k"))
    assert same.where("shifted").count() == 0 and D.verdict(same).first().severity == "none"
    moved = D.drift(a.select("x", "k"), b.select((F.col("x") + 1).alias("x"), "k"))
    assert {r.feature for r in moved.where("shifted").collect()} == {"x"} and D.verdict(moved).first().severity == "high"
    r = D.adversarial(a.select("id", "x"), b.select("id", (F.col("x") + 1).alias("x")), ["id"], folds=2, trees=3)
    assert r["auc"] > 0.95 and r["severity"] == "high"
