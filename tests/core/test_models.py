import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.errors import ConfigError, DataError, PartitionError
from weft.functions import plots
from weft.operators import models as M
from weft.operators import partition, provenance
from weft.operators import workflow as W
from weft.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.range(400).selectExpr("id", "(id * 7919 % 400) / 400.0D AS x", "(id * 104729 % 397) / 397.0D AS z", "if(id % 4 = 0, 'p', 'q') AS k")
    return t.selectExpr("*", "3 * x - 2 * z + 1 AS v", "if(x + 0.3 * z > 0.65, 'yes', 'no') AS y").cache()


def test_ridge_equals_normal_equations(rows):
    m = M.fit(rows, "v", "linear", features=["x", "z"], alpha=2.0, task="regression")
    d = rows.toPandas()
    x = d[["x", "z"]].to_numpy()
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + 2 * np.eye(2), c.T @ d.v.to_numpy())
    assert np.allclose(m.kernel.weights, want)
    exact = M.fit(rows, "v", "linear", features=["x", "z"], alpha=0.0, task="regression")
    assert W.bundle(exact, rows)["r2"] == pytest.approx(1.0)


def test_naive_bayes_and_knn_by_hand(rows):
    d = rows.toPandas()
    m = M.fit(rows, "y", "naive_bayes", features=["x", "z"])
    got = m.predict(rows).orderBy("id").toPandas()
    logs = []
    for c in ("no", "yes"):
        s = d[d.y == c][["x", "z"]]
        mu, var = s.mean().to_numpy(), s.var(ddof=0).to_numpy() + 1e-9 * d[["x", "z"]].var(ddof=0).max()
        logs.append(np.log(len(s) / len(d)) - 0.5 * (np.log(2 * np.pi * var) + (d[["x", "z"]].to_numpy() - mu) ** 2 / var).sum(1))
    p = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert np.allclose(got["probability_yes"], p, atol=1e-9)
    assert (got.prediction == np.where(p > 0.5, "yes", "no")).all()
    k = M.fit(rows, "y", "knn", features=["x", "z"], k=1, block=50)
    assert k.predict(rows).where("prediction <> y").count() == 0
    r = M.fit(rows, "v", "knn", features=["x", "z"], k=3, weighting="distance", task="regression", block=64)
    assert W.bundle(r, rows)["r2"] > 0.999


@pytest.mark.parametrize("name,options", [("logistic", {}), ("decision_tree", {}), ("random_forest", {"n_estimators": 5}), ("adaboost", {"n_estimators": 3}), ("svm", {}), ("gradient_boosting", {"n_estimators": 2})])
def test_classifiers(rows, name, options):
    m = M.fit(rows, "y", name, features=["x", "z"], **options)
    out = m.predict(rows).select("prediction", "probability_no", "probability_yes").toPandas()
    assert np.allclose(out.probability_no + out.probability_yes, 1, atol=1e-6)
    assert W.bundle(m, rows)["accuracy"] > 0.85


def test_multiclass_weights_and_errors(rows):
    t = rows.withColumn("c", F.when(F.col("x") < 0.3, "a").when(F.col("x") < 0.6, "b").otherwise("c"))
    m = M.fit(t, "c", "decision_tree", features=["x", "z"], balance=True)
    b = W.bundle(m, t)
    assert b["accuracy"] > 0.98 and b["roc_auc_ovr"] > 0.98
    with pytest.raises(ConfigError):
        M.fit(rows, "y", "linear", features=["x"])
    with pytest.raises(DataError):
        m.predict(rows.drop("x"))
    m.threshold = None
    assert sum(m.importances.values()) == pytest.approx(1)


def test_workflow(rows, tmp_path, spark):
    provenance.REGISTRY.clear()
    s = provenance.register_split(partition.split(rows.drop("k"), "y", id_cols="id"))
    m = M.fit(s.train, "y", "logistic", features=["x", "z"])
    m.provenance = {"split_id": s.split_id, "fingerprint": provenance.fingerprint(s.train)}
    assert W.verify(m)["status"] == "verified"
    assert W.evaluate(m, s.valid)["accuracy"] > 0.8
    with pytest.raises(PartitionError):
        W.evaluate(m, s.test)
    with pytest.raises(PartitionError):
        W.assess(m, s.valid)
    m.assess_count = 0
    found = W.assess(m, s.test)
    assert found.peeks == 1 and found["accuracy"] > 0.8
    with pytest.raises(PartitionError):
        W.assess(m, s.test)
    m.assess_count = 0
    with pytest.raises(PartitionError):
        W.assess(m, s.test)
    assert W.validate(m, s.test, {"accuracy": ">=0.5"}, {"accuracy": 0.1})["passed"]
    assert not W.validate(m, s.test, {"accuracy": ">2"})["passed"]
    tree = M.fit(s.train, "y", "decision_tree", features=["x", "z"])
    board = W.compare({"lr": m, "dt": tree}, s.valid, id_cols=["id"])
    assert {r["name"] for r in board} == {"lr", "dt"} and "p_vs_best" in board[1]
    assert list(W.explain(m))[0] == "x" and W.select(m, s.train, 0.0, 0.9)[0] == "x"
    assert W.explain(m, s.valid, id_cols=["id"], method="permutation", repeats=1)["x"] > 0.5
    assert not W.shelf(m, s.valid, {"accuracy": found["accuracy"]}, 0.2)["stale"]
    assert "<table>" in W.report(m, s.valid, str(tmp_path / "r.html"))
    tables.save(m, str(tmp_path / "m"))
    again = tables.load(spark, str(tmp_path / "m"))
    a, b = (x.predict(s.valid).select("id", "prediction") for x in (m, again))
    assert a.exceptAll(b).isEmpty()
    provenance.guards("off")
    assert W.evaluate(m, s.test)["accuracy"] > 0.8
    provenance.guards("strict")


def test_search(rows):
    t = rows.drop("v", "k")
    r = W.tune(t, "y", "decision_tree", {"max_depth": [1, 4]}, id_cols=["id"], method="grid", folds=2)
    assert r["best"] == {"max_depth": 4} and len(r["history"]) == 2
    board = W.screen(t, "y", id_cols=["id"], names=["naive_bayes", "decision_tree"])
    assert board[0]["accuracy"] >= board[1]["accuracy"]
    st = W.stack(rows.drop("y", "k"), "v", ["linear", "decision_tree"], id_cols=["id"], folds=2)
    assert st.predict(rows).agg(F.corr("prediction", "v")).first()[0] > 0.99
    assert W.draw({"a": (1, 5), "b": (0.001, 10.0), "c": ["x"]}, __import__("random").Random(1))["c"] == "x"
    assert W.rule_holds(0.9, ">=0.85") and not W.rule_holds(0.9, "<0.85")
    assert len(W.enough(t, "y", id_cols=["id"], algorithm="naive_bayes", steps=2)["curve"]) == 2


def test_intervals_and_plots(rows):
    m = M.fit(rows, "v", "linear", features=["x", "z"], task="regression")
    r = M.predict_interval(m, rows.limit(20), ["id"], 1, passes=20)
    assert r.where("low <= prediction and prediction <= high").count() == 20
    assert M.predict_augmented(m, rows.limit(5), ["id"], 1, 3).count() == 5
    d = plots.partial_dependence(m, rows, "x", [0.0, 1.0]).orderBy("value").collect()
    assert d[1]["mean"] > d[0]["mean"]
    assert plots.waterfall({"a": 0.25, "b": 0.75})[0] == ("b", 0.0, 0.75)
    assert W.interact(m, rows.limit(100), id_cols=["id"])[0][2] < 1e-9


def test_audit_and_fingerprint(rows, spark):
    log = provenance.AuditLog()
    for k in range(4):
        log.add("step", n=k)
    assert provenance.verify_chain(log.frame(spark)).where("not valid").count() == 0
    log.entries[1]["body"] = "changed"
    assert provenance.verify_chain(log.frame(spark)).where("not valid").count() == 1
    assert provenance.fingerprint(rows) == provenance.fingerprint(rows.orderBy(F.desc("id")).select(*reversed(rows.columns)))
    assert provenance.fingerprint(rows) != provenance.fingerprint(rows.where("id > 0"))


def test_sources(spark, tmp_path):
    for n in tables.DATASETS:
        t = tables.dataset(spark, n, n=200)
        assert t.count() == 200 and t.exceptAll(tables.dataset(spark, n, n=200)).isEmpty()
    tables.write_table(tables.dataset(spark, "survival", n=50), str(tmp_path / "a.csv"), "csv")
    assert tables.datasets(spark).count() == 3 and tables.algorithm_catalogue(spark).count() > 8
    tables.write_table(spark.sql("SELECT double('NaN') AS x"), str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p")).first().x is None


def test_streams(spark, tmp_path):
    from weft.streaming import monitor

    rows = spark.range(200).selectExpr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id % 50 AS int)) AS ts", "if(id % 2 = 0, 'a', 'b') AS k", "double(id) AS v")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = monitor.stream_table(spark, str(tmp_path / "in"), rows.schema)
    q = monitor.window_profile(stream, "ts", "k", "v", "1 day").writeStream.outputMode("complete").format("memory").queryName("profiled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("profiled").agg(F.sum("n")).first()[0] == 200
    seen = []
    monitor.watch_drift(stream, rows.withColumn("k", F.lit("a")), "k", lambda *x: seen.append(x), str(tmp_path / "c")).awaitTermination()
    assert len(seen) == 2 and all(s[3] for s in seen)


@pytest.mark.parametrize("name", ["svm", "logistic"])
def test_a_look_at_the_loss_of_few_rows_is_one_task(rows, spark, name):
    """However many partitions the table has; more numbers take more partitions, and none is lost."""
    sc = spark.sparkContext
    sc.setJobGroup(f"loss-{name}", "")
    M.fit(rows.repartition(16), "y", name, features=["x", "z"])
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"loss-{name}") for s in tracker.getJobInfo(j).stageIds]
    looks = [s.numTasks for s in stages if s and "RDDLossFunction" in s.name]
    assert looks and set(looks) == {1}


def test_gathered(rows, monkeypatch):
    ready = rows.select("x", "z", F.lit(0.5).alias("__w"))
    monkeypatch.setattr(M, "CELLS", 400)
    out, weight = M.gathered(ready, ["x", "z"])
    assert out.rdd.getNumPartitions() == 4 and weight == 200 and out.exceptAll(ready).isEmpty() and out.count() == 400
    assert M.gathered(ready.where("false"), ["x", "z"])[0].rdd.getNumPartitions() == 1
