import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.errors import ConfigError, DataError, PartitionError
from weft.operators import partition as P
from weft.plans import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(600).selectExpr("id", "id % 30 AS g", "if(id % 5 = 0, 'a', 'b') AS y", "timestamp'2020-01-01' + make_interval(0, 0, 0, cast((id * 7) % 600 AS int)) AS t", "id / 7.0D AS x").cache()


def test_shuffle_vector():
    assert P.pcg_shuffle(10, 42) == [4, 5, 9, 0, 1, 7, 8, 3, 2, 6]
    assert sorted(P.pcg_shuffle(57, 1)) == list(range(57)) and P.pcg_shuffle(0, 1) == []


def test_ordered_index_equals_the_window(rows):
    for seed in (1, 42):
        got = O.hash_index(rows, ["id"], seed, ["y"])
        want = F.row_number().over(Window.partitionBy("y").orderBy(O.hash_key(["id"], seed), "id"))
        assert got.withColumn("w", want).where("w <> __rn").count() == 0
        assert got.count() == 600
    got = O.value_index(rows, "x", ["id"]).withColumn("w", F.row_number().over(Window.orderBy("x", "id")))
    assert got.where("w <> __rn or __n <> 600").count() == 0
    got = O.time_index(rows, "t", ["id"]).withColumn("w", F.row_number().over(Window.orderBy("t", "id")))
    assert got.where("w <> __rn").count() == 0


def test_running_sums(rows):
    t = rows.groupBy(F.floor("x").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    c = O.running_sums(t, "v", ["n"]).withColumn("w", F.sum("n").over(Window.orderBy("v")))
    assert c.where("w <> cum_n").count() == 0 and c.count() == t.count()
    one = O.running_sums(t.where("v = 3"), "v", ["n"]).first()
    assert one["cum_n"] == one["n"]


def test_parts_cover_and_are_disjoint(rows):
    for s in (P.split(rows, "y", id_cols="id"), P.split(rows, id_cols="id"), P.split_temporal(rows, time="t", id_cols="id"), P.split_group(rows, groups="g"), P.split(rows, "y", id_cols="id", stratify=False)):
        ids = [r.id for p in s for r in p.select("id").collect()]
        assert sorted(ids) == list(range(600))
        assert s.dev.count() == s.train.count() + s.valid.count()
        again = {r.id for r in s.train.select("id").collect()}
        assert again == {r.id for r in s.train.select("id").collect()}


def test_sizes_and_ratios(rows):
    sizes = {(r[P.ROLE], r.y): r.n for r in P.split(rows, "y", id_cols="id").sizes("y").collect()}
    assert sizes == {("train", "a"): 72, ("valid", "a"): 24, ("test", "a"): 24, ("train", "b"): 288, ("valid", "b"): 96, ("test", "b"): 96}
    two = P.split(rows, "y", id_cols="id", ratio=(0.75, 0.25))
    assert len(list(two)) == 2 and two.test.count() == 150
    assert P.split(rows, "y", id_cols="id", seed=1).train.exceptAll(P.split(rows, "y", id_cols="id", seed=2).train).count() > 0


def test_order_of_time_and_groups(rows):
    s = P.split_temporal(rows, time="t", id_cols="id")
    assert "t" not in s.train.columns
    last = rows.join(s.train.select("id"), "id").agg(F.max("t")).first()[0]
    assert rows.join(s.test.select("id"), "id").where(F.col("t") < last).count() == 0
    g = P.split_group(rows, groups="g")
    assert g.train.select("g").intersect(g.test.select("g")).count() == 0
    assert g.train.select("g").distinct().count() == 18


def test_errors(rows, spark):
    with pytest.raises(ConfigError):
        P.split(rows, "y", id_cols="id", ratio=(0.5, 0.6))
    with pytest.raises(ConfigError):
        P.split(rows, "y", id_cols="id", seed=-1)
    with pytest.raises(ConfigError):
        P.split(rows, id_cols="id", time="t", groups="g")
    with pytest.raises(DataError):
        P.split(rows.limit(3), "y", id_cols="id")
    with pytest.raises(DataError):
        P.split(rows.withColumn("y", F.lit(1)), "y", id_cols="id")
    with pytest.raises(DataError):
        P.split_group(rows.withColumn("g", F.when(F.col("id") > 3, F.col("g"))), groups="g")
    with pytest.raises(DataError):
        P.split_group(rows.withColumn("g", F.col("id") % 2), groups="g")
    with pytest.raises(ConfigError):
        P.cv(P.split_temporal(rows, time="t", id_cols="id"))
    with pytest.raises(PartitionError):
        _ = P.cv(rows, id_cols="id").train


def test_folds(rows):
    for f in (P.cv(rows, id_cols="id", target="y"), P.cv(rows, id_cols="id"), P.cv_group(rows, groups="g"), P.cv_group(rows, groups="g", target="y", stratify=True)):
        seen = []
        for train, valid in f:
            assert train.count() + valid.count() == 600
            seen += [r.id for r in valid.select("id").collect()]
        assert sorted(seen) == list(range(600))
    counts = {r.n for r in P.cv(rows.where("id < 598"), id_cols="id", folds=7).data.groupBy(P.FOLD).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {85, 86}
    r = P.cv(rows, id_cols="id", folds=2, repeats=3)
    assert len(list(r)) == 6 and r.fold(4)[0].count() + r.fold(4)[1].count() == 600


def test_temporal_folds(rows):
    t = P.cv_temporal(rows, time="t", id_cols="id", folds=4, embargo=10, window="sliding", window_size=100)
    by = {(r[P.FOLD], r[P.ROLE]): r.n for r in t.groupBy(P.FOLD, P.ROLE).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by == {(k, "train"): 100 for k in range(4)} | {(k, "valid"): 110 for k in range(4)}
    for k in range(4):
        one = t.where(F.col(P.FOLD) == k)
        assert one.where(F.col(P.ROLE) == "train").agg(F.max("t")).first()[0] < one.where(F.col(P.ROLE) == "valid").agg(F.min("t")).first()[0]
    purged = P.cv_temporal(rows, time="t", id_cols="id", folds=3, groups="g")
    shared = purged.where(F.col(P.ROLE) == "train").select(P.FOLD, "g").intersect(purged.where(F.col(P.ROLE) == "valid").select(P.FOLD, "g"))
    assert shared.count() == 0


def test_task_detection(spark):
    t = spark.range(400).selectExpr("cast(id % 2 AS int) AS b", "cast(id % 10 AS int) AS few", "id AS many", "cast(id % 2 AS double) AS f", "id / 3.0D AS d", "string(id) AS s")
    assert [P.detect_task(t, c) for c in ("b", "few", "many", "f", "d", "s")] == ["classification"] * 2 + ["regression", "classification", "regression", "classification"]
