import math

import pytest
from pyspark.sql import functions as F

from weft.errors import ConfigError, DataError
from weft.operators import text, transforms as T


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "a", 1.0, "yes", 5.0), (2, "b", 2.0, "no", None), (3, "a", 4.0, "no", 5.0), (4, None, 8.0, "yes", 5.0), (5, "c", None, "yes", 5.0)]
    return spark.createDataFrame(data, "id long, k string, x double, y string, same double")


def column(df, c, by="id"):
    return [r[c] for r in df.orderBy(by).collect()]


def test_onehot_and_ordinal_unseen(rows, spark):
    new = spark.createDataFrame([(9, "zzz", 0.0, "yes", 0.0)], rows.schema)
    e = T.encode(rows, ["k"], "onehot")
    assert e(rows).columns == ["id", "x", "y", "same", "k_a", "k_b", "k_c"]
    assert column(e(rows), "k_a") == [1, 0, 1, 0, 0]
    assert e(new).select("k_a", "k_b", "k_c").first() == (0, 0, 0)
    o = T.encode(rows, ["k"], "ordinal")
    assert column(o(rows), "k") == [0.0, 1.0, 0.0, -1.0, 2.0] and o(new).first().k == -1.0


def test_frequency_target_woe(rows, spark):
    new = spark.createDataFrame([(9, "zzz", 0.0, "yes", 0.0)], rows.schema)
    f = T.encode(rows, ["k"], "frequency")
    assert column(f(rows), "k") == [0.4, 0.2, 0.4, 0.2, 0.2] and f(new).first().k == 0.0
    t = T.encode(rows, ["k"], "target", target="x", smoothing=1)
    overall = 15 / 4
    assert column(t(rows), "k")[0] == pytest.approx(2 / 3 * 2.5 + overall / 3) and t(new).first().k == pytest.approx(overall)
    w = T.encode(rows, ["k"], "woe", target="y")
    de, dn = 1.5 / (3 + 2), 1.5 / (2 + 2)
    assert column(w(rows), "k")[0] == pytest.approx(math.log(de / dn)) and w(new).first().k == 0.0
    with pytest.raises(DataError):
        T.encode(rows, ["k"], "woe", target="id")
    with pytest.raises(ConfigError):
        T.encode(rows, ["k"], "nothing")


def test_datetime(spark):
    t = spark.sql("SELECT timestamp_ntz'2024-03-02 00:00:00' AS d UNION ALL SELECT timestamp_ntz'2024-03-04 00:00:00'")
    r = T.encode(t, ["d"], "datetime")(t).orderBy("d_day").collect()
    assert [x.d_dayofweek for x in r] == [5, 0] and [x.d_is_weekend for x in r] == [1, 0] and "d_hour" not in r[0].asDict()


def test_scale_edges(rows):
    for method in ("standard", "minmax", "robust"):
        out = T.scale(rows, ["x", "same"], method)(rows)
        assert {v for v in column(out, "same") if v is not None} <= {0.0}
    assert [v for v in column(T.scale(rows, ["x"], "minmax")(rows), "x") if v is not None] == [0.0, 1 / 7, 3 / 7, 1.0]
    s = T.scale(rows, ["x"])(rows).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert s[0] == pytest.approx(0) and s[1] == pytest.approx(1)


def test_impute_flags_and_bins(rows):
    assert column(T.impute(rows, ["x"], "median")(rows), "x")[4] == 3.0
    assert column(T.impute(rows, ["k"], "mode")(rows), "k")[3] == "a"
    assert column(T.impute(rows, ["k"], "constant", "?")(rows), "k")[3] == "?"
    nothing = rows.withColumn("x", F.lit(None).cast("double"))
    assert set(column(T.impute(nothing, ["x"])(nothing), "x")) == {None}
    assert column(T.null_flags(rows)(rows), "x_is_null") == [0, 0, 0, 0, 1]
    b = T.discretize(rows, ["x"], 2)
    assert column(b(rows), "x") == [0, 0, 1, 1, 1]
    assert column(T.discretize(rows, ["same"], 3)(rows), "same") == [0] * 5


def test_prepare_and_pipe(rows):
    ready = T.prepare(rows, "y", "logistic")
    out = ready(rows)
    assert {"k_a", "k_b", "k_c"} <= set(out.columns) and out.where("x is null").count() == 0
    assert T.pipe(T.null_flags(rows, ["x"]))(rows).columns[-1] == "x_is_null"
    assert T.prepare(rows, "y", "random_forest")(rows).schema["k"].dataType.simpleString() == "double"


def test_nan_becomes_null(spark):
    t = T.normalise_nan(spark.sql("SELECT double('NaN') AS a, 1.0D AS b"))
    assert t.first() == (None, 1.0)


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "Apple apple pie a"), (2, "apple tart"), (3, None), (4, "été été")], "id long, t string")
    k = text.tokenize(docs, "id", "t", 3)
    v = {r.term: (r["index"], r.df, r.idf) for r in k.vocabulary.collect()}
    assert set(v) == {"apple", "été", "pie"} and v["apple"] == (0, 2, pytest.approx(math.log(5 / 3) + 1))
    wide = k.columns(docs, "id", "t").orderBy("id").collect()
    assert sum(wide[0][f"t_tfidf_{i}"] ** 2 for i in range(3)) == pytest.approx(1) and wide[2]["t_tfidf_0"] == 0.0
    sparse = k.vectors(docs, "id", "t").orderBy("id").collect()
    assert sparse[0].features[0] == pytest.approx(wide[0]["t_tfidf_0"])


def shuffled_rows(df):
    """Rows that its exchanges wrote, once it has run."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_tfidf_shuffles_the_vocabulary_alone(spark):
    """Of 9,000 pairs of a document and a term, those of the two terms in the vocabulary and a row a term and task."""
    docs = spark.createDataFrame([(i, "top top also " + " ".join(f"w{(i * 29 + x * 7) % 300}" for x in range(28))) for i in range(300)], "id long, t string")
    long = text.tokenize(docs, "id", "t", 2).long(docs, "id", "t")
    assert {(r.term, r["index"]) for r in long.collect()} == {("also", 0), ("top", 1)} and long.count() == 600
    assert shuffled_rows(long) < 4000


def test_tfidf_of_repeated_and_null_ids(spark):
    """Rows that share an id are one document, in frequencies and weights."""
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (None, "aa"), (None, "bb bb"), (3, "dd"), (4, None)], "id long, t string")
    k = text.tokenize(docs, "id", "t", 2)
    assert {r.term: (r["index"], r.df) for r in k.vocabulary.collect()} == {"aa": (0, 2), "bb": (1, 2)}
    found = {(r.doc, r.term): r.weight for r in k.long(docs, "id", "t").collect()}
    assert found == {key: pytest.approx(v / math.sqrt(5)) for key, v in {(1, "aa"): 2, (1, "bb"): 1, (None, "aa"): 1, (None, "bb"): 2}.items()}
    assert text.tokenize(docs.where("id = 4"), "id", "t").vocabulary.count() == 0
