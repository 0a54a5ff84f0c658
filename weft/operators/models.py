"""Fitting and predicting: closed forms and aggregates where they exist, Spark's own estimators elsewhere.

``fit`` takes numeric features (``prepare`` makes them) and returns a ``Model`` whose ``predict`` adds ``prediction`` and, for
classification, ``probability_<class>`` columns. Classes are in order; ties go to the lowest class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, ModelError
from .partition import detect_task
from .transforms import label_index, numeric_columns

ALIASES = {"rf": "random_forest", "lr": "logistic", "dt": "decision_tree", "et": "extra_trees", "gb": "gradient_boosting", "gbt": "gradient_boosting", "nb": "naive_bayes", "ridge": "linear", "enet": "elastic_net", "ada": "adaboost", "histgradient": "gradient_boosting"}
CLASSIFIERS = ("logistic", "naive_bayes", "decision_tree", "random_forest", "extra_trees", "gradient_boosting", "adaboost", "svm", "knn")
REGRESSORS = ("linear", "elastic_net", "decision_tree", "random_forest", "extra_trees", "gradient_boosting", "knn")


def algorithms(task: str | None = None) -> list[str]:
    return sorted({*(CLASSIFIERS if task != "regression" else ()), *(REGRESSORS if task != "classification" else ())})


@dataclass
class Model:
    """A fitted model. ``kernel`` turns a frame with the features into one with scores."""

    algorithm: str
    task: str
    features: list[str]
    target: str
    classes: list
    kernel: object
    seed: int = 42
    params: dict = field(default_factory=dict)
    scores: dict = field(default_factory=dict)
    provenance: dict = field(default_factory=dict)
    threshold: float | None = None
    importances: dict[str, float] = field(default_factory=dict)
    assess_count: int = 0

    def predict(self, df: DataFrame, proba: bool = True) -> DataFrame:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise DataError(f"no columns {missing}")
        if self.task == "regression":
            return self.kernel.score(df, self.features)
        scored = self.kernel.score(df, self.features)
        ps = F.col("__p")
        best = F.array_position(ps, F.array_max(ps)) - 1
        if self.threshold is not None and len(self.classes) == 2:
            best = (ps[1] >= self.threshold).cast("int")
        labels = F.array(*[F.lit(c) for c in self.classes])
        out = scored.withColumn("prediction", labels[best.cast("int")])
        if proba:
            out = out.withColumns({f"probability_{c}": ps[i] for i, c in enumerate(self.classes)})
        return out.drop("__p")


def fit(df: DataFrame, target: str, algorithm: str = "auto", *, features: list[str] | None = None, task: str = "auto", seed: int = 42, weights: str | None = None, balance: bool = False, id_cols: tuple[str, ...] = (), **params) -> Model:
    """Fit on rows with a target. ``balance`` weights classes by n / (K * n_c)."""
    name = ALIASES.get(algorithm, algorithm)
    df = df.where(F.col(target).isNotNull())
    task = detect_task(df, target) if task == "auto" else task
    if name == "auto":
        name = "random_forest"
    if name not in (CLASSIFIERS if task == "classification" else REGRESSORS):
        raise ConfigError(f"{name!r} can't do {task}; use one of {', '.join(algorithms(task))}")
    if any(k in params for k in ("monotone", "monotone_constraints")):
        raise ModelError("these estimators have no monotone constraints")
    features = features or [c for c in numeric_columns(df) if c != target and c != weights and c not in id_cols]
    if not features:
        raise DataError("no numeric features; use prepare first")
    classes = list(label_index(df, target)) if task == "classification" else []
    rows = df.select(*[F.col(c).cast("double") for c in features], _code(target, classes).alias("__y"), (F.col(weights).cast("double") if weights else F.lit(1.0)).alias("__w"))
    if weights and not rows.where("__w is null or __w < 0").isEmpty():
        raise DataError("weights must not be null or negative")
    if balance and classes:
        n = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(n.values())
        scale = F.element_at(F.create_map(*[F.lit(x) for k, v in n.items() for x in (float(k), total / (len(n) * v))]), F.col("__y"))
        rows = rows.withColumn("__w", F.col("__w") * scale)
    if name == "knn":
        kernel = Knn(rows.select(*features, "__y"), len(classes), **params)
    else:
        kernel = KERNELS[name](rows, features, len(classes), seed, params)
    model = Model(name, task, features, target, classes, kernel, seed, params)
    model.importances = importances(model)
    return model


def _code(target: str, classes: list) -> Column:
    if not classes:
        return F.col(target).cast("double")
    out = F.when(F.col(target) == F.lit(classes[0]), 0.0)
    for k, v in enumerate(classes[1:], 1):
        out = out.when(F.col(target) == F.lit(v), float(k))
    return out


def importances(m: Model) -> dict[str, float]:
    raw = getattr(m.kernel, "weights", None)
    if raw is None:
        return {}
    raw = np.abs(np.asarray(raw, float))
    total = raw.sum()
    return dict(zip(m.features, (raw / total if total else raw).tolist(), strict=True))


# Closed forms


def gram(rows: DataFrame, features: list[str]) -> dict:
    """Weighted sums, cross products and products with the target, of rows without nulls, in one aggregate."""
    t = rows.na.drop(subset=[*features, "__y"])
    w, made = F.col("__w"), [F.sum("__w").alias("n"), F.sum(F.col("__w") * F.col("__y")).alias("sy")]
    for i, a in enumerate(features):
        made += [F.sum(w * F.col(a)).alias(f"s{i}"), F.sum(w * F.col(a) * F.col("__y")).alias(f"y{i}")]
        made += [F.sum(w * F.col(a) * F.col(b)).alias(f"g{i}_{j}") for j, b in enumerate(features[i:], i)]
    return t.agg(*made).first().asDict()


class Ridge:
    """Minimises sum of squares plus alpha times the squared weights; the bias is free."""

    def __init__(self, rows, features, k, seed, params):
        alpha, p = float(params.get("alpha", 1.0)), len(features)
        r = gram(rows, features)
        if not r["n"]:
            raise DataError("no complete rows")
        n, s = r["n"], np.array([r[f"s{i}"] for i in range(p)])
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) - np.outer(s, s) / n
        b = np.array([r[f"y{i}"] for i in range(p)]) - s * r["sy"] / n
        try:
            self.weights = np.linalg.solve(g + alpha * np.eye(p), b)
        except np.linalg.LinAlgError:
            self.weights = np.linalg.lstsq(g + alpha * np.eye(p), b, rcond=None)[0]
        self.bias = (r["sy"] - float(self.weights @ s)) / n

    def score(self, df: DataFrame, features: list[str]) -> DataFrame:
        value = F.lit(float(self.bias))
        for c, w in zip(features, self.weights, strict=True):
            value = value + F.col(c) * float(w)
        return df.withColumn("prediction", value)


class GaussianNB:
    """Class means and variances in one aggregate; a small share of the largest variance is added to each."""

    def __init__(self, rows, features, k, seed, params):
        w = F.col("__w")
        mean = lambda x: F.sum(w * x) / F.sum(w)
        made = [x for i, c in enumerate(features) for x in (mean(F.col(c)).alias(f"m{i}"), (mean(F.col(c) * F.col(c)) - F.pow(mean(F.col(c)), F.lit(2))).alias(f"v{i}"))]
        stats = {int(r["__y"]): r for r in rows.groupBy("__y").agg(F.sum("__w").alias("n"), *made).collect()}
        widest = max(rows.agg(*[F.var_pop(c) for c in features]).first()) or 0.0
        extra = float(params.get("var_smoothing", 1e-9)) * widest
        total = sum(r["n"] for r in stats.values())
        self.classes = [(math.log(stats[c]["n"] / total), [stats[c][f"m{i}"] for i in range(len(features))], [max(stats[c][f"v{i}"], 0.0) + extra or 1e-300 for i in range(len(features))]) for c in sorted(stats)]

    def score(self, df: DataFrame, features: list[str]) -> DataFrame:
        logs = []
        for prior, means, variances in self.classes:
            value = F.lit(prior)
            for c, m, v in zip(features, means, variances, strict=True):
                value = value - 0.5 * math.log(2 * math.pi * v) - (F.col(c) - m) * (F.col(c) - m) / (2 * v)
            logs.append(value)
        out = df.withColumn("__l", F.array(*logs)).withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
        return out.withColumn("__p", F.transform("__e", lambda x: x / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))).drop("__l", "__e")


class Knn:
    """Exact nearest neighbours. Training rows are cut into blocks; every row meets every block in a numpy product and
    keeps its ``k`` closest of each, which are then merged. Training rows travel as blocks of ``block`` rows, not to the driver.
    """

    def __init__(self, rows: DataFrame, k_classes: int, k: int = 5, weighting: str = "uniform", block: int = 4096):
        self.rows, self.classes, self.k, self.weighting, self.block = rows, k_classes, int(k), weighting, block

    def score(self, df: DataFrame, features: list[str]) -> DataFrame:
        k, classes, by_distance = self.k, self.classes, self.weighting == "distance"
        spark = df.sparkSession
        n = self.rows.count()
        blocks = max(1, -(-n // self.block))
        pack = lambda d: d.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), *(["__y"] if "__y" in d.columns else ["__row"]))
        train = pack(self.rows).withColumn("b", F.pmod(F.xxhash64("x", "__y"), F.lit(blocks)).cast("int"))
        # A row is its features: equal ones have the same neighbours, and a key of its own content is the same wherever it is computed.
        features_of = lambda d: F.array(*[d[c].cast("double") for c in features])
        marked = df.withColumn("__row", features_of(df))
        # Each block of queries meets each block of training rows once.
        asked = pack(marked).dropDuplicates(["__row"]).withColumn("q", F.pmod(F.xxhash64("__row"), F.lit(max(1, spark.sparkContext.defaultParallelism))).cast("int"))
        left = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        queries = max(1, spark.sparkContext.defaultParallelism)
        right = train.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))))

        def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"__row": [], "d": [], "y": []})
            x, t, y = np.stack(a["x"]), np.stack(b["x"]), b["__y"].to_numpy()
            out = []
            for at in range(0, len(x), 1024):
                part = x[at : at + 1024]
                d = np.maximum((part**2).sum(1)[:, None] - 2 * part @ t.T + (t**2).sum(1)[None, :], 0)
                best = np.lexsort((np.broadcast_to(y, d.shape), d), axis=1)[:, :k]
                rows = [r for r in a["x"].iloc[at : at + 1024] for _ in range(best.shape[1])]
                out.append(pd.DataFrame({"__row": rows, "d": np.take_along_axis(d, best, 1).ravel(), "y": y[best].ravel()}))
            return pd.concat(out)

        pairs = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(near, "__row array<double>, d double, y double")
        nearest = pairs.groupBy("__row").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "y"))), 1, k).alias("s"))
        weight = (lambda s: 1 / (F.sqrt(s["d"]) + 1e-10)) if by_distance else (lambda s: F.lit(1.0))
        total = F.aggregate("s", F.lit(0.0), lambda a, s: a + weight(s))

        def votes(c: int) -> Column:
            return F.aggregate("s", F.lit(0.0), lambda a, s: a + F.when(s["y"] == c, weight(s)).otherwise(0.0))

        if classes:
            value = F.array(*[votes(c) / total for c in range(classes)]).alias("__p")
        else:
            value = (F.aggregate("s", F.lit(0.0), lambda a, s: a + weight(s) * s["y"]) / total).alias("prediction")
        return marked.join(nearest.select("__row", value), "__row").drop("__row")


# Spark's estimators


class Spark:
    """A Spark estimator over assembled features."""

    def __init__(self, rows, features, k, seed, params):
        self.k = k
        ready = self._assemble(rows.na.drop(subset=["__y"]), features).select("__x", "__y", "__w")
        self.model = self.make(ready, features, k, seed, dict(params))
        first = getattr(self.model, "featureImportances", None)
        if first is not None:
            self.weights = first.toArray()
        elif hasattr(self.model, "coefficients") and k <= 2:
            self.weights = self.model.coefficients.toArray()

    @staticmethod
    def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        typed = df.withColumns({f"__f{i}": F.col(c).cast("double") for i, c in enumerate(features)})
        return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="__x", handleInvalid="error").transform(typed).drop(*[f"__f{i}" for i in range(len(features))])

    def make(self, ready, features, k, seed, params):
        raise NotImplementedError

    def score(self, df: DataFrame, features: list[str]) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self._assemble(df, features))
        made = [c for c in ("__x", "rawPrediction", "probability", "__raw") if c in out.columns and c not in df.columns]
        if not self.k:
            return out.withColumn("prediction", F.col("prediction")).drop(*made)
        if "probability" in made:
            p = vector_to_array("probability")
        elif "rawPrediction" in made:
            p = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
        else:
            p = F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda i: (F.col("prediction") == i).cast("double"))
        return out.withColumn("__p", p).drop("prediction", *made)


COMMON = {"featuresCol": "__x", "labelCol": "__y", "weightCol": "__w"}


#: Numbers that one task of an iterative fit holds.
CELLS = 1 << 22


def gathered(ready: DataFrame, features: list[str]) -> tuple[DataFrame, float]:
    """``ready`` in a partition for every ``CELLS`` numbers, and the sum of its weights.

    Estimators that close in on a minimum run a job for each look at the loss, hundreds of times. A look at a few numbers takes less time than the
    start of its tasks, so rows lie in as few partitions as they fill; up to 4 or so need no second stage to add up their sums.
    """
    n, weight = ready.agg(F.count(F.lit(1)), F.sum("__w")).first()
    return ready.repartition(max(1, math.ceil(n * (len(features) + 2) / CELLS))), weight


class Logistic(Spark):
    def make(self, ready, features, k, seed, params):
        from pyspark.ml.classification import LogisticRegression

        ready, n = gathered(ready, features)
        c = float(params.get("C", 1.0))
        return LogisticRegression(**COMMON, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=int(params.get("max_iter", 200)), tol=1e-9).fit(ready)


class ElasticNet(Spark):
    def make(self, ready, features, k, seed, params):
        from pyspark.ml.regression import LinearRegression

        return LinearRegression(**COMMON, regParam=float(params.get("alpha", 1.0)), elasticNetParam=float(params.get("l1_ratio", 0.5)), standardization=False, maxIter=200).fit(ready)


class Tree(Spark):
    def make(self, ready, features, k, seed, params):
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.regression import DecisionTreeRegressor

        kind = DecisionTreeClassifier if k else DecisionTreeRegressor
        return kind(**COMMON, seed=seed, maxDepth=int(params.get("max_depth", 8)), maxBins=int(params.get("bins", 64)), minInstancesPerNode=int(params.get("min_samples_leaf", 1))).fit(ready)


class Forest(Spark):
    def make(self, ready, features, k, seed, params):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.regression import RandomForestRegressor

        kind = RandomForestClassifier if k else RandomForestRegressor
        return kind(**COMMON, seed=seed, numTrees=int(params.get("n_estimators", 50)), maxDepth=int(params.get("max_depth", 8)), maxBins=int(params.get("bins", 64)), featureSubsetStrategy=params.get("max_features", "sqrt" if k else "onethird")).fit(ready)


class ExtraTrees(Forest):
    """Spark has no random thresholds: coarse bins and no bootstrap come closest."""

    def make(self, ready, features, k, seed, params):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.regression import RandomForestRegressor

        kind = RandomForestClassifier if k else RandomForestRegressor
        return kind(**COMMON, seed=seed, numTrees=int(params.get("n_estimators", 50)), maxDepth=int(params.get("max_depth", 8)), maxBins=int(params.get("bins", 16)), bootstrap=False, featureSubsetStrategy="sqrt" if k else "onethird").fit(ready)


class Boosting(Spark):
    def make(self, ready, features, k, seed, params):
        from pyspark.ml.classification import GBTClassifier, OneVsRest
        from pyspark.ml.regression import GBTRegressor

        options = {"seed": seed, "maxIter": int(params.get("n_estimators", 30)), "maxDepth": int(params.get("max_depth", 4)), "stepSize": float(params.get("learning_rate", 0.1)), "maxBins": int(params.get("bins", 64))}
        if not k:
            return GBTRegressor(**COMMON, **options).fit(ready)
        one = GBTClassifier(**COMMON, **options)
        return one.fit(ready) if k == 2 else OneVsRest(classifier=one, **COMMON).fit(ready)


class Svm(Spark):
    def make(self, ready, features, k, seed, params):
        from pyspark.ml.classification import LinearSVC, OneVsRest

        if params.get("kernel", "linear") != "linear":
            raise ModelError("only linear kernels")
        ready, n = gathered(ready, features)
        one = LinearSVC(**COMMON, regParam=1 / (float(params.get("C", 1.0)) * n), standardization=True, maxIter=100)
        return one.fit(ready) if k == 2 else OneVsRest(classifier=one, **COMMON).fit(ready)


class AdaBoost:
    """SAMME over weighted stumps. Weights of a round are a projection of the earlier stumps, so nothing is kept between rounds."""

    def __init__(self, rows, features, k, seed, params):
        from pyspark.ml.classification import DecisionTreeClassifier

        self.k, self.stumps, rate = k, [], float(params.get("learning_rate", 1.0))
        ready = Spark._assemble(rows.na.drop(subset=["__y"]), features).select("__x", "__y", "__w").persist()
        weighted = ready
        self.weights = np.zeros(len(features))
        for _ in range(int(params.get("n_estimators", 10))):
            stump = DecisionTreeClassifier(**COMMON, maxDepth=1, seed=seed).fit(weighted)
            out = stump.transform(weighted)
            wrong = (F.col("prediction") != F.col("__y")).cast("double")
            r = out.agg(F.sum("__w").alias("n"), F.sum(wrong * F.col("__w")).alias("e")).first()
            error = r["e"] / r["n"]
            if error >= 1 - 1 / k:
                break
            alpha = min(10.0, rate * (math.log((1 - error) / error) + math.log(k - 1))) if error > 0 else 10.0
            self.stumps.append((alpha, stump))
            self.weights += alpha * stump.featureImportances.toArray()
            if error == 0:
                break
            weighted = out.select("__x", "__y", (F.col("__w") * F.exp(alpha * wrong) / r["n"]).alias("__w"))
        ready.unpersist()

    def score(self, df: DataFrame, features: list[str]) -> DataFrame:
        out, votes = Spark._assemble(df, features), []
        for j, (alpha, stump) in enumerate(self.stumps):
            out = stump.transform(out).withColumnRenamed("prediction", f"__s{j}").drop("rawPrediction", "probability")
            votes.append((alpha, F.col(f"__s{j}")))
        total = sum(a for a, _ in votes) or 1.0
        p = F.array(*[sum((F.when(v == c, a).otherwise(0.0) for a, v in votes), F.lit(0.0)) / total for c in range(self.k)])
        return out.withColumn("__p", p).drop("__x", *[f"__s{j}" for j in range(len(votes))])


KERNELS = {"linear": Ridge, "elastic_net": ElasticNet, "logistic": Logistic, "naive_bayes": GaussianNB, "decision_tree": Tree, "random_forest": Forest, "extra_trees": ExtraTrees, "gradient_boosting": Boosting, "adaboost": AdaBoost, "svm": Svm}


def predict_interval(model: Model, df: DataFrame, id_cols: list[str], seed: int, passes: int = 50, noise: float = 0.05, level: float = 0.95) -> DataFrame:
    """Mean and percentiles of predictions under normal noise of ``noise`` deviations, drawn from hashes of row and pass."""
    if model.task != "regression":
        raise ModelError("intervals are for regression")
    noisy = perturbed(df, model.features, id_cols, seed, passes, noise)
    a = (1 - level) / 2
    return model.predict(noisy).groupBy(*id_cols).agg(F.avg("prediction").alias("prediction"), F.expr(f"percentile(prediction, {a})").alias("low"), F.expr(f"percentile(prediction, {1 - a})").alias("high"))


def perturbed(df: DataFrame, features: list[str], id_cols: list[str], seed: int, passes: int, noise: float) -> DataFrame:
    spread = df.agg(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in features]).first()
    out = df.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))

    def uniform(k: int) -> Column:
        return (F.pmod(F.xxhash64(*id_cols, "__pass", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)

    normal = lambda k: F.sqrt(-2 * F.log(uniform(2 * k))) * F.cos(2 * math.pi * uniform(2 * k + 1))
    return out.withColumns({c: F.col(c) + normal(k) * (noise * spread[c]) for k, c in enumerate(features)})


def predict_augmented(model: Model, df: DataFrame, id_cols: list[str], seed: int, augment: int = 10, noise: float = 0.05) -> DataFrame:
    """Mean prediction, or most frequent label (of ties the smallest), over noisy copies of each row."""
    out = model.predict(perturbed(df, model.features, id_cols, seed, augment, noise))
    best = F.avg("prediction") if model.task == "regression" else F.expr("mode() WITHIN GROUP (ORDER BY prediction)")
    return out.groupBy(*id_cols).agg(best.alias("prediction"))
