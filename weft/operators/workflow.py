"""Verbs over splits and models: evaluate, assess, validate, compare, screen, tune, nested CV, explain and the like."""

from __future__ import annotations

import itertools
import math
import random
import re
import time as clock
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError, PartitionError
from ..functions import metrics as M
from ..functions.stats import mcnemar, paired_t
from ..plans.ordering import hash_index, hash_key
from . import provenance
from .models import Model, algorithms, fit
from .partition import Folds, Split, cv, detect_task, split
from .quality import correlations
from .transforms import Pipe, prepare

LOWER = {"rmse", "mae", "mape", "smape", "rmsle", "log_cosh", "log_loss", "brier"}
COST = ["naive_bayes", "linear", "logistic", "elastic_net", "decision_tree", "svm", "adaboost", "random_forest", "extra_trees", "gradient_boosting", "knn"]


def bundle(model: Model, df: DataFrame) -> dict[str, float]:
    """What a task's evaluation reports: regression, binary or multiclass."""
    y, p = model.target, "prediction"
    out = model.predict(df.where(F.col(y).isNotNull()))
    if model.task == "regression":
        a, b = F.col(y).cast("double"), F.col(p)
        return out.agg(M.rmse(a, b).alias("rmse"), M.mae(a, b).alias("mae"), M.r2(a, b).alias("r2")).first().asDict()
    out = out.persist()
    found = {"accuracy": out.agg(M.accuracy(y, p)).first()[0], "mcc": M.mcc(out, y, p).first()[0], **M.averaged(out, y, p).select("f1_macro", "f1_weighted").first().asDict()}
    if len(model.classes) == 2:
        top = model.classes[1]
        found |= M.binary(out, y, p, M.positive_label(out, y)).first().asDict()
        prob = f"probability_{top}"
        is_top = F.col(y) == F.lit(top)
        found["roc_auc"] = M.roc_auc(out, is_top, f"`{prob}`" if "." in prob else prob).first()[0]
        found |= out.agg(M.log_loss(is_top.cast("double"), F.col(prob)).alias("log_loss"), M.brier(is_top.cast("double"), F.col(prob)).alias("brier")).first().asDict()
    else:
        found["roc_auc_ovr"] = M.roc_auc_ovr(out, y, {c: f"probability_{c}" for c in model.classes}).first()[0]
    out.unpersist()
    return found


def rounded(found: dict[str, float]) -> dict[str, float]:
    return {k: v if v is None else round(v, 4) for k, v in found.items()}


def evaluate(model: Model, df: DataFrame, metrics: list[str] | dict | None = None, guarded: bool = True) -> dict[str, float]:
    """Metrics on any part but test; each call counts as a look at its split."""
    if guarded:
        _, split_id = provenance.guard("evaluate", df)
        if split_id:
            provenance.REGISTRY.peek(split_id)
    found = bundle(model, df)
    if isinstance(metrics, dict):
        scored = model.predict(df)
        return rounded({k: float(f(scored)) for k, f in metrics.items()})
    return rounded(found if metrics is None else {m: found[m] for m in metrics})


@dataclass(frozen=True)
class Evidence:
    """The final metrics of a test part, and how often its split was looked at before."""

    metrics: dict[str, float]
    peeks: int

    def __getitem__(self, name: str) -> float:
        return self.metrics[name]


def assess(model: Model, test: DataFrame) -> Evidence:
    """Metrics on the test part, once. The part counts as spent even if scoring fails."""
    if model.assess_count:
        raise PartitionError("this model was assessed before")
    _, split_id = provenance.guard("assess", test)
    model.assess_count += 1
    own = model.provenance.get("split_id")
    if split_id and own and split_id != own:
        raise PartitionError("the test part is of another split than the model's")
    return Evidence(rounded(bundle(model, test)), provenance.REGISTRY.peeks.get(split_id, 0) if split_id else 0)


RULE = re.compile(r"^\s*(>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)\s*$")


def rule_holds(value: float, rule: str) -> bool:
    m = RULE.match(rule)
    if not m:
        raise ConfigError(f"not a rule: {rule!r}")
    x = float(m.group(2))
    return {">=": value >= x, "<=": value <= x, ">": value > x, "<": value < x}[m.group(1)]


def validate(model: Model, test: DataFrame, rules: dict[str, str] | None = None, baseline: dict[str, float] | None = None, tolerance: float = 0.0) -> dict:
    """Whether test metrics keep the rules and don't fall behind a baseline by more than a tolerance."""
    provenance.guard("validate", test)
    found, failures = rounded(bundle(model, test)), []
    for name, rule in (rules or {}).items():
        if name not in found:
            failures.append(f"{name} isn't measured")
        elif not rule_holds(found[name], rule):
            failures.append(f"{name} = {found[name]} isn't {rule}")
    for name, old in (baseline or {}).items():
        if name in found and worse_by(name, found[name], old) > tolerance + 1e-10:
            failures.append(f"{name} fell from {old} to {found[name]}")
    return {"passed": not failures, "failures": failures, "metrics": found}


def worse_by(name: str, new: float, old: float) -> float:
    return new - old if name in LOWER else old - new


def primary(task: str, classes: list) -> str:
    return "rmse" if task == "regression" else "roc_auc" if len(classes) == 2 else "accuracy"


def ordered(rows: list[dict], metric: str) -> list[dict]:
    return sorted(rows, key=lambda r: (r.get(metric) is None, (r.get(metric) or 0) * (1 if metric in LOWER else -1), r["name"]))


def compare(models: dict[str, Model], df: DataFrame, id_cols: list[str] | None = None, metric: str | None = None, alpha: float = 0.05) -> list[dict]:
    """Metrics of several models on the same rows, best first; with id_cols, whether each differs from the best."""
    first = next(iter(models.values()))
    metric = metric or primary(first.task, first.classes)
    rows = ordered([{"name": n, **rounded(bundle(m, df))} for n, m in models.items()], metric)
    if id_cols:
        best = models[rows[0]["name"]].predict(df, proba=False).select(*id_cols, F.col(first.target).alias("__y"), F.col("prediction").alias("__a"))
        for r in rows[1:]:
            both = best.join(models[r["name"]].predict(df, proba=False).select(*id_cols, F.col("prediction").alias("__b")), id_cols)
            test = (mcnemar if first.task == "classification" else paired_t)(both, "__y", "__a", "__b")
            r["p_vs_best"] = test["p_value"]
            r["significant_vs_best"] = test["p_value"] <= alpha
    return rows


def fit_pipeline(df: DataFrame, target: str, algorithm: str, **options) -> tuple[Pipe, Model]:
    """Prepare and fit; the pipe goes before the model at prediction."""
    ready = prepare(df.drop(*options.get("id_cols", ())), target, algorithm)
    return ready, fit(ready(df), target, algorithm, **options)


def holdout(df: DataFrame, target: str, id_cols: list[str], seed: int, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    cut = hash_key(id_cols, seed) < format(int(share * 16**6), "06x")
    return df.where(cut), df.where(~cut)


def screen(s: Split | DataFrame, target: str, *, id_cols: list[str], names: list[str] | None = None, seed: int = 42, budget: float | None = None, threads: int = 4, metric: str | None = None) -> list[dict]:
    """Fit every algorithm of the task, cheap ones first, and rank them on the valid part. Failures are rows with an error."""
    train, valid = (s.train, s.valid) if isinstance(s, Split) else holdout(s, target, id_cols, seed)
    train, valid = train.persist(), valid.persist()
    task, began = detect_task(train, target), clock.monotonic()
    names = sorted(names or algorithms(task), key=COST.index)
    metric = metric or ("rmse" if task == "regression" else "accuracy")

    def one(name: str) -> dict:
        if budget is not None and clock.monotonic() - began > budget:
            return {"name": name, "error": "out of time"}
        try:
            start = clock.monotonic()
            ready, model = fit_pipeline(train, target, name, seed=seed, task=task, id_cols=tuple(id_cols))
            return {"name": name, **rounded(bundle(model, ready(valid))), "seconds": round(clock.monotonic() - start, 2)}
        except Exception as e:  # a row of the leaderboard, not lost
            return {"name": name, "error": str(e)[:200]}

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(one, names))
    train.unpersist()
    valid.unpersist()
    return ordered(rows, metric)


def cross_validate(folds: Folds, target: str, algorithm: str, metric: str, **options) -> dict:
    """Mean and sample deviation of a metric over folds; each fold prepares and fits on its own train rows."""
    values = []
    for train, valid in folds:
        ready, model = fit_pipeline(train, target, algorithm, **options)
        values.append(bundle(model, ready(valid))[metric])
    mean = sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) if len(values) > 1 else 0.0
    return {"mean": mean, "std": std, "values": values}


def grid(space: dict) -> list[dict]:
    keys = sorted(space)
    return [dict(zip(keys, v, strict=True)) for v in itertools.product(*[space[k] for k in keys])]


def draw(space: dict, rnd: random.Random) -> dict:
    """A random point: of a list one value, of a (low, high) pair a number, log-uniform if the ends differ a hundredfold."""
    out = {}
    for k in sorted(space):
        v = space[k]
        if isinstance(v, tuple) and len(v) == 2:
            low, high = v
            x = math.exp(rnd.uniform(math.log(low), math.log(high))) if low > 0 and high / low > 100 else rnd.uniform(low, high)
            out[k] = round(x) if isinstance(low, int) and isinstance(high, int) else x
        else:
            out[k] = rnd.choice(list(v))
    return out


def tune(s: Split | DataFrame, target: str, algorithm: str, space: dict, *, id_cols: list[str], method: str = "random", trials: int = 10, folds: int = 3, seed: int = 42, metric: str | None = None, budget: float | None = None) -> dict:
    """Best parameters by cross-validation over dev: grid or random search. Every trial is in the history, failed ones with their error."""
    if method not in ("grid", "random"):
        raise ConfigError("method is grid or random")
    dev = s.dev if isinstance(s, Split) else s
    task = detect_task(dev, target)
    metric = metric or ("rmse" if task == "regression" else "accuracy")
    rnd, began, history = random.Random(seed), clock.monotonic(), []
    points = grid(space) if method == "grid" else [draw(space, rnd) for _ in range(trials)]
    parts = cv(dev, id_cols=id_cols, target=target, folds=folds, seed=seed)
    parts.data.persist()
    for point in points:
        if budget is not None and history and clock.monotonic() - began > budget:
            break
        try:
            r = cross_validate(parts, target, algorithm, metric, seed=seed, task=task, id_cols=tuple(id_cols), **point)
            history.append({"name": str(point), "params": point, metric: r["mean"], "std": r["std"]})
        except Exception as e:  # kept in the history
            history.append({"name": str(point), "params": point, metric: None, "error": str(e)[:200]})
    parts.data.unpersist()
    best = ordered(history, metric)[0]
    if best[metric] is None:
        raise DataError("every trial failed: " + best["error"])
    ready, model = fit_pipeline(dev, target, algorithm, seed=seed, task=task, id_cols=tuple(id_cols), **best["params"])
    return {"best": best["params"], "score": best[metric], "history": history, "model": model, "pipe": ready}


def nested_cv(df: DataFrame, target: str, names: list[str], *, id_cols: list[str], outer: int = 3, inner: int = 2, seed: int = 42, metric: str | None = None) -> list[dict]:
    """Outer scores of each algorithm, its inner ones, and the gap between the two."""
    task = detect_task(df, target)
    metric = metric or ("rmse" if task == "regression" else "accuracy")
    rows = []
    for name in names:
        inside, outside = [], []
        for train, valid in cv(df, id_cols=id_cols, target=target, folds=outer, seed=seed):
            options = {"seed": seed, "task": task, "id_cols": tuple(id_cols)}
            inside.append(cross_validate(cv(train, id_cols=id_cols, target=target, folds=inner, seed=seed + 1), target, name, metric, **options)["mean"])
            ready, model = fit_pipeline(train, target, name, **options)
            outside.append(bundle(model, ready(valid))[metric])
        a, b = sum(inside) / outer, sum(outside) / outer
        rows.append({"name": name, metric: b, "inner": a, "gap": a - b})
    return ordered(rows, metric)


def permuted(df: DataFrame, columns: list[str], id_cols: list[str], seed: int) -> DataFrame:
    """``df`` with the given columns taken from another row: rows in one hash order meet those in another."""
    a = hash_index(df, id_cols, seed, rn="__i", n="__n").drop("__n")
    b = hash_index(df.select(*id_cols, *columns), id_cols, seed + 1, rn="__i", n="__n").select("__i", *[F.col(c).alias(f"__p_{c}") for c in columns])
    return a.drop(*columns).join(b, "__i").drop("__i").withColumnsRenamed({f"__p_{c}": c for c in columns})


def explain(model: Model, df: DataFrame | None = None, *, id_cols: list[str] | None = None, method: str = "native", repeats: int = 5, metric: str | None = None, groups: dict[str, list[str]] | None = None, seed: int = 42) -> dict[str, float]:
    """Importances that sum to 1: the model's own, or the loss of a metric when features are permuted."""
    if method == "native":
        if not model.importances:
            raise ConfigError(f"{model.algorithm} has no native importances; use permutation")
        return dict(sorted(model.importances.items(), key=lambda x: (-x[1], x[0])))
    metric = metric or primary(model.task, model.classes)
    base = bundle(model, df)[metric]
    groups = groups or {f: [f] for f in model.features}
    raw = {}
    for name, columns in groups.items():
        drops = [worse_by(metric, bundle(model, permuted(df, columns, id_cols, seed + 2 * k))[metric], base) for k in range(repeats)]
        raw[name] = max(0.0, sum(drops) / repeats)
    total = sum(raw.values())
    return dict(sorted(((k, v / total if total else 0.0) for k, v in raw.items()), key=lambda x: (-x[1], x[0])))


def interact(model: Model, df: DataFrame, *, id_cols: list[str], top: int = 5, seed: int = 42) -> list[tuple[str, str, float]]:
    """Pairs of features by the deviation of f(ab) - f(a) - f(b) + f when they are permuted together and apart."""
    value = "prediction" if model.task == "regression" else f"probability_{model.classes[-1]}"
    scored = lambda d, name: model.predict(d).select(*id_cols, F.col(value).alias(name))
    base, found = scored(df, "f"), []
    for a, b in itertools.combinations(model.features, 2):
        t = base.join(scored(permuted(df, [a], id_cols, seed), "fa"), id_cols).join(scored(permuted(df, [b], id_cols, seed), "fb"), id_cols).join(scored(permuted(df, [a, b], id_cols, seed), "fab"), id_cols)
        found.append((a, b, t.agg(F.stddev_pop(F.col("fab") - F.col("fa") - F.col("fb") + F.col("f"))).first()[0] or 0.0))
    return sorted(found, key=lambda x: (-x[2], x[0], x[1]))[:top]


def select(model: Model, df: DataFrame | None = None, threshold: float = 0.01, correlation: float | None = None) -> list[str]:
    """Features of at least the threshold's importance (at least one); of correlated ones the more important."""
    ranked = sorted(model.importances.items(), key=lambda x: (-x[1], x[0]))
    kept = [f for f, v in ranked if v >= threshold] or [ranked[0][0]]
    if correlation is not None and df is not None:
        near = {frozenset((r["a"], r["b"])) for r in correlations(df, kept).where(F.abs("r") > correlation).collect()}
        out: list[str] = []
        for f in kept:
            if all(frozenset((f, g)) not in near for g in out):
                out.append(f)
        kept = out
    return kept


def enough(df: DataFrame, target: str, *, id_cols: list[str], algorithm: str = "auto", steps: int = 6, seed: int = 42, metric: str | None = None) -> dict:
    """Learning curve over nested hash prefixes of the train rows; saturated if the second half gains less than a hundredth."""
    train, valid = holdout(df, target, id_cols, seed)
    task = detect_task(df, target)
    metric = metric or ("r2" if task == "regression" else "accuracy")
    key, curve = hash_key(id_cols, seed + 1), []
    if df.limit(50).count() < 50:
        raise DataError("enough needs at least 50 rows")
    for k in range(1, steps + 1):
        part = train if k == steps else train.where(key < format(int(k / steps * 16**6), "06x"))
        try:
            ready, model = fit_pipeline(part, target, algorithm, seed=seed, task=task, id_cols=tuple(id_cols))
            curve.append({"share": k / steps, "rows": part.count(), "score": bundle(model, ready(valid))[metric]})
        except Exception as e:  # part of the curve
            curve.append({"share": k / steps, "rows": part.count(), "score": None, "error": str(e)[:200]})
    scores = [c["score"] for c in curve if c["score"] is not None]
    half = len(scores) // 2
    saturated = len(scores) >= 4 and max(scores[half:]) - max(scores[:half]) < 0.01
    return {"curve": curve, "saturated": saturated, "metric": metric}


def shelf(model: Model, new: DataFrame, recorded: dict[str, float], tolerance: float = 0.05) -> dict:
    """Whether a model went stale: its metrics on new labelled rows against the recorded ones."""
    now = bundle(model, new)
    change = {m: worse_by(m, now[m], v) for m, v in recorded.items() if m in now and now[m] is not None}
    worst = max(change.values(), default=0.0)
    return {"stale": worst > tolerance, "worst": worst, "change": change, "metrics": rounded(now)}


def stack(df: DataFrame, target: str, names: list[str], *, id_cols: list[str], folds: int = 3, seed: int = 42, passthrough: bool = False) -> Stack:
    """Base models' out-of-fold predictions are the features of a meta model; the bases are then fitted on all rows."""
    task = detect_task(df, target)
    parts, made = cv(df, id_cols=id_cols, target=target, folds=folds, seed=seed), None
    parts.data.persist()
    options = {"seed": seed, "task": task, "id_cols": tuple(id_cols)}
    for train, valid in parts:
        bases = {n: fit_pipeline(train, target, n, **options) for n in names}
        one = Stack.features(bases, valid, id_cols)
        made = one if made is None else made.unionByName(one)
    rows = made.join(df if passthrough else df.select(*id_cols, target), id_cols)
    meta = fit_pipeline(rows, target, "linear" if task == "regression" else "logistic", **options)
    parts.data.unpersist()
    return Stack({n: fit_pipeline(df, target, n, **options) for n in names}, meta, id_cols, passthrough)


@dataclass
class Stack:
    bases: dict[str, tuple[Pipe, Model]]
    meta: tuple[Pipe, Model]
    id_cols: list[str]
    passthrough: bool = False

    @staticmethod
    def features(bases: dict, df: DataFrame, id_cols: list[str]) -> DataFrame:
        out = df.select(*id_cols)
        for n, (ready, model) in bases.items():
            values = ["prediction"] if model.task == "regression" else [f"probability_{c}" for c in model.classes[1:]]
            out = out.join(model.predict(ready(df)).select(*id_cols, *[F.col(v).alias(f"{n}_{i}") for i, v in enumerate(values)]), id_cols)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        rows = self.features(self.bases, df, self.id_cols).join(df, self.id_cols)
        ready, model = self.meta
        return model.predict(ready(rows))


def check(df: DataFrame, target: str, algorithm: str = "random_forest", seed: int = 42, id_cols: tuple[str, ...] = ()) -> bool:
    """Whether two fits with the same seed predict the same."""
    a, b = (fit(df, target, algorithm, seed=seed, id_cols=id_cols).predict(df, proba=False) for _ in range(2))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def quick(df: DataFrame, target: str, *, id_cols: list[str], seed: int = 42) -> dict:
    """Split, screen three cheap algorithms, fit the best and evaluate it."""
    s = split(df, target, id_cols=id_cols, seed=seed)
    names = [n for n in COST if n in algorithms(s.task)][:3]
    board = screen(s, target, id_cols=id_cols, names=names, seed=seed)
    ready, model = fit_pipeline(s.train, target, board[0]["name"], seed=seed, task=s.task, id_cols=tuple(id_cols))
    return {"split": s, "leaderboard": board, "model": model, "pipe": ready, "metrics": rounded(bundle(model, ready(s.valid)))}


def verify(model: Model) -> dict:
    """What of a model's origin is known."""
    missing = [k for k in ("split_id", "fingerprint") if not model.provenance.get(k)]
    return {"status": "verified" if not missing else "unverified", "missing": missing}


CONFIG: dict = {"threads": 4, "verbose": 0, "guards": "strict"}


def config(**options) -> dict:
    unknown = set(options) - set(CONFIG)
    if unknown:
        raise ConfigError(f"unknown settings {sorted(unknown)}")
    CONFIG.update(options)
    if "guards" in options:
        provenance.guards(options["guards"])
    return dict(CONFIG)


@dataclass
class Report:
    """An HTML summary of a model: metrics, importances and, for classification, the confusion matrix."""

    model: Model
    sections: dict[str, list[tuple]] = field(default_factory=dict)

    def html(self) -> str:
        from html import escape

        parts = [f"<h1>{escape(self.model.algorithm)}</h1>"]
        for title, rows in self.sections.items():
            cells = "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in rows)
            parts.append(f"<h2>{escape(title)}</h2><table>{cells}</table>")
        return "<!DOCTYPE html><meta charset='utf-8'>" + "".join(parts)


def report(model: Model, df: DataFrame, path: str | None = None) -> str:
    sections = {"metrics": sorted(rounded(bundle(model, df)).items()), "importances": list(model.importances.items())}
    if model.task == "classification":
        cells = M.confusion(model.predict(df), model.target, "prediction").orderBy("actual", "predicted").collect()
        sections["confusion"] = [("actual", "predicted", "n"), *[tuple(r) for r in cells]]
    text = Report(model, sections).html()
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text
