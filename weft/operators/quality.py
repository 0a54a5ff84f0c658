"""Profiles, data checks and leakage checks, as few aggregates over the whole table (no sampling)."""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..functions.metrics import roc_auc
from .partition import detect_task
from ..plans.ordering import percentiles, searchsorted
from .transforms import numeric_columns

CHECK = "check string, feature string, value double, severity string"


def _long(row: DataFrame, parts: list[tuple]) -> DataFrame:
    """One wide row to a row for each (name, columns)."""
    structs = [F.struct(F.lit(name).alias("column"), *[c.alias(n) for n, c in cols]) for name, cols in parts]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def profile(df: DataFrame) -> DataFrame:
    """A row a column: dtype, count, missing, missing_pct, unique; mean, std, min, max, median of numbers; top and top_freq of others.

    One aggregate for counts and moments, exact medians by closing in on their ranks, and for each column a count of its values, which gives
    the number of distinct ones and the top: it reads and shuffles that column alone, once, after a partial aggregation.
    """
    numbers = numeric_columns(df)
    medians = percentiles(df, {c: [0.5] for c in numbers})
    made, parts, counted = [F.count(F.lit(1)).alias("n")], [], None
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        number = f.name in numbers
        made.append(F.count(c).alias(f"c{i}"))
        if number:
            made += [F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"s{i}"), F.min(c).cast("double").alias(f"l{i}"), F.max(c).cast("double").alias(f"h{i}")]
        missing = F.col("n") - F.col(f"c{i}")
        null = F.lit(None).cast("double")
        parts.append((f.name, [
            ("dtype", F.lit(f.dataType.simpleString())), ("count", F.col("n")), ("missing", missing),
            ("missing_pct", F.when(F.col("n") > 0, F.round(100 * missing / F.col("n"), 1)).otherwise(F.lit(0.0))),
            *[(k, F.col(f"{x}{i}") if number else null) for k, x in (("mean", "a"), ("std", "s"), ("min", "l"), ("max", "h"))],
            ("median", F.lit(medians[f.name][0]).cast("double") if number else null),
        ]))
        values = df.select(c.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
        # The largest count, of ties the smallest value.
        text = F.col("v").cast("string")
        top = [F.lit(None).cast("long"), F.lit(None).cast("string")] if number else [F.max("k"), F.min_by(text, F.struct(-F.col("k"), text))]
        one = values.agg(F.count(F.lit(1)).alias("unique"), top[0].alias("top_freq"), top[1].alias("top")).select(F.lit(f.name).alias("column"), "*")
        counted = one if counted is None else counted.unionAll(one)
    table = _long(df.agg(*made), parts).join(F.broadcast(counted), "column")
    return table.select("column", "dtype", "count", "missing", "missing_pct", "unique", "mean", "std", "min", "max", "median", "top_freq", "top")


def profile_target(df: DataFrame, target: str) -> DataFrame:
    """Class, n, share, number of classes and whether the class makes up less than a fifth."""
    t = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    share = F.col("n") / F.sum("n").over(every)
    return t.select("class", "n", share.alias("share"), F.count(F.lit(1)).over(every).alias("n_classes"), (share < 0.2).alias("minority"))


def condition_number(df: DataFrame, columns: list[str] | None = None) -> float:
    """Condition number of the numeric matrix, from its Gram matrix (one aggregate) and its eigenvalues."""
    import numpy as np

    columns = columns or numeric_columns(df)
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).na.drop()
    k = len(columns)
    r = rows.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)]).first()
    gram, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = r[at] or 0.0
            at += 1
    values = np.linalg.eigvalsh(gram)
    return float("inf") if values[0] <= 0 else float(np.sqrt(values[-1] / values[0]))


def pearson(a, b):
    """Correlation over rows that have both; null where one is constant, NaN where one is infinite."""
    a, b = a.cast("double"), b.cast("double")
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for each pair of columns, from one aggregate."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    row = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, and rows beyond the first of their kind."""
    t = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return t.agg(F.sum("__n").alias("rows"), F.sum(F.col("__n") - 1).alias("duplicates"))


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values of each column, nulls aside.

    Each column is counted by itself. One aggregate with several distinct counts would make a row a column of every row, as wide as all columns,
    and hold them in the tasks that read the table.
    """
    counted = None
    for i, c in enumerate(columns):
        values = df.select(F.col(c).alias("v")).where("v is not null").distinct()
        one = values.agg(F.count(F.lit(1)).alias("u")).select(F.lit(i).alias("i"), "u")
        counted = one if counted is None else counted.unionAll(one)
    return {columns[r["i"]]: r["u"] for r in counted.collect()} if columns else {}


def check_data(df: DataFrame, target: str | None = None, severity: str | None = None) -> DataFrame:
    """Findings (check, feature, value, severity) of eight checks; with ``severity="error"``, an error finding raises."""
    numbers = [c for c in numeric_columns(df) if c != target]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    features = [c for c in df.columns if c != target]
    made = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        made.append(F.count(c).alias(f"c{i}"))
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            made.append(F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"i{i}"))
    if target:
        made.append(F.count_if(F.col(target).isNull()).alias("t"))
    r, unique = df.agg(*made).first().asDict(), distinct_counts(df, features)
    n, found = r["n"], []
    if target and r["t"]:
        found.append(("null_target", target, float(r["t"]), "error"))
    for i, c in enumerate(features):
        if r.get(f"i{i}"):
            found.append(("infinite", c, float(r[f"i{i}"]), "error"))
        if unique[c] == n and n > 10 and isinstance(kinds[c], (T.IntegralType, T.StringType)):
            found.append(("id_like", c, 1.0, "warning"))
        if unique[c] <= 1:
            found.append(("zero_variance", c, float(unique[c]), "warning"))
        if n and 1 - r[f"c{i}"] / n > 0.5:
            found.append(("many_nulls", c, 1 - r[f"c{i}"] / n, "warning"))
    if target and detect_task(df, target) == "classification":
        classes = profile_target(df.where(F.col(target).isNotNull()), target).collect()
        if len(classes) == 1:
            found.append(("single_class", target, 1.0, "error"))
        found += [("rare_class", f"{target}={k['class']}", k["share"], "warning") for k in classes if len(classes) > 1 and k["share"] <= 0.05]
    # Rows that differ in one column are no duplicates.
    if n not in unique.values():
        d = duplicate_rows(df).first()
        if d["rows"] and d["duplicates"] / d["rows"] > 0.1:
            found.append(("duplicates", "*", d["duplicates"] / d["rows"], "warning"))
    found += [("correlated", f"{p['a']}~{p['b']}", abs(p["r"]), "warning") for p in correlations(df, numbers).where("abs(r) > 0.95 and not isnan(r)").collect()]
    if severity == "error" and any(f[3] == "error" for f in found):
        raise DataError("; ".join(f"{f[0]} in {f[1]}" for f in found if f[3] == "error"))
    return df.sparkSession.createDataFrame(found, CHECK)


# Leakage

ID_NAME = re.compile(r"^id$|_id$|^index$|^key$|_key$", re.I)
FUTURE_NAME = re.compile(r"^future_|_future$|^next_|_next$|_after$|_outcome$|_result$", re.I)


def target_correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """feature, value: absolute correlation with the target."""
    y = F.col(target).cast("double")
    row = df.agg(*[F.abs(pearson(F.col(c), y)).alias(f"r{i}") for i, c in enumerate(columns)])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("value")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def single_auc(df: DataFrame, y, feature: str) -> DataFrame:
    """One row: the better of AUC and 1 - AUC of one feature."""
    t = df.where(F.col(feature).isNotNull())
    return roc_auc(t, y, feature).select(F.lit(feature).alias("feature"), F.greatest("auc", 1 - F.col("auc")).alias("value"))


def mutual_information(df: DataFrame, target: str, feature: str, bins: int = 10) -> DataFrame:
    """One row: information in nats between the target and a feature's quantile bins."""
    edges = sorted({e for e in percentiles(df, {feature: [k / bins for k in range(1, bins)]})[feature] if e is not None})
    number = searchsorted(edges, F.col(feature).cast("double"))
    cells = df.where(F.col(feature).isNotNull()).groupBy(number.alias("b"), F.col(target).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    n, nb, ny = (F.sum("n").over(Window.partitionBy(*w)) for w in ([F.lit(0)], ["b"], ["y"]))
    term = cells.select((F.col("n") / n * F.log(F.col("n") * n / (nb * ny))).alias("x"))
    return term.agg(F.greatest(F.sum("x"), F.lit(0.0)).alias("mi")).select(F.lit(feature).alias("feature"), F.col("mi").alias("value"))


def duplicate_share(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: distinct test rows that train has too, their number over test's rows."""
    common = [c for c in test.columns if c in train.columns]
    both = test.select(*common).intersect(train.select(*common)).agg(F.count(F.lit(1)).alias("shared"))
    return both.crossJoin(F.broadcast(test.agg(F.count(F.lit(1)).alias("rows")))).select("shared", "rows", F.try_divide("shared", "rows").alias("share"))


def temporal_overlap(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """One row: test rows before the latest of train."""
    last = train.agg(F.max(column).alias("__last"))
    t = test.crossJoin(F.broadcast(last))
    return t.agg(F.count_if(F.col(column) < F.col("__last")).alias("before"), F.count(F.lit(1)).alias("rows")).select("before", "rows", F.try_divide("before", "rows").alias("share"))


def leak(train: DataFrame, target: str, test: DataFrame | None = None) -> DataFrame:
    """Findings of seven leakage checks: correlation, single-feature AUC, mutual information, ids, names, shared rows, time overlap."""
    kinds = {f.name: f.dataType for f in train.schema.fields}
    numbers = [c for c in numeric_columns(train) if c != target]
    features = [c for c in train.columns if c != target]
    task = detect_task(train, target)
    classes = [r[0] for r in train.where(F.col(target).isNotNull()).select(target).distinct().orderBy(target).limit(101).collect()] if task == "classification" else []
    binary, found = len(classes) == 2, []
    if numbers and (task == "regression" or binary):
        y = train.withColumn("__y", (F.col(target) == F.lit(classes[1])).cast("double") if binary else F.col(target).cast("double"))
        for r in target_correlations(y, "__y", numbers).where("value > 0.8 and not isnan(value)").collect():
            found.append(("correlation", r["feature"], r["value"], "critical" if r["value"] > 0.95 else "warning"))
    if binary:
        for c in numbers:
            v = single_auc(train, F.col(target) == F.lit(classes[1]), c).first()["value"]
            if v is not None and v > 0.95:
                found.append(("single_auc", c, v, "critical" if v > 0.99 else "warning"))
    if task == "classification" and numbers:
        shares = profile_target(train.where(F.col(target).isNotNull()), target).agg(F.sum(-F.col("share") * F.log("share")).alias("h")).first()["h"]
        for c in numbers:
            v = mutual_information(train.where(F.col(target).isNotNull()), target, c).first()["value"]
            if v is not None and shares > 0 and v > 0.9 * shares:
                found.append(("mutual_information", c, v, "warning"))
    n, unique = train.count(), distinct_counts(train, features)
    for c in features:
        ratio = unique[c] / max(1, n)
        if (ratio > 0.95 and isinstance(kinds[c], (T.IntegralType, T.StringType))) or ID_NAME.search(c):
            found.append(("id_column", c, ratio, "warning"))
        if target.lower() in c.lower() or FUTURE_NAME.search(c):
            found.append(("target_name", c, 1.0, "warning"))
    if test is not None:
        share = duplicate_share(train, test).first()["share"] or 0.0
        if share > 0:
            found.append(("shared_rows", "*", share, "critical" if share > 0.01 else "warning"))
        for c, kind in kinds.items():
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and c in test.columns:
                before = temporal_overlap(train, test, c).first()["share"] or 0.0
                if before > 0:
                    found.append(("time_overlap", c, before, "warning"))
    return train.sparkSession.createDataFrame(found, CHECK)


def suspects(findings: DataFrame, top: int = 3) -> DataFrame:
    """The features with the largest values, one row a feature."""
    best = findings.groupBy("feature").agg(F.max("value").alias("value"))
    return best.orderBy(F.desc("value"), "feature").limit(top)


def cluster_features(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.8) -> list[list[str]]:
    """Groups of columns whose absolute correlation exceeds the threshold within each group (complete linkage)."""
    columns = columns or numeric_columns(df)
    near = {frozenset((r["a"], r["b"])): abs(r["r"] or 0.0) for r in correlations(df, columns).collect()}
    groups = [[c] for c in columns]
    while len(groups) > 1:
        link = lambda g, h: min(near[frozenset((a, b))] for a in g for b in h)
        value, i, j = max((link(groups[i], groups[j]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if value < threshold:
            break
        groups[-i] = groups[-i] + groups.pop(-j)
    return sorted((sorted(g) for g in groups), key=lambda g: (-len(g), g))
