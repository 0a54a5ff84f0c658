"""Fitted feature transforms: statistics in one aggregate at fit, a projection (or a join for large vocabularies) at transform."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, DataError
from ..plans.ordering import percentiles

#: Up to so many levels a mapping is part of the plan; beyond it, it is a joined table.
LITERAL_LEVELS = 256
#: One-hot columns a transform may make.
MOST_COLUMNS = 2000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


class Transform:
    """``t(df)`` or ``t.transform(df)``; statistics are attributes."""

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.transform(df)


def _need(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataError(f"no columns {missing}")


# Encoding


def _as_text(c: str) -> Column:
    """A level as text; a null is the level ``nan``."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


@dataclass
class LevelEncoder(Transform):
    """Replaces a column by values looked up by level. ``tables``: column -> (level column, value columns, default)."""

    method: str
    tables: dict[str, DataFrame]
    outputs: dict[str, list[str]]
    defaults: dict[str, list[float]]
    key: Callable[[str], Column]

    def transform(self, df: DataFrame) -> DataFrame:
        _need(df, list(self.tables))
        for c, table in self.tables.items():
            out, names = self.outputs[c], [f"__v{k}" for k in range(len(self.outputs[c]))]
            rows = table.toDF("__level", *names)
            joined = df.withColumn("__key", self.key(c)).join(rows, F.col("__key") == F.col("__level"), "left")
            values = [F.coalesce(F.col(n), F.lit(d)).alias(o) for n, d, o in zip(names, self.defaults[c], out, strict=True)]
            df = joined.select(*[x for x in df.columns if x != c and x not in out], *values)
        return df


@dataclass
class OneHot(Transform):
    """A 0/1 column ``{column}_{level}`` for each level; unseen levels and nulls give zeros."""

    levels: dict[str, list[str]]

    def transform(self, df: DataFrame) -> DataFrame:
        _need(df, list(self.levels))
        made = [F.when(F.col(c).cast("string") == v, 1).otherwise(0).alias(f"{c}_{v}") for c, vs in self.levels.items() for v in vs]
        return df.select(*[F.col(c) for c in df.columns if c not in self.levels], *made)


@dataclass
class DateParts(Transform):
    """year, month, day, dayofweek (Monday 0), is_weekend, and hour where fit saw one that isn't 0."""

    hours: dict[str, bool]

    def transform(self, df: DataFrame) -> DataFrame:
        _need(df, list(self.hours))
        made = []
        for c, hour in self.hours.items():
            made += [F.year(c).alias(f"{c}_year"), F.month(c).alias(f"{c}_month"), F.dayofmonth(c).alias(f"{c}_day"), F.weekday(c).alias(f"{c}_dayofweek"), (F.weekday(c) >= 5).cast("int").alias(f"{c}_is_weekend")]
            if hour:
                made.append(F.hour(c).alias(f"{c}_hour"))
        return df.select(*[F.col(c) for c in df.columns if c not in self.hours], *made)


def levels_of(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("level")).distinct()


def encode(df: DataFrame, columns: Sequence[str], method: str = "onehot", *, target: str | None = None, smoothing: float | str = "auto", fold: Column | None = None) -> Transform:
    """Fit an encoder: onehot, ordinal, target, frequency, woe or datetime."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    _need(df, columns)
    if method == "onehot":
        found = {}
        for c in columns:
            rows = [r[0] for r in levels_of(df, c).orderBy("level").limit(MOST_COLUMNS + 1).collect()]
            if len(rows) > MOST_COLUMNS:
                raise DataError(f"{c!r} has more than {MOST_COLUMNS} levels; use another method")
            found[c] = rows
        return OneHot(found)
    if method == "datetime":
        r = df.agg(*[F.coalesce(F.max((F.hour(c) != 0).cast("int")), F.lit(0)).alias(c) for c in columns]).first()
        return DateParts({c: bool(r[c]) for c in columns})
    tables, outputs, defaults, key = {}, {}, {}, _as_text
    if method == "ordinal":
        key = lambda c: F.col(c).cast("string")
        from ..plans.ordering import ordered_index

        for c in columns:
            rows = ordered_index(levels_of(df, c), [], F.ascii("level"), [F.col("level")])
            tables[c] = rows.select("level", (F.col("__rn") - 1).cast("double"))
            outputs[c], defaults[c] = [c], [-1.0]
    elif method == "frequency":
        n = df.count()
        for c in columns:
            tables[c] = df.groupBy(_as_text(c).alias("level")).agg((F.count(F.lit(1)) / n).alias("v"))
            outputs[c], defaults[c] = [c], [0.0]
    elif method == "woe":
        classes = _classes(df, target)
        if len(classes) != 2:
            raise DataError("woe needs a binary target")
        for c in columns:
            tables[c] = woe_table(df, c, target, classes[1]).select("level", "woe")
            outputs[c], defaults[c] = [c], [0.0]
    elif method == "target":
        return fit_target(df, columns, target, smoothing)
    else:
        raise ConfigError(f"unknown method {method!r}")
    return LevelEncoder(method, tables, outputs, defaults, key)


def _classes(df: DataFrame, target: str | None) -> list:
    if target is None:
        raise ConfigError("this method needs a target")
    rows = [r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().orderBy(target).limit(1001).collect()]
    if len(rows) > 1000:
        raise DataError(f"target {target!r} has more than 1000 classes")
    return rows


def shrunk(mean: Column, n: Column, overall: float | Column, smoothing) -> Column:
    """A level's mean drawn towards the overall one: by a logistic weight in n, or by pseudo-counts."""
    weight = 1 / (1 + F.exp(-(n - 5.0))) if smoothing == "auto" else n / (n + F.lit(float(smoothing)))
    return weight * mean + (1 - weight) * overall


def fit_target(df: DataFrame, columns: Sequence[str], target: str | None, smoothing) -> LevelEncoder:
    """Mean of the target by level: of its values if numeric, of the indicators of the last K - 1 classes otherwise."""
    if target is None:
        raise ConfigError("this method needs a target")
    if isinstance(df.schema[target].dataType, T.NumericType):
        sides = {"": F.col(target).cast("double")}
    else:
        classes = _classes(df, target)
        sides = {f"_te_{k}": (F.col(target) == F.lit(v)).cast("double") for k, v in list(enumerate(classes))[1:]}
        sides = {"": next(iter(sides.values()))} if len(sides) == 1 else sides
    overall = df.agg(*[F.avg(s).alias(f"m{k}") for k, s in enumerate(sides.values())]).first()
    tables = {
        c: df.groupBy(_as_text(c).alias("level")).agg(*[shrunk(F.avg(s), F.count(s).cast("double"), F.lit(overall[k]), smoothing).alias(f"v{k}") for k, s in enumerate(sides.values())])
        for c in columns
    }
    return LevelEncoder("target", tables, {c: [c + suffix for suffix in sides] for c in columns}, {c: list(overall) for c in columns}, _as_text)


def target_out_of_fold(df: DataFrame, c: str, target: str, fold: str, smoothing="auto", out: str | None = None) -> DataFrame:
    """Each row's target mean from the rows of the other folds: totals less the fold's own, in one aggregate and a join."""
    y = F.col(target).cast("double")
    by_fold = df.groupBy(_as_text(c).alias("__l"), F.col(fold).alias("__f")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    every = by_fold.groupBy("__l").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    sides = by_fold.groupBy("__f").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    whole = by_fold.agg(F.sum("s").alias("as"), F.sum("n").alias("an"))
    t = by_fold.join(every, "__l").join(F.broadcast(sides), "__f").crossJoin(F.broadcast(whole))
    rest = F.col("tn") - F.col("n")
    overall = (F.col("as") - F.col("fs")) / (F.col("an") - F.col("fn"))
    t = t.select("__l", "__f", F.when(rest > 0, shrunk((F.col("ts") - F.col("s")) / rest, rest.cast("double"), overall, smoothing)).otherwise(overall).alias(out or f"{c}_te"))
    return df.join(t, (_as_text(c) == F.col("__l")) & (F.col(fold) == F.col("__f"))).drop("__l", "__f")


def woe_table(df: DataFrame, c: str, target: str, positive) -> DataFrame:
    """level, events, others, woe and the level's share of the information value. Half a row is added to each cell."""
    y = F.col(target) == F.lit(positive)
    t = df.where(F.col(target).isNotNull()).groupBy(_as_text(c).alias("level")).agg(F.count_if(y).alias("events"), F.count_if(~y).alias("others"))
    total = t.agg(F.sum("events").alias("te"), F.sum("others").alias("to"), F.count(F.lit(1)).alias("k"))
    t = t.crossJoin(F.broadcast(total))
    de = (F.col("events") + 0.5) / (F.col("te") + 0.5 * F.col("k"))
    dn = (F.col("others") + 0.5) / (F.col("to") + 0.5 * F.col("k"))
    return t.select("level", "events", "others", F.log(de / dn).alias("woe"), ((de - dn) * F.log(de / dn)).alias("iv"))


def label_index(df: DataFrame, target: str) -> dict:
    """Class -> 0 .. K-1 in order."""
    return {v: k for k, v in enumerate(_classes(df, target))}


# Scaling


@dataclass
class Scaler(Transform):
    method: str
    centre: dict[str, float]
    width: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        _need(df, list(self.centre))
        return df.withColumns({c: (F.col(c) - m) / self.width[c] for c, m in self.centre.items()})


def scale(df: DataFrame, columns: Sequence[str] | None = None, method: str = "standard", *, target: str | None = None) -> Scaler:
    """standard (population deviation), minmax, or robust (exact quartiles). A width of 0 counts as 1."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    _need(df, columns)
    if method == "robust":
        found = percentiles(df, {c: [0.5, 0.25, 0.75] for c in columns})
        return Scaler(method, {c: found[c][0] or 0.0 for c in columns}, {c: ((found[c][2] - found[c][1]) if found[c][0] is not None else 0.0) or 1.0 for c in columns})
    parts = {
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
        "minmax": lambda c: (F.min(c).cast("double"), F.max(c).cast("double") - F.min(c).cast("double")),
    }
    if method not in parts:
        raise ConfigError(f"unknown method {method!r}")
    found = [parts[method](c) for c in columns]
    r = df.agg(*[x.alias(f"{k}{i}") for i, (a, b) in enumerate(found) for k, x in (("a", a), ("b", b))]).first()
    return Scaler(method, {c: float(r[f"a{i}"] or 0) for i, c in enumerate(columns)}, {c: float(r[f"b{i}"] or 0) or 1.0 for i, c in enumerate(columns)})


# Missing values


@dataclass
class Imputer(Transform):
    method: str
    values: dict

    def transform(self, df: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        wide = {c: T.DoubleType() if self.method in ("median", "mean") else kinds[c] for c in self.values if c in kinds}
        return df.withColumns({c: F.coalesce(F.col(c).cast(wide[c]), F.lit(v).cast(wide[c])) for c, v in self.values.items() if c in kinds and v is not None})


def nulls_in(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    r = df.agg(*[F.max(F.col(c).isNull()).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r[i]]


def impute(df: DataFrame, columns: Sequence[str] | None = None, method: str = "median", value=None) -> Imputer:
    """median (exact), mean, mode (of ties the smallest) or constant; by default for columns that have nulls."""
    if method not in ("median", "mean", "mode", "constant"):
        raise ConfigError(f"unknown method {method!r}")
    if method == "constant" and value is None:
        raise ConfigError("constant needs a value")
    if columns is None:
        columns = nulls_in(df, numeric_columns(df) if method in ("median", "mean") else df.columns)
    _need(df, columns)
    if method == "constant":
        return Imputer(method, dict.fromkeys(columns, value))
    if method == "mode":
        # Of the largest count the smallest value, from one count of values a column.
        best = [df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__k")).agg(F.min_by(c, F.struct(-F.col("__k"), F.col(c)))).first()[0] for c in columns]
        return Imputer(method, dict(zip(columns, best, strict=True)))
    if method == "median":
        return Imputer(method, {c: v[0] for c, v in percentiles(df, {c: [0.5] for c in columns}).items()})
    r = df.agg(*[F.avg(c).alias(str(i)) for i, c in enumerate(columns)]).first() if columns else []
    return Imputer(method, {c: r[i] for i, c in enumerate(columns)})


@dataclass
class NullFlags(Transform):
    columns: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        _need(df, self.columns)
        return df.withColumns({f"{c}_is_null": F.col(c).isNull().cast("tinyint") for c in self.columns})


def null_flags(df: DataFrame, columns: Sequence[str] | None = None, *, target: str | None = None) -> NullFlags:
    return NullFlags(list(columns) if columns else nulls_in(df, [c for c in df.columns if c != target]))


# Binning


@dataclass
class Binner(Transform):
    """Bin numbers: how many inner edges a value reaches. Nulls first take the median."""

    edges: dict[str, list[float]]
    medians: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        _need(df, list(self.edges))
        made = {}
        for c, edges in self.edges.items():
            x = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
            made[c] = reduce(lambda a, b: a + b, [(x >= e).cast("int") for e in edges], F.lit(0))
        return df.withColumns(made)


def discretize(df: DataFrame, columns: Sequence[str], bins: int = 5, method: str = "quantile") -> Binner:
    if bins < 2:
        raise ConfigError("bins must be at least 2")
    if method not in ("quantile", "uniform"):
        raise ConfigError(f"unknown method {method!r}")
    _need(df, columns)
    found = percentiles(df, {c: [0.5, *(k / bins for k in range(1, bins) if method == "quantile")] for c in columns})
    r = df.agg(*[x.alias(f"{n}{i}") for i, c in enumerate(columns) for n, x in (("lo", F.min(c).cast("double")), ("hi", F.max(c).cast("double")))]).first()
    edges = {}
    for i, c in enumerate(columns):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        inner = [e for e in found[c][1:] if e is not None] if method == "quantile" else ([] if lo is None else [lo + (hi - lo) * k / bins for k in range(1, bins)])
        edges[c] = sorted({float(e) for e in inner if lo < e})
    return Binner(edges, {c: found[c][0] for c in columns})


# Composition


@dataclass
class Pipe(Transform):
    steps: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: d.transform(s), self.steps, df)

    process = transform


def pipe(*steps) -> Pipe:
    return Pipe(list(steps))


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in floating-point columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


LINEAR = {"linear", "logistic", "elastic_net", "svm", "knn"}


def prepare(df: DataFrame, target: str | None = None, algorithm: str = "auto") -> Pipe:
    """What an algorithm's family wants: linear ones one-hot (up to 50 levels, else ordinal), median and standard scale; trees ordinal and median."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name != target]
    numbers = [c for c in numeric_columns(df) if c != target]
    steps: list = []
    if algorithm in LINEAR:
        r = df.agg(*[F.approx_count_distinct(c).alias(c) for c in text]).first() if text else {}
        few = [c for c in text if r[c] <= 50]
        many = [c for c in text if c not in few]
        if few:
            steps.append(encode(df, few, "onehot"))
        if many:
            steps.append(encode(df, many, "ordinal"))
    elif text:
        steps.append(encode(df, text, "ordinal"))
    gaps = nulls_in(df, numbers)
    if gaps:
        steps.append(impute(df, gaps, "median"))
    if algorithm in LINEAR - {"linear"} and numbers:
        steps.append(scale(steps[-1](df) if gaps else df, numbers, "standard"))
    return Pipe(steps)
