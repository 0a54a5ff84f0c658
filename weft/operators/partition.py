"""Splits and cross-validation folds as columns of one lazy DataFrame.

Rows are ordered by a hash of their id and the seed, so a split depends on nothing but the rows themselves. Sizes round half to
even and the test part takes the rest. Roles are in ``__role`` (train, valid, test), folds in ``__fold``.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, DataError, PartitionError
from ..plans.ordering import hash_index, hash_key, time_index

ROLE, FOLD = "__role", "__fold"
RATIO = (0.6, 0.2, 0.2)


def detect_task(df: DataFrame, target: str) -> str:
    """classification or regression, by type and number of distinct values (one aggregate)."""
    kind = df.schema[target].dataType
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return "classification"
    if isinstance(kind, T.ArrayType):
        raise DataError(f"target {target!r} holds arrays")
    r = df.agg(F.countDistinct(target).alias("u"), F.count(target).alias("n"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
    if isinstance(kind, T.IntegralType):
        return "classification" if r["u"] <= 2 or (r["u"] <= 20 and r["u"] / max(1, r["n"]) <= 0.05) else "regression"
    return "classification" if r["u"] == 2 and (r["lo"], r["hi"]) == (0, 1) else "regression"


@dataclass
class Split:
    """A table with a role a row. ``train``, ``valid``, ``test`` and ``dev`` (train and valid) are filters on it."""

    data: DataFrame
    target: str | None = None
    task: str | None = None
    seed: int | None = None
    id_cols: list[str] = field(default_factory=list)
    time: str | None = None
    split_id: str | None = None

    def part(self, *roles: str) -> DataFrame:
        return self.data.where(F.col(ROLE).isin(*roles)).drop(ROLE)

    @property
    def train(self) -> DataFrame:
        return self.part("train")

    @property
    def valid(self) -> DataFrame:
        return self.part("valid")

    @property
    def test(self) -> DataFrame:
        return self.part("test")

    @property
    def dev(self) -> DataFrame:
        return self.part("train", "valid")

    def __iter__(self):
        roles = ("train", "valid", "test") if self.has_valid else ("train", "test")
        return iter(self.part(r) for r in roles)

    @cached_property
    def has_valid(self) -> bool:
        return not self.data.where(F.col(ROLE) == "valid").isEmpty()

    def sizes(self, by: str | None = None) -> DataFrame:
        return self.data.groupBy(ROLE, *([by] if by else [])).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Folds:
    """A table with a fold number a row (0 .. k-1): fold i validates on its rows and trains on the others."""

    data: DataFrame
    k: int
    target: str | None = None

    def fold(self, i: int) -> tuple[DataFrame, DataFrame]:
        return self.data.where(F.col(FOLD) != i).drop(FOLD), self.data.where(F.col(FOLD) == i).drop(FOLD)

    def __iter__(self):
        return (self.fold(i) for i in range(self.k))

    def __len__(self):
        return self.k

    @property
    def train(self):
        raise PartitionError("folds have no single train part; iterate over them")

    valid = test = dev = train


def check_ratio(ratio) -> tuple[float, ...]:
    ratio = tuple(float(r) for r in ratio)
    if len(ratio) not in (2, 3) or any(r <= 0 for r in ratio) or abs(sum(ratio) - 1) > 1e-6:
        raise ConfigError(f"ratio must be two or three positive shares that sum to 1, not {ratio}")
    return ratio


def _checked(df: DataFrame, target: str | None, seed: int, id_cols) -> tuple[DataFrame, list[str]]:
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    if len(set(df.columns)) != len(df.columns):
        raise DataError("column names repeat")
    for c in [*ids, *([target] if target else [])]:
        if c not in df.columns:
            raise DataError(f"no column {c!r}")
    if not 0 <= seed < 2**64:
        raise ConfigError("seed must be in [0, 2^64)")
    if target:
        df = df.where(F.col(target).isNotNull())
        r = df.agg(F.count(F.lit(1)).alias("n"), F.min(target).alias("lo"), F.max(target).alias("hi")).first()
        if r["n"] < 4:
            raise DataError("a split with a target needs at least 4 rows")
        if r["lo"] == r["hi"]:
            raise DataError(f"target {target!r} has one value only")
    return df, ids


def _role(rn, n, ratio, least: int):
    """CASE over cut points: round half to even, at least ``least`` rows, the rest to test."""
    cut = lambda r: F.greatest(F.lit(least), F.bround(n * r).cast("long")) if least else F.bround(n * r).cast("long")
    first = cut(ratio[0])
    if len(ratio) == 2:
        return F.when(rn <= first, "train").otherwise("test")
    return F.when(rn <= first, "train").when(rn <= first + cut(ratio[1]), "valid").otherwise("test")


def split(df: DataFrame, target: str | None = None, *, id_cols, seed: int = 42, ratio=RATIO, stratify: bool = True, task: str = "auto", time: str | None = None, groups: str | None = None, splitter=None):
    """Random or stratified roles; with ``time`` or ``groups``, the temporal or group split; with ``splitter``, its folds."""
    if sum(x is not None for x in (time, groups, splitter)) > 1:
        raise ConfigError("give one of time, groups and splitter")
    if time is not None:
        return split_temporal(df, target, time=time, id_cols=id_cols, ratio=ratio)
    if groups is not None:
        return split_group(df, target, groups=groups, seed=seed, ratio=ratio)
    ratio = check_ratio(ratio)
    df, ids = _checked(df, target, seed, id_cols)
    if splitter is not None:
        return Folds(df.withColumn(FOLD, splitter(df)), splitter.k, target)
    kind = (detect_task(df, target) if task == "auto" else task) if target else None
    if stratify and kind == "classification":
        indexed = hash_index(df, ids, seed, [target])
        rn, n = F.col("__rn"), F.col("__n")
        counts = [r[0] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).select("n").collect()]
        if all(_left_over(c, ratio) >= 1 for c in counts):
            if max(counts) > 10 * min(counts):
                warnings.warn("classes are imbalanced by more than 10 to 1", stacklevel=2)
            return Split(indexed.withColumn(ROLE, _role(rn, n, ratio, 1)).drop("__rn", "__n"), target, kind, seed, ids)
        warnings.warn("a class is too small to stratify; the split is random", stacklevel=2)
    out = hash_index(df, ids, seed).withColumn(ROLE, _role(F.col("__rn"), F.col("__n"), ratio, 0)).drop("__rn", "__n")
    return Split(out, target, kind, seed, ids)


def _left_over(n: int, ratio) -> int:
    return n - sum(max(1, round(n * r)) for r in ratio[:-1])


def split_temporal(df: DataFrame, target: str | None = None, *, time: str, id_cols, ratio=RATIO) -> Split:
    """Roles by time order; the time column is dropped. Rows without a time come first and warn."""
    ratio = check_ratio(ratio)
    df, ids = _checked(df, target, 0, id_cols)
    out = time_index(df, time, ids).withColumn(ROLE, _role(F.col("__rn"), F.col("__n"), ratio, 0)).drop("__rn", "__n", time)
    return Split(out, target, detect_task(df, target) if target else None, None, ids, time)


def group_order(df: DataFrame, groups: str, seed: int) -> DataFrame:
    """Distinct groups numbered in hash order: ``__g``, ``__rn``, ``__n``."""
    names = df.select(F.col(groups).alias("__g")).distinct()
    return hash_index(names, ["__g"], seed)


def split_group(df: DataFrame, target: str | None = None, *, groups: str, seed: int = 42, ratio=RATIO) -> Split:
    """Roles by whole groups: shares of the number of groups, at least one each."""
    ratio = check_ratio(ratio)
    if not df.where(F.col(groups).isNull()).isEmpty():
        raise DataError(f"groups {groups!r} hold nulls")
    if target:
        df = df.where(F.col(target).isNotNull())
    roles = group_order(df, groups, seed)
    if roles.limit(3).count() < 3:
        raise DataError("a group split needs at least 3 groups")
    roles = roles.select("__g", _role(F.col("__rn"), F.col("__n"), ratio, 1).alias(ROLE))
    return Split(df.join(roles, df[groups] == roles["__g"]).drop("__g"), target, None, seed, [])


def _dev(s) -> DataFrame:
    return s.dev if isinstance(s, Split) else s


def cv(s, *, id_cols=None, target: str | None = None, folds: int = 5, seed: int = 42, stratify: bool = True, repeats: int = 1) -> Folds:
    """Random folds over dev, within classes for a classification target. With ``repeats``, fold r*k + i of repeat r."""
    if isinstance(s, Split) and s.time:
        raise ConfigError("a temporal split needs cv_temporal")
    target = target or (s.target if isinstance(s, Split) else None)
    ids = ([id_cols] if isinstance(id_cols, str) else list(id_cols)) if id_cols is not None else s.id_cols
    df = _dev(s)
    if folds < 2:
        raise ConfigError("folds must be at least 2")
    grouped = stratify and target is not None and detect_task(df, target) == "classification"
    out = None
    for r in range(repeats):
        one = hash_index(df, ids, seed + r, [target] if grouped else None)
        number = (F.col("__rn") - 1) % folds if grouped else _ntile(F.col("__rn"), F.col("__n"), folds)
        one = one.withColumn(FOLD, (number + r * folds).cast("int")).drop("__rn", "__n")
        out = one if out is None else out.unionByName(one)
    return Folds(out, folds, target) if repeats == 1 else RepeatedFolds(out, folds, target, repeats)


@dataclass
class RepeatedFolds(Folds):
    repeats: int = 1

    def __len__(self):
        return self.k * self.repeats

    def __iter__(self):
        return (self.fold(i) for i in range(len(self)))

    def fold(self, i: int) -> tuple[DataFrame, DataFrame]:
        first = i // self.k * self.k
        own = self.data.where(F.col(FOLD).between(first, first + self.k - 1))
        return own.where(F.col(FOLD) != i).drop(FOLD), own.where(F.col(FOLD) == i).drop(FOLD)


def _ntile(rn, n, k: int):
    """Fold of row number ``rn``: the first n % k folds are one larger (as ntile)."""
    small, large = F.floor(n / k), n % k
    head = large * (small + 1)
    return F.when(rn <= head, F.floor((rn - 1) / (small + 1))).otherwise(large + F.floor((rn - 1 - head) / F.greatest(small, F.lit(1))))


def cv_temporal(df: DataFrame, *, time: str, id_cols, folds: int = 5, embargo: int = 0, window: str = "expanding", window_size: int | None = None, groups: str | None = None) -> DataFrame:
    """Rows of every temporal fold: the table's columns, ``__fold`` and ``__role`` (train or valid).

    Fold i trains on rows before (i+1) * size (all, or the last ``window_size``) and validates on the size rows
    after the embargo; the last one runs to the end. Rows in an embargo belong to neither side, and folds without a validation
    row drop out. With ``groups``, train rows go whose group is in the fold's validation rows.
    """
    if window not in ("expanding", "sliding") or (window == "sliding" and not window_size):
        raise ConfigError("window is expanding, or sliding with a window_size")
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    indexed = time_index(df, time, ids)
    i, row, n = F.col(FOLD), F.col("__rn") - 1, F.col("__n")
    size = F.floor(n / (folds + 1))
    end = (i + 1) * size
    start = F.greatest(F.lit(0), end - window_size) if window == "sliding" else F.lit(0)
    stop = F.when(i == folds - 1, n).otherwise((i + 2) * size)
    every = indexed.withColumn(FOLD, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when((row >= start) & (row < end), "train").when((row >= end + embargo) & (row < stop), "valid")
    out = every.withColumn(ROLE, role).where(F.col(ROLE).isNotNull())
    if embargo:
        out = out.where(end + embargo < stop)
    out = out.drop("__rn", "__n")
    if groups:
        held = out.where(F.col(ROLE) == "valid").select(F.col(FOLD).alias("__f"), F.col(groups).alias("__g"), F.lit("train").alias("__r")).distinct()
        out = out.join(held, (out[FOLD] == held["__f"]) & (out[groups] == held["__g"]) & (out[ROLE] == held["__r"]), "left_anti")
    return out


def cv_group(s, *, groups: str, folds: int = 5, seed: int = 42, target: str | None = None, stratify: bool = False) -> Folds:
    """Folds by whole groups: in hash order, round robin; with ``stratify``, greedily by class shares."""
    df = _dev(s)
    if stratify:
        if target is None:
            raise ConfigError("stratify needs a target")
        placed = _stratified_groups(df, groups, target, folds, seed)
    else:
        placed = group_order(df, groups, seed).select("__g", ((F.col("__rn") - 1) % folds).cast("int").alias(FOLD))
    return Folds(df.join(placed, df[groups] == placed["__g"]).drop("__g"), folds, target)


def _stratified_groups(df: DataFrame, groups: str, target: str, folds: int, seed: int) -> DataFrame:
    """Each group, largest first, to the fold whose class shares then lie closest to the table's.

    The greedy order is serial, so the (group, class) counts come to the driver; their number is checked.
    """
    counts = df.groupBy(F.col(groups).alias("__g"), F.col(target).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.withColumn("h", hash_key(["__g"], seed)).limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise DataError("too many groups to stratify greedily; use stratify=False")
    classes = sorted({r["y"] for r in rows}, key=str)
    table: dict = {}
    for r in rows:
        table.setdefault((r["h"], r["__g"]), dict.fromkeys(classes, 0))[r["y"]] = r["n"]
    total = {c: sum(t[c] for t in table.values()) for c in classes}
    load = [dict.fromkeys(classes, 0) for _ in range(folds)]
    placed = []
    for (_, g), own in sorted(table.items(), key=lambda x: (-sum(x[1].values()), x[0][0])):
        def cost(k, own=own):
            return sum(abs((load[f][c] + (own[c] if f == k else 0)) / max(1, total[c]) - 1 / folds) for f in range(folds) for c in classes)

        best = min(range(folds), key=lambda k: (cost(k), k))
        for c in classes:
            load[best][c] += own[c]
        placed.append((g, best))
    kind = df.schema[groups].dataType.simpleString()
    return df.sparkSession.createDataFrame(placed, f"__g {kind}, {FOLD} int")


def pcg_shuffle(n: int, seed: int) -> list[int]:
    """Fisher-Yates over PCG-XSH-RR 64/32, for small n on the driver, where a fixed permutation is wanted."""
    mask = (1 << 64) - 1
    state, step = 0, 1442695040888963407 | 1

    def draw() -> int:
        nonlocal state
        old = state
        state = (old * 6364136223846793005 + step) & mask
        x = ((old >> 18) ^ old) >> 27 & 0xFFFFFFFF
        r = old >> 59
        return (x >> r | x << (-r & 31)) & 0xFFFFFFFF

    draw()
    state = (state + seed) & mask
    draw()
    out = list(range(n))
    for i in range(n - 1, 0, -1):
        bound = i + 1
        least = (-bound & 0xFFFFFFFF) % bound
        while (x := draw()) < least:
            pass
        j = x % bound
        out[i], out[j] = out[j], out[i]
    return out


def check_parts(s: Split) -> list[str]:
    """Warnings about parts: empty ones raise; fewer than 30 rows, or a class with fewer than 2 rows a part, warn."""
    rows = s.sizes().collect()
    sizes = {r[ROLE]: r["n"] for r in rows}
    if not {"train", "test"} <= set(sizes):
        raise DataError("a part is empty")
    found = [f"{role} has {n} rows only" for role, n in sizes.items() if n < 30]
    if s.target and s.task == "classification":
        every = Window.partitionBy(ROLE)
        few = s.sizes(s.target).withColumn("c", F.count(F.lit(1)).over(every)).where("n < 2").collect()
        found += [f"class {r[s.target]!r} has {r['n']} row in {r[ROLE]}" for r in few]
    return found
