"""Exact row numbers and running sums without a single-task window.

A window over a whole table sorts it in one task. Here rows first fall into buckets that follow the order; bucket totals (one
row a bucket) are summed up, and only the window inside a bucket sees rows. The result is that of the global window. Buckets of values
are bounded by quantiles, so each holds about as many rows as any other.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of the hash that make a bucket: 16^3 buckets.
PREFIX = 3
BUCKETS = 4096
#: Rows of a bucket, while there are no more than ``BUCKETS`` of them.
BUCKET_ROWS = 1 << 16
#: Approximate quantiles are off by one row in so many, at most.
ACCURACY = 20_000
#: Values that one task, or the driver, may hold.
FEW_VALUES = 1 << 17


def hash_key(id_cols: list[str], seed: int) -> Column:
    """A deterministic shuffling key of a row: md5 of its id and the seed. Its order is the same in any engine."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))).cast("binary"))


def ordered_index(df: DataFrame, part: list[str], bucket: Column, order: list[Column], rn: str = "__rn", n: str = "__n") -> DataFrame:
    """``df`` with the 1-based row number ``rn`` in each group of ``part`` by ``order``, and the group's size ``n``.

    ``bucket`` must not decrease along ``order``.
    """
    keyed = df.withColumn("__b", bucket)
    totals = keyed.groupBy(*part, "__b").agg(F.count(F.lit(1)).alias("__m"))
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    below = F.sum("__m").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*[F.col(c).alias(f"__p_{c}") for c in part], F.col("__b").alias("__pb"), F.coalesce(below, F.lit(0)).alias("__below"), F.sum("__m").over(whole).alias(n))
    match = F.col("__b").eqNullSafe(F.col("__pb"))
    for c in part:
        match = match & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    inside = F.row_number().over(Window.partitionBy(*part, "__b").orderBy(*order))
    out = keyed.withColumn("__k", inside).join(offsets, match)
    return out.withColumn(rn, F.col("__k") + F.col("__below")).drop("__b", "__pb", "__k", "__below", *[f"__p_{c}" for c in part])


def hash_index(df: DataFrame, id_cols: list[str], seed: int, part: list[str] | None = None, rn: str = "__rn", n: str = "__n") -> DataFrame:
    """Row numbers in hash order, within each group of ``part``."""
    keyed = df.withColumn("__h", hash_key(id_cols, seed))
    return ordered_index(keyed, part or [], F.substring("__h", 1, PREFIX), [F.col("__h"), *map(F.col, id_cols)], rn, n).drop("__h")


def constants(values: list) -> Column:
    """An array of numbers as one expression (a call for each of them would take the driver seconds)."""
    return F.expr(f"array({', '.join(f'{v}L' if isinstance(v, int) else f"double('{v!r}')" for v in values)})")


def searchsorted(bounds: list, value: Column) -> Column:
    """How many of the sorted ``bounds`` a value reaches, by a coarse and a fine look (about twice the square root of their number)."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    coarse = constants([p[0] for p in parts])
    fine = F.array(*[constants(p) for p in parts])
    block = F.size(F.filter(coarse, lambda b: b <= value))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(block, F.lit(1))), lambda b: b <= value))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inside)


def _quantiles(df: DataFrame, key: Column) -> list:
    """Sorted quantiles of a key, one for about ``BUCKET_ROWS`` rows and ``BUCKETS`` at most, repeated where one value holds several of them.

    One mergeable aggregate.
    """
    n, found = df.agg(F.count(key), F.percentile_approx(key, constants([k / BUCKETS for k in range(1, BUCKETS)]), F.lit(ACCURACY))).first()
    return (found or [])[:: max(1, BUCKETS * BUCKET_ROWS // max(1, n))] if n > BUCKET_ROWS else []


def value_bucket(df: DataFrame, key: Column, step, ids: list[str] | None = None) -> Column:
    """A bucket that doesn't decrease along ``key``, then the first of ``ids``; no bucket holds many more rows than others.

    Bounds are quantiles, so outliers and busy stretches don't matter. ``step`` gives the value next above one: values that several quantiles share
    are buckets of their own, whose rows are told apart by the quantiles of their ids if those are numbers. (Bounds come from a job of their own and
    are constants of the plan, so every use of a bucket agrees.)
    """
    found = _quantiles(df, key)
    hot = sorted(v for v, n in Counter(found).items() if n > 1)
    bounds = sorted({*found, *(step(v) for v in hot)})
    bucket = searchsorted(bounds, key).cast("long") * BUCKETS
    if hot and ids and isinstance(df.schema[ids[0]].dataType, T.NumericType):
        among = df.where(key.isin(hot))
        sub = searchsorted(sorted(set(_quantiles(among, F.col(ids[0])))), F.col(ids[0]))
        bucket = bucket + F.when(key.isin(hot), sub).otherwise(0)
    return F.when(key.isNull(), F.lit(-1).cast("long")).otherwise(bucket)


def _above(v: float) -> float:
    return math.nextafter(v, math.inf)


def time_index(df: DataFrame, time: str, id_cols: list[str], rn: str = "__rn", n: str = "__n") -> DataFrame:
    """Row numbers by time, ties by id; nulls first."""
    bucket = value_bucket(df, F.unix_micros(F.col(time).cast("timestamp")), lambda v: v + 1, id_cols)
    return ordered_index(df, [], bucket, [F.col(time).asc_nulls_first(), *map(F.col, id_cols)], rn, n)


def value_index(df: DataFrame, value: str, id_cols: list[str], rn: str = "__rn", n: str = "__n") -> DataFrame:
    """Row numbers by a numeric column, ties by id; nulls first."""
    bucket = value_bucket(df, F.col(value).cast("double"), _above, id_cols)
    return ordered_index(df, [], bucket, [F.col(value).asc_nulls_first(), *map(F.col, id_cols)], rn, n)


def running_sums(df: DataFrame, value: str, sums: list[str], part: list[str] | None = None) -> DataFrame:
    """For a table with one row a ``value`` (in each group of ``part``): inclusive running sums of ``sums`` by it, as ``cum_<name>``."""
    part = part or []
    keyed = df.withColumn("__b", value_bucket(df, F.col(value).cast("double"), _above))
    totals = keyed.groupBy(*part, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy(*(part or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "__b", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums])
    inside = Window.partitionBy(*part, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.join(offsets, [*part, "__b"])
    return out.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"__o_{c}")).alias(f"cum_{c}") for c in sums])


def percentiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact percentiles (interpolated between neighbours) of several columns; None for a column without a value.

    A rank is closed in on: approximate quantiles around it (one mergeable aggregate for all columns) bound an interval, exact counts
    below and inside (one more) say where in it the rank lies, and once it is small its values are counted one by one. So no
    task ever holds a column, and each round cuts the rows of an interval by a factor of thousands.
    """
    wanted = {c: list(p) for c, p in wanted.items() if p}
    if not wanted:
        return {}
    typed = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(wanted)])
    counts = typed.agg(*[F.count(f"v{i}") for i in range(len(wanted))]).first()
    if max(counts) <= FEW_VALUES:
        # So few values that one task may hold them all.
        row = typed.agg(*[F.expr(f"percentile(v{i}, array({', '.join(map(repr, p))}))") for i, p in enumerate(wanted.values())]).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(p) for i, (c, p) in enumerate(wanted.items())}
    # Each percentile asked for: column, share, interval (None: open), rows below it and inside.
    asks = [[i, q, None, None, 0, counts[i]] for i, p in enumerate(wanted.values()) for q in p]
    within = lambda a: F.col(f"v{a[0]}").isNotNull() if a[2] is None else F.col(f"v{a[0]}").between(F.lit(a[2]), F.lit(a[3]))
    for _ in range(8):
        wide = [a for a in asks if a[5] > FEW_VALUES and (a[2] is None or a[2] < a[3])]
        if not wide:
            break
        made = []
        for a in wide:
            at = (a[1] * (counts[a[0]] - 1) - a[4]) / max(1, a[5] - 1)
            ends = F.array(F.lit(max(0.0, at - 3 / ACCURACY)), F.lit(min(1.0, at + 3 / ACCURACY)))
            made.append(F.percentile_approx(F.when(within(a), F.col(f"v{a[0]}")), ends, F.lit(ACCURACY)))
        ends = typed.agg(*[m.alias(f"m{k}") for k, m in enumerate(made)]).first()
        sizes = typed.agg(*[F.count_if(x).alias(f"n{k}{j}") for k, a in enumerate(wide) for j, x in enumerate((F.col(f"v{a[0]}") < F.lit(ends[k][0]), F.col(f"v{a[0]}").between(F.lit(ends[k][0]), F.lit(ends[k][1]))))]).first()
        for k, a in enumerate(wide):
            position, below, inside = a[1] * (counts[a[0]] - 1), sizes[2 * k], sizes[2 * k + 1]
            if below <= math.floor(position) and math.ceil(position) < below + inside:
                a[2:] = [ends[k][0], ends[k][1], below, inside]
    held: dict[int, list] = {}
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{a[0]}").alias("v"), within(a).alias("ok")) for k, a in enumerate(asks)])
    some = typed.select(F.explode(F.filter(cells, lambda x: x["ok"] & x["v"].isNotNull())).alias("x")).groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
    for r in some.collect():
        held.setdefault(r["k"], []).append((r["v"], r["n"]))
    found: dict[int, list] = {}
    for k, a in enumerate(asks):
        found.setdefault(a[0], []).append(_interpolated(sorted(held.get(k, [])), a[1] * (counts[a[0]] - 1), a[4]))
    return {c: found[i] for i, c in enumerate(wanted)}


def _interpolated(values: list[tuple[float, int]], position: float, below: int) -> float | None:
    if not values:
        return None

    def at(rank: int) -> float:
        seen = below
        for v, n in values:
            seen += n
            if rank < seen:
                return v
        return values[-1][0]

    low, high = math.floor(position), math.ceil(position)
    if low == high or at(low) == at(high):
        return at(low)
    return (high - position) * at(low) + (position - low) * at(high)
