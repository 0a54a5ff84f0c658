"""Reading and writing: tables in any format Spark reads, bundled generators, a catalogue, frames of other libraries, models."""

from __future__ import annotations

import json
import os
import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..operators.transforms import normalise_nan

VERSION = 1


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV or JSON by name or ending; NaN becomes NULL."""
    base = path.rstrip("/").removesuffix(".gz")
    kind = kind or (base.rsplit(".", 1)[-1] if "." in os.path.basename(base) else "parquet")
    if kind not in ("parquet", "orc", "csv", "json"):
        raise ConfigError(f"unknown format {kind!r}")
    reader = spark.read.options(**({"header": "true"} | options if kind == "csv" else options))
    if kind == "csv" and schema is None:
        reader = reader.option("inferSchema", "true")
    return normalise_nan((reader.schema(schema) if schema else reader).format(kind).load(path))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def to_spark(spark: SparkSession, frame) -> DataFrame:
    """A DataFrame of a Spark, pandas, Arrow or ``to_pandas`` frame."""
    if isinstance(frame, DataFrame):
        return frame
    import pandas as pd
    import pyarrow as pa

    if isinstance(frame, pa.Table):
        frame = frame.to_pandas()
    elif hasattr(frame, "to_pandas"):
        frame = frame.to_pandas()
    if not isinstance(frame, pd.DataFrame):
        raise DataError(f"not a table: {type(frame).__name__}")
    return normalise_nan(spark.createDataFrame(frame.astype(object).where(frame.notna(), None) if frame.size == 0 else frame))


def _uniform(k: int, seed: int):
    return (F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def sales(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Units sold by price, promotion and region."""
    t = spark.range(n).select("id", (5 + 45 * _uniform(1, seed)).alias("price"), (_uniform(2, seed) < 0.3).alias("promo"), F.element_at(F.array(*map(F.lit, ("north", "south", "east", "west"))), (1 + F.floor(4 * _uniform(3, seed))).cast("int")).alias("region"), _uniform(4, seed).alias("u"))
    return t.select("id", "price", "promo", "region", F.round(100 - 1.5 * F.col("price") + 20 * F.col("promo").cast("int") + 20 * (F.col("u") - 0.5)).cast("int").alias("units"))


def reviews(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Short reviews with a sentiment."""
    good, bad = ("great", "lovely", "solid", "quick"), ("poor", "broken", "late", "dull")
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (1 + F.floor(len(words) * _uniform(k, seed))).cast("int"))
    t = spark.range(n).withColumn("positive", _uniform(1, seed) < 0.6)
    return t.select("id", F.concat_ws(" ", F.lit("the service was"), F.when(F.col("positive"), pick(good, 2)).otherwise(pick(bad, 3)), F.lit("and"), F.when(F.col("positive"), pick(good, 4)).otherwise(pick(bad, 5))).alias("text"), "positive")


def survival(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Passengers with class, sex, age (some missing) and survival."""
    t = spark.range(n).select("id", (1 + F.floor(3 * _uniform(1, seed))).cast("int").alias("class"), F.when(_uniform(2, seed) < 0.5, "female").otherwise("male").alias("sex"), F.when(_uniform(3, seed) < 0.85, F.round(1 + 70 * _uniform(4, seed))).alias("age"), _uniform(5, seed).alias("u"))
    chance = 0.2 + 0.5 * (F.col("sex") == "female").cast("int") + 0.1 * (3 - F.col("class"))
    return t.select("id", "class", "sex", "age", (F.col("u") < chance).cast("int").alias("survived"))


DATASETS = {"sales": sales, "reviews": reviews, "survival": survival}


def dataset(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in DATASETS:
        raise ConfigError(f"unknown dataset {name!r}: {', '.join(sorted(DATASETS))}")
    return DATASETS[name](spark, **options)


def datasets(spark: SparkSession) -> DataFrame:
    rows = [(n, {"sales": "regression", "reviews": "classification", "survival": "classification"}[n]) for n in sorted(DATASETS)]
    return spark.createDataFrame(rows, "name string, task string")


def algorithm_catalogue(spark: SparkSession) -> DataFrame:
    from ..operators.models import CLASSIFIERS, REGRESSORS

    return spark.createDataFrame([(n, n in CLASSIFIERS, n in REGRESSORS) for n in sorted({*CLASSIFIERS, *REGRESSORS})], "algorithm string, classification boolean, regression boolean")


def save(obj, path: str) -> None:
    """A model, pipe or transform as a folder: what Spark fitted in its own format, the rest as data of known types."""
    os.makedirs(path, exist_ok=False)
    held: dict[str, object] = {}

    class Pickler(pickle.Pickler):
        def persistent_id(self, x):
            if hasattr(x, "write") and hasattr(x, "uid"):
                key = f"stage-{len(held)}"
                held[key] = x
                return ("ml", key, f"{type(x).__module__}.{type(x).__name__}")
            if isinstance(x, DataFrame):
                key = f"table-{len(held)}"
                held[key] = x
                return ("table", key, "")
            return None

    with open(os.path.join(path, "object"), "wb") as f:
        Pickler(f).dump(obj)
    for key, x in held.items():
        (x.write.parquet if isinstance(x, DataFrame) else x.write().save)(os.path.abspath(os.path.join(path, key)))
    with open(os.path.join(path, "meta.json"), "w", encoding="utf-8") as f:
        json.dump({"version": VERSION, "type": type(obj).__name__}, f)


def load(spark: SparkSession, path: str):
    """What ``save`` wrote. Only types of this library, numpy and plain Python are restored."""
    with open(os.path.join(path, "meta.json"), encoding="utf-8") as f:
        if json.load(f)["version"] != VERSION:
            raise ConfigError("saved by another version")

    class Unpickler(pickle.Unpickler):
        def find_class(self, module, name):
            if module.split(".")[0] in ("weft", "numpy", "collections") or (module, name) in (("builtins", "set"), ("builtins", "frozenset")):
                return super().find_class(module, name)
            raise DataError(f"{module}.{name} may not be loaded")

        def persistent_load(self, pid):
            kind, key, name = pid
            where = os.path.abspath(os.path.join(path, key))
            if kind == "table":
                return spark.read.parquet(where)
            module, _, cls = name.rpartition(".")
            if not module.startswith("pyspark.ml"):
                raise DataError(f"{name} may not be loaded")
            return getattr(__import__(module, fromlist=[cls]), cls).load(where)

    with open(os.path.join(path, "object"), "rb") as f:
        return Unpickler(f).load()
