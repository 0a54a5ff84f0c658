"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="weft-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    A lost executor then costs a re-read, not a recomputation, and iterative plans stay short.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    # Python objects that are gone still hold plans in the driver until they are collected.
    gc.collect()
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that nothing refers to any more (between rounds of a long job)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch; texts can be long, and a batch is held several times over (in the JVM, as Arrow data, as objects).
TEXT_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands texts to Python in batches of at most ``TEXT_ROWS`` rows from now on."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


_forget: dict[str, Callable[[], None]] = {}


def take_memory(owner: str, forget: Callable[[], None] | None = None) -> None:
    """In a Python worker: ``owner`` works now, and ``forget`` drops what it remembers; all others forget theirs.

    Workers are reused from stage to stage; without this, the memories of all stages would add up. What is freed goes back to the
    system, which the allocators don't do by themselves. ``forget`` must be a function of a module, as anything else
    reaches a worker as a copy.
    """
    others = [k for k in _forget if k != owner]
    for k in others:
        _forget.pop(k)()
    if others or not _forget:
        give_back()
    _forget[owner] = forget or (lambda: None)


def give_back() -> None:
    """Return freed memory to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Another C library, which has no such call.
        pass


def crc32_of(c: Column) -> Column:
    """crc32 of a value's decimal text, as the public CRC-32 of its UTF-8 bytes."""
    return F.crc32(c.cast("string").cast("binary"))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, salts: int = 8) -> DataFrame:
    """Left join in which the rows of a hot key are spread over ``salts`` tasks.

    ``right`` holds at most one narrow row a key, so each of its rows can be given to every salt;
    ``spread`` is any evenly distributed expression over ``left``.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], "left").drop("__salt")


def has_column(df: DataFrame, name: str, kind: type[T.DataType]) -> bool:
    return any(f.name == name and isinstance(f.dataType, kind) for f in df.schema.fields)
