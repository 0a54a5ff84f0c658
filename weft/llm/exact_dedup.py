"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every text becomes a digest entry ``(sha256, bytes, check) -> id, count``. Entries are spread over runs by id (``RUNS``, more of them for
more rows), and equal ones of a run are aggregated before anything moves. At each level, ``FAN_IN`` neighbouring runs meet (three
binomial rounds in one): runs are exchanged by target run and digest range, each task merges what it gets in the order of digests (a sort, which
is a multiway merge of sorted spills), and of equal neighbours one entry stays, which retains the smallest sort key (the identifier
that stays) and the summed count. Entries are verified wherever they meet: byte length and an independent 64-bit hash of equal digests must
agree, or the query fails. A run is cut into ``RANGES`` digest ranges, so not even the last run is one task. The last level holds one
entry a digest. Then the winners go back down: first to the entries of the lowest runs (at most
one a run for any digest), then to the rows of each run. A digest that a third of all rows share is
therefore never gathered in one task: it is an entry a run going up, and a run's rows going down.

A text is equal to another only when it is identical; null counts as the empty text. Repeated rows count each;
of rows that repeat the same id with the same text, all carry the same verdict. A row whose id is null stays only
if no other row with its text has an id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RUNS = 64
FAN_IN = 8
#: Rows of a run; beyond it there are more runs.
RUN_ROWS = 1 << 20
#: Ranges of digests (by their first two bytes) in which runs are exchanged.
RANGES = 4096
DIGEST = ["__sha", "__bytes", "__check"]


def _run(ids: Column, runs: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(ids.cast("string"), F.lit(""))), F.lit(runs)).cast("int")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """A digest entry for each row: the id, its run, sha256 of the UTF-8 text, and the two values that verify it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("__id"),
        _run(F.col(id_col), runs).alias("__run"),
        F.unhex(F.sha2(text, 256)).alias("__sha"),
        F.octet_length(text).cast("long").alias("__bytes"),
        F.xxhash64(text).alias("__check"),
    ).withColumn("__range", (F.conv(F.hex(F.substring("__sha", 1, 2)), 16, 10).cast("int") % RANGES))


def _agree(low: Column, high: Column) -> Column:
    return F.when(low == high, low).otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("long"))


def merge_runs(entries: DataFrame, keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One entry a digest ``(.., __keep, __n)``, merged from runs ``(__run, __range, .., __keep, __n)`` over levels of fewer runs."""
    at = ["__run", "__range", "__sha"]
    best = F.desc_nulls_last("__keep") if keep == "max" else F.asc_nulls_last("__keep")
    ordered, equal = Window.partitionBy(*at).orderBy(best), Window.partitionBy(*at)
    while runs > 1:
        runs = -(-runs // fan_in)
        met = entries.withColumn("__run", F.floor(F.col("__run") / fan_in).cast("int")).repartition("__run", "__range")
        # One sort by run, digest and identifier serves both windows; a window holds at most fan_in entries.
        merged = met.select(
            *at, "__keep", F.row_number().over(ordered).alias("__k"), F.sum("__n").over(equal).alias("__n"),
            *[_agree(F.min(c).over(equal), F.max(c).over(equal)).alias(c) for c in DIGEST[1:]],
        )
        entries = merged.where("__k = 1").drop("__k")
    return entries.drop("__run", "__range")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept and text_sha256."""
    pick = F.max if keep == "max" else F.min
    runs, entries = RUNS, digests(docs, id_col, text_col)
    rows = cut(entries)
    most = rows.count()
    while runs * RUN_ROWS < most:
        runs *= FAN_IN
    if runs > RUNS:
        rows = rows.withColumn("__run", _run(F.col("__id"), runs))
    lowest = rows.groupBy("__run", "__range", "__sha").agg(
        pick("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"), *[_agree(F.min(c), F.max(c)).alias(c) for c in DIGEST[1:]]
    )
    # Only digests that occur twice need a way down.
    winners = merge_runs(lowest, keep, runs).where("__n > 1")
    back = (
        lowest.select("__run", *DIGEST)
        .join(winners.select(*DIGEST, F.col("__keep").alias("__winner"), F.col("__n").alias("__size")), DIGEST)
    )
    joined = rows.join(back, ["__run", *DIGEST], "left")
    grouped = F.col("__size").isNotNull()
    keep_id = F.when(grouped, F.col("__winner")).otherwise(F.col("__id"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, columns unchanged.

    Only the dropped ids and digests are shuffled against the rows: a row goes if its id lost in its group.
    """
    verdict = exact_dedup(docs, id_col, text_col, keep)
    losers = verdict.where(~F.col("kept")).select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__sha")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    match = docs[id_col].eqNullSafe(losers["__id"]) & (F.unhex(F.sha2(text, 256)) == losers["__sha"])
    return docs.join(losers, match, "left_anti")
