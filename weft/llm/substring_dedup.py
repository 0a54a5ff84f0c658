"""Repeated passages across (and within) documents: hash normalised sentences of lines, keep the earliest occurrence, cut the rest.

A text is cut into segments: at every line break, and after ``.``, ``!`` or ``?`` where white space follows. A unit ends with
each segment of at least ``UNIT_WORDS`` words ``[^\\x20\\x09-\\x0D]+``, so shorter segments belong to the unit of the next longer
one (at the end of a text, they are a unit of their own). Where a unit ends depends on one segment only, so units fall into
step again right after a passage begins, wherever in a line it stands. Units follow each other without gaps and cover the text.

A unit is normalised by turning white space into single spaces and lower-casing A-Z, and hashed to 128 bits. Occurrences are
ranked by doc_id, then by offset. The first is original, all others are repeats. A run of consecutive repeats goes if it has
at least ``MIN_WORDS`` words in all, remembered as one span with its original offsets (in code points) and the place of the
original of its first unit; shorter runs, such as a phrase that many documents use, stay. So whatever goes still stands
somewhere: a unit goes only if an earlier equal one exists, and the earliest of all stays.

What is shuffled for the decision is a digest and an offset a unit; only the way back moves texts. A digest that a third of all
documents have is aggregated before the shuffle, and its rows are spread over several tasks on the way back.

A null text, and a text without a word, stay as they are. Null doc_ids rank last. Rows that repeat a doc_id are separate documents of one rank: the
same place never removes itself, so both copies keep their text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, take_memory, text_batches

#: Words of a segment that ends a unit.
UNIT_WORDS = 8
#: Words of a run of repeats that goes.
MIN_WORDS = 20

BREAK = re.compile(r"\n|(?<=[.!?])[\x20\x09\x0B-\x0D]+")


def units(text: str, unit_words: int = UNIT_WORDS) -> list[tuple[int, int, list[bytes]]]:
    """Start, end and words of each unit of a text."""
    found: list[tuple[int, int, list[bytes]]] = []
    words: list[bytes] = []
    start = at = 0
    for m in BREAK.finditer(text):
        new = text[at : m.start()].encode().split()
        at = m.end()
        words += new
        if len(new) >= unit_words:
            found.append((start, at, words))
            start, words = at, []
    words += text[at:].encode().split()
    if words:
        found.append((start, len(text), words))
    elif found:
        # White space at the end belongs to the last unit.
        found[-1] = (found[-1][0], len(text), found[-1][2])
    return found


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words).lower(), digest_size=16).digest()


def cut_runs(text: str, originals: dict[int, tuple], unit_words: int, min_words: int) -> tuple[str, int, str]:
    """The text without its runs of repeats; how many went, and ``start,end,keep_id,keep_start`` of each, separated by semicolons.

    ``originals``: of each repeat's start, id (as text) and start of its original.
    """
    kept, runs, run, size = [], [], None, 0
    for start, end, words in [*units(text, unit_words), (len(text), len(text), [])]:
        if start in originals and words:
            run, size = (run if size else start), size + len(words)
            continue
        if size >= min_words:
            keep_id, keep_start = originals[run]
            runs.append(f"{run},{start},{'null' if keep_id is None else keep_id},{keep_start}")
        elif size:
            kept.append(text[run:start])
        size = 0
        kept.append(text[start:end])
    return ("".join(kept), len(runs), ";".join(runs)) if runs else (text, 0, "")


def find_units(docs: DataFrame, id_col: str, text_col: str, unit_words: int) -> DataFrame:
    """A row a unit: __id, __key (which tells rows of one id apart), start and digest."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        take_memory("substring_dedup")
        for b in batches:
            rows = [(i, k, s, digest(w)) for i, k, t in zip(b["__id"], b["__key"], b["__text"], strict=True) for s, _, w in units(t, unit_words)]
            yield pd.DataFrame(rows, columns=["__id", "__key", "start", "digest"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("__id"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("__text"))
    # Ids go as text, since pandas would turn a column with nulls into floats.
    found = rows.mapInPandas(run, "__id string, __key long, start int, digest binary")
    return found.withColumn("__id", F.col("__id").cast(kind))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS) -> DataFrame:
    """The units that are repeats, a row a document that has any: __id, __key and repeats (start, keep_id, keep_start)."""
    found = find_units(text_batches(docs), id_col, text_col, unit_words)
    rank = F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("keep_id"), F.col("start").alias("keep_start"))
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first.keep_id", "first.keep_start")
    joined = salted_join(found, first, ["digest"], F.struct("__id", "start"))
    later = joined.where(F.col("keep_start").isNotNull() & ~(F.col("keep_id").eqNullSafe(F.col("__id")) & (F.col("keep_start") == F.col("start"))))
    # A document's repeats are no more than its units.
    return later.groupBy("__id", "__key").agg(F.collect_set(F.struct("start", F.col("keep_id").cast("string").alias("keep_id"), "keep_start")).alias("repeats"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS, removed_col: str = "removed"
) -> DataFrame:
    """``docs`` with the runs of repeats cut from the text, and ``removed_col`` (n, spans; null where nothing went)."""
    found = repeats(docs, id_col, text_col, unit_words).toDF("__i", "__k", "__repeats")
    match = docs[id_col].eqNullSafe(found["__i"]) & (F.xxhash64(docs[text_col]) == found["__k"])

    @F.pandas_udf("text string, n long, spans string")
    def without(texts: pd.Series, starts: pd.Series, ids: pd.Series, at: pd.Series) -> pd.DataFrame:
        take_memory("substring_dedup")
        out = []
        for t, *r in zip(texts, starts, ids, at, strict=True):
            out.append((None, 0, "") if t is None else cut_runs(t, {s: x for s, *x in zip(*r, strict=True)}, unit_words, min_words))
        return pd.DataFrame(out, columns=["text", "n", "spans"])

    # Only texts that have a repeat go through Python.
    asked = F.when(F.col("__repeats").isNotNull(), F.col(text_col))
    joined = docs.join(found, match, "left").withColumn("__cut", without(asked, *[F.col(f"__repeats.{c}") for c in ("start", "keep_id", "keep_start")]))
    cut = F.col("__cut.n") > 0
    columns = [F.when(cut, F.col("__cut.text")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.when(cut, F.struct("__cut.n", "__cut.spans")).alias(removed_col))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``docs``: id, the text that is left, how many runs went (n_removed), and their spans.

    ``removed_spans`` lists ``start,end,keep_id,keep_start``, separated by semicolons.
    """
    out = remove_repeats(docs.select(id_col, text_col), id_col, text_col, unit_words, min_words, "__removed")
    return out.select(id_col, text_col, F.coalesce("__removed.n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__removed.spans", F.lit("")).alias("removed_spans"))


def keep_unique_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeats; a document that lost all its words goes. Columns as before."""
    out = remove_repeats(docs, id_col, text_col, unit_words, min_words, "__removed")
    emptied = F.col("__removed").isNotNull() & ~F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).drop("__removed")
