"""URL rules backed by a Bloom filter cascade, in DataFrame operations only.

A set of listed keys is encoded against the whole universe of keys that the corpus has. Level 1 is a Bloom
filter of the listed keys. Level 2 encodes the unlisted keys of the universe that level 1 lets through, level 3
the listed keys that level 2 lets through, and so on until a level lets nothing wrong through. A key is
listed exactly if the first level that misses it is even; no join is needed, and for every key of the universe
the answer is exact. The levels are bit sets of at most ``max_bits``, kept as literals in the plan; a list that
needs more than that takes the exact join instead (``listed_by_join``), which gives the same answer at any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: host, path prefix, verdict. The rule whose host and path are longest together wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A host is listed if one of its labels, split at hyphens, is one of these.
LISTED_WORDS = ("bets", "casino", "pills", "poker", "porn", "viagra", "xxx")
MAX_BITS = 1 << 20
WORD = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substr(url, F.locate("://", url) + 3)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, or nulls."""
    text = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``bits`` positions in 64-bit ``words``, ``hashes`` probes, salted by its ``seed``."""

    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        found = F.lit(True)
        array = F.array(*[F.lit(w).cast("long") for w in self.words])
        for k in range(self.hashes):
            at = position(key, self.bits, self.seed, k)
            word = F.element_at(array, (F.floor(at / WORD) + 1).cast("int"))
            found = found & (F.call_function("bit_get", word, (at % WORD).cast("int")) == 1)
        return found


def position(key: Column, bits: int, seed: int, k: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(bits).cast("long"))


def build_level(keys: DataFrame, n: int, rate: float, seed: int, max_bits: int = MAX_BITS) -> Level | None:
    """The filter of ``n`` keys (column ``__key``); None if it would take more than ``max_bits``.

    The bits are set by a distributed aggregation to one row a 64-bit word; what comes to the driver is the
    filter itself, at most ``max_bits / 8`` bytes.
    """
    hashes = max(1, round(-math.log2(rate)))
    bits = max(WORD, -(-math.ceil(n * hashes / math.log(2)) // WORD) * WORD)
    if bits > max_bits:
        return None
    at = F.explode(F.array(*[position(F.col("__key"), bits, seed, k) for k in range(hashes)])).alias("at")
    rows = (
        keys.select(at)
        .groupBy(F.floor(F.col("at") / WORD).cast("int").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast(at % {WORD} as int)))").alias("value"))
        .collect()
    )
    words = [0] * (bits // WORD)
    for r in rows:
        words[r["word"]] = r["value"]
    return Level(bits, hashes, seed, tuple(words))


def build_cascade(universe: DataFrame, rate: float = 0.01, inner_rate: float = 0.5, max_bits: int = MAX_BITS) -> list[Level] | None:
    """Levels for ``universe`` (distinct ``__key`` with boolean ``__listed``), or None if a level is too large for a literal."""
    levels: list[Level] = []
    alive = cut(universe)
    counts = {bool(r["__listed"]): r["n"] for r in alive.groupBy("__listed").agg(F.count(F.lit(1)).alias("n")).collect()}
    side, n = True, counts.get(True, 0)
    while n:
        level = build_level(alive.where(F.col("__listed") == side), n, inner_rate if levels else rate, len(levels), max_bits)
        if level is None:
            return None
        levels.append(level)
        # Keys of the other side that pass are what the next level encodes; those that don't are settled.
        alive = cut(alive.where((F.col("__listed") == side) | level.holds(F.col("__key"))))
        side = not side
        n = alive.where(F.col("__listed") == side).count()
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether ``key`` is listed: exact for every key of the universe that the levels were built over."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in reversed(range(len(levels))):
        answer = F.when(~levels[depth].holds(key), F.lit(depth % 2 == 1)).otherwise(answer)
    return answer


def listed_host(host: Column, words=LISTED_WORDS) -> Column:
    return F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(w) for w in words]))


def listed_by_join(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """The exact way for a list of any size: ``rows`` (column ``host``) with boolean ``__listed``."""
    hits = universe.where("__listed").select(F.col("__key").alias("host"), F.lit(True).alias("__hit"))
    return rows.join(hits, "host", "left").withColumn("__listed", F.coalesce("__hit", F.lit(False))).drop("__hit")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, words=LISTED_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict and listed.

    ``verdict`` is the fitting rule's, else ``block`` for a listed host and ``allow`` otherwise. A url that is null or
    has no ``://`` has an empty host and path, fits no rule and is allowed. Rows that repeat are judged each; an
    empty table gives an empty result.
    """
    host, path = host_and_path(F.col("__url"))
    parsed = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).select("__id", host.alias("host"), path.alias("path"))
    keys = parsed.select(F.col("host").alias("__key")).distinct()
    universe = keys.withColumn("__listed", listed_host(F.col("__key"), words))
    levels = build_cascade(universe, max_bits=max_bits)
    if levels is None:
        flagged = listed_by_join(parsed, universe)
    else:
        flagged = parsed.withColumn("__listed", member(levels, F.col("host")))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return flagged.select(
        F.col("__id").alias(id_col),
        "host",
        "path",
        text.alias("rule"),
        F.coalesce(verdict, F.when(F.col("__listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("__listed").alias("listed"),
    )
