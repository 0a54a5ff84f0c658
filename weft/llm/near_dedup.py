"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

1. Every document becomes the set of 64-bit hashes of its distinct word shingles. Documents with the same set are one node
   (keyed by a 128-bit hash of the sorted set). A node has MinHash values in bands of ``ROWS``, enough bands that a
   pair at the threshold misses all of them with a probability below 1e-7, and an odd sketch: a parity bitmap into which
   its hashed shingles are folded. The sample that is folded is the whole set rather than a fixed number of minima, as that
   makes the estimate nearly exact: the population count of two sketches' XOR gives the size of the symmetric
   difference. Sketches of larger sets are longer, and fold down to the shorter one's length.
2. A star of candidates for each band value: every node against the smallest one there, by an aggregation and a join on narrow
   rows. The sketches drop pairs that are five standard deviations below the threshold. Of a node's stars the closest is
   confirmed on the full sets, and confirmed links give first components.
3. What is left are band values whose nodes lie in several components. Their nodes (split by size class, since sets that differ by
   more than the threshold in size can't be linked, and into blocks if there are many) are compared by sketch, and each node's closest
   partners in other components are confirmed: a few at first, then more in each round. This repeats with the components merged, without
   the pairs that were refused, until no pair is left. So no link between two components is lost, all pairs of a group are never emitted, and a group of
   copies that a third of all documents belong to is settled by its star.

A document without text or words has an empty set and is linked with nothing. Of documents that repeat a doc_id, each is judged by
its own text. A null doc_id takes part and never gives a component its name unless no member has an id (null then).
Components are merged by tables of labels written to the shared folder; no links, labels or sketches come to the driver.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, salted_join, take_memory, text_batches

ROWS = 5
MISS = 1e-7
#: Words whose hashes a worker remembers.
CACHE_WORDS = 150_000
#: Nodes of one band value and size class that are compared at once.
BLOCK = 1024
#: Pairs whose estimate lies more than so many standard deviations below the threshold aren't confirmed.
SIGMAS = 5
#: Up to so many nodes of a round go to every task, so the documents needn't be shuffled; more of them are joined.
FEW_NODES = 1 << 17
#: Center copies for streams of confirmations.
SALTS = 8

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def forget_words() -> None:
    _words.clear()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of fewer words, the whole sequence is one."""
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    take = min(width, len(codes))
    n = len(codes) - take + 1
    # The number of words is mixed in, so a short sequence is no shingle of another document.
    found = np.full(n, take, np.uint64)
    for k in range(take):
        found = mix(found * _M1 + codes[k : k + n])
    return np.unique(found)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


@lru_cache(maxsize=4)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def min_hashes(found: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of each of ``n`` permutations of the (already random) hashes."""
    a, b = _multipliers(n)
    h = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        part = (h[at : at + 2048][None, :] ^ b[:, None]) * a[:, None]
        np.minimum(low, (part ^ (part >> np.uint32(15))).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key a band, with the band's number mixed in."""
    parts = low.reshape(-1, rows).astype(np.uint64)
    keys = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        keys = mix(keys * _M1 + parts[:, k])
    return keys.view(np.int64)


def sketch_bits(n: int) -> int:
    """Sketch length for a set of n: the power of two that is at least four times that, 2048 at least."""
    return max(2048, 1 << (4 * n - 1).bit_length())


def odd_sketch(found: np.ndarray) -> bytes:
    bits = sketch_bits(len(found))
    counts = np.bincount((mix(found ^ _M1) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: bytes, size: int) -> np.ndarray:
    """The sketch as 64-bit words, folded by XOR to ``size`` bytes."""
    words = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, size // 8), axis=0)


def differences(counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated size of the symmetric difference from XOR population counts, and its standard deviation."""
    share = np.minimum(2 * counts / bits, 1 - 1 / bits)
    size = -bits / 2 * np.log1p(-share)
    spread = np.exp(2 * size / bits) * np.sqrt(np.maximum(bits / 4 * -np.expm1(-4 * size / bits) - size * np.exp(-4 * size / bits), 0.25))
    return size, spread


def may_link(counts: np.ndarray, bits: int, total: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs whose set sizes sum to ``total`` may reach the threshold, and their estimated similarity."""
    size, spread = differences(counts, bits)
    most = (1 - threshold) / (1 + threshold) * total
    return size - SIGMAS * spread <= most, np.clip((total - size) / (total + size), 0, 1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def set_key(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


# Distributed


def _nodes(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """A row a document: __id, __hash (of the text), __n, __node (null: an empty set), __bands, __sketch."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        take_memory("near_dedup", forget_words)
        for b in batches:
            out = []
            for i, h, t in zip(b["__id"], b["__hash"], b["__text"], strict=True):
                s = shingle_set(t, width)
                if len(s):
                    out.append((i, h, len(s), set_key(s), band_keys(min_hashes(s, bands * rows), rows), odd_sketch(s)))
                else:
                    out.append((i, h, 0, None, None, None))
            yield pd.DataFrame(out, columns=["__id", "__hash", "__n", "__node", "__bands", "__sketch"])

    # Ids go as text, since pandas would turn a column with nulls into floats.
    texts = docs.select(F.col(id_col).cast("string").alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
    found = texts.mapInPandas(run, "__id string, __hash long, __n long, __node binary, __bands array<long>, __sketch binary")
    return found.withColumn("__id", F.col("__id").cast(kind))


def _by_sketch(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that their sketches let through, with ``est``."""

    def judge(batches):
        for b in batches:
            keep, est = np.zeros(len(b), bool), np.zeros(len(b))
            for k, (x, y, n, m) in enumerate(zip(b["sa"], b["sb"], b["na"], b["nb"], strict=True)):
                size = min(len(x), len(y))
                count = np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()
                keep[k], est[k] = may_link(np.array(count), 8 * size, np.array(n + m), threshold)
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "est": est})[keep]

    side = nodes.select("__node", "__n", "__sketch")
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    both = both.where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-6)
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInPandas(judge, "a binary, b binary, est double")


def _confirm(pairs: DataFrame, heads: DataFrame, docs: DataFrame, width: int, percent: int, few: bool = False) -> DataFrame:
    """``pairs`` (a, b) with boolean ``linked``, on full sets. ``heads``: node, id, hash; ``docs``: __id, __hash, text.

    The texts of a center's partners stream past it: each task holds one center's set at a time, and a center with
    many partners is copied to several tasks.
    """
    keyed = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    centers = keyed.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("part"), F.col("a").alias("node"))
    roles = centers.unionByName(keyed.select("a", "salt", F.lit(1).alias("part"), F.col("b").alias("node")))
    # Only the nodes in question go against the texts, so just theirs move on.
    asked = heads.join(roles.select("node").distinct(), "node", "left_semi").select("node", "id", "hash")
    asked = F.broadcast(asked) if few else asked
    texts = asked.join(docs, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))).select("node", "text")
    stream = roles.join(texts, "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "part")

    def run(batches):
        take_memory("near_dedup", forget_words)
        held = None
        for batch in batches:
            out = []
            for a, part, b, text in zip(batch["a"], batch["part"], batch["node"], batch["text"], strict=True):
                s = shingle_set(text, width)
                if set_key(s) != b:
                    raise ValueError("a node's text has another set")
                if part == 0:
                    held = (a, s)
                elif held is None or held[0] != a:
                    raise ValueError("a pair without its center")
                else:
                    out.append((a, b, similar(held[1], s, percent)))
            yield pd.DataFrame(out, columns=["a", "b", "linked"])

    return stream.select("a", "part", "node", "text").mapInPandas(run, "a binary, b binary, linked boolean")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Smallest node reachable over ``edges`` (a, b), for every node that has one: node, root.

    ``labels`` of earlier edges shorten the work: the new edges then link their roots. Each round, every node takes the
    smallest label among its neighbours' and its own, then twice its label's label. Rounds end when no
    label changes; their number grows with the logarithm of a component's depth on such star-like links.
    """
    if labels is not None:
        root = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c)).alias(c)
        linked = edges.join(labels.toDF("a", "a_root"), "a", "left").join(labels.toDF("b", "b_root"), "b", "left")
        above = components(linked.select(root("a"), root("b")).where("a != b")).toDF("root", "top")
        moved = labels.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        # Nodes that only the new edges have, and roots that now lie below another.
        new = above.select(F.col("root").alias("node"), F.col("top").alias("root")).join(labels, "node", "left_anti")
        return cut(moved.unionByName(new))
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    found = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))

    def jump(t: DataFrame) -> DataFrame:
        up = t.select(F.col("node").alias("new"), F.col("new").alias("up"))
        return t.join(up, "new", "left").select("node", "root", F.least("new", "up").alias("new"))

    while True:
        near = both.join(found.toDF("b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        new = found.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        new = cut(jump(jump(new)))
        found = new.select("node", F.col("new").alias("root"))
        if new.where("new != root").isEmpty():
            return found


def _left(shared: DataFrame, labels: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Where nodes of several components still meet: key, class, k, node, comp, n.

    A node goes to its size class and the next, so nodes whose sizes allow a link meet. Of places that hold the same nodes,
    one is kept. ``k`` is the number of blocks that a place needs.
    """
    step = -math.log(threshold)
    size = F.floor(F.log("n") / step + 1e-9)
    named = shared.select("key", "node").join(labels, "node", "left").join(sizes, "node")
    named = named.select("key", "node", F.coalesce("root", "node").alias("comp"), "n", F.explode(F.array(size, size + 1)).alias("class"))
    places = (
        named.groupBy("key", "class")
        .agg(
            F.count(F.lit(1)).alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"),
            F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        .where("low != high")
    )
    kept = places.groupBy("m", "x", "y").agg(F.min(F.struct("key", "class")).alias("p")).select("p.key", "p.class", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"))
    return named.join(kept, ["key", "class"])


def _blocks(left: DataFrame, sketches: DataFrame, refused: DataFrame, threshold: float, most: int) -> DataFrame:
    """For each node, its ``most`` closest partners of other components that may be linked and weren't refused: a, b.

    Nodes meet in blocks: with ``k`` blocks in a place, a node goes to each pair of blocks that its own takes part in.
    """
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    placed = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    placed = placed.select("key", "class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n")
    against = refused.select("a", "b").union(refused.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("no"))
    placed = placed.join(sketches, "node").join(against, "node", "left")

    def run(batches):
        """Blocks lie one after another; one is held at a time, as plain lists."""
        held: tuple | None = None
        rows: list[tuple] = []

        def pairs():
            i, j = held[2:]
            one = [r for r in rows if r[0] == i]
            return closest(one, one if i == j else [r for r in rows if r[0] == j], threshold, most)

        for batch in batches:
            out: list[tuple] = []
            for key, size, i, j, *row in batch.itertuples(index=False, name=None):
                if (key, size, i, j) != held:
                    if rows:
                        out += pairs()
                    held, rows = (key, size, i, j), []
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=["a", "b"])
        if rows:
            yield pd.DataFrame(pairs(), columns=["a", "b"])

    at = ["key", "class", "i", "j"]
    blocks = placed.repartition(*at).sortWithinPartitions(*at).select(*at, "own", "node", "comp", "n", "sketch", "no")
    return blocks.mapInPandas(run, "a binary, b binary").distinct()


def closest(one: list[tuple], two: list[tuple], threshold: float, most: int) -> list[tuple[bytes, bytes]]:
    """Pairs (smaller first) of each node of ``one`` with its ``most`` closest possible partners in ``two``.

    A node is ``(block, node, component, n, sketch, refused partners or None)``.
    """
    if not one or not two:
        return []
    nodes, comps, sketches = ([r[k] for r in two] for k in (1, 2, 4))
    sizes = np.array([r[3] for r in two])
    ids = {c: k for k, c in enumerate(dict.fromkeys([*comps, *(r[2] for r in one)]))}
    codes = np.array([ids[c] for c in comps])
    lengths = np.array([len(s) for s in sketches])
    kinds = sorted(set(lengths.tolist()))
    places = {length: np.flatnonzero(lengths == length) for length in kinds}
    folded: dict[tuple[int, int], np.ndarray] = {}
    found = set()
    for _, a, comp, n, sketch, no in one:
        no = set(no) if no is not None else ()
        hits: list[tuple[float, bytes]] = []
        for length in kinds:
            here = places[length]
            # Sets of another component whose size allows a link.
            here = here[(codes[here] != ids[comp]) & (np.minimum(sizes[here], n) >= threshold * np.maximum(sizes[here], n) - 1e-6)]
            if not len(here):
                continue
            size = min(length, len(sketch))
            if (length, size) not in folded:
                table = np.zeros((len(two), size // 8), np.uint64)
                for k in places[length]:
                    table[k] = fold(sketches[k], size)
                folded[length, size] = table
            counts = np.bitwise_count(folded[length, size][here] ^ fold(sketch, size)).sum(axis=1)
            ok, est = may_link(counts, 8 * size, sizes[here] + n, threshold)
            hits += [(e, nodes[k]) for k, e in zip(here[ok].tolist(), est[ok].tolist(), strict=True) if nodes[k] not in no]
        for _, b in sorted(hits, reverse=True)[:most]:
            found.add((a, b) if a < b else (b, a))
    return list(found)


def _judged(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, rows: int) -> DataFrame:
    """One row for each row of ``docs``: __id, __hash (of the text), __n, component_id and kept."""
    threshold = percent / 100
    full = cut(_nodes(text_batches(docs), id_col, text_col, width, bands_for(threshold, rows), rows))
    everyone = full.select("__id", "__hash", "__n", "__node")
    some = full.where("__node is not null")
    # The row that stands for a node: of the smallest id.
    stands = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__hash").alias("hash")))
    heads = cut(some.groupBy("__node").agg(stands.alias("head"), F.count(F.lit(1)).alias("copies")).select(F.col("__node").alias("node"), "head.id", "head.hash", "copies"))
    nodes = cut(some.select("__node", "__n", "__bands", "__sketch").dropDuplicates(["__node"]))
    keys = nodes.select(F.explode("__bands").alias("key"), F.col("__node").alias("node"))
    centers = keys.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "center")
    # Only band values that several nodes have; a value may be a third of all nodes', so its rows are spread.
    shared = cut(salted_join(keys, centers, ["key"], F.col("node"), 4).where("center is not null"))
    own = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("text"))

    star = shared.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    pairs = _by_sketch(star, nodes, threshold).groupBy("b").agg(F.max(F.struct("est", "a")).alias("x")).select("x.a", "b")
    sizes = nodes.select(F.col("__node").alias("node"), F.col("__n").alias("n"))
    sketches = nodes.select(F.col("__node").alias("node"), F.col("__sketch").alias("sketch"))
    most, refused, labels, few = 4, None, None, False
    while True:
        judged = cut(_confirm(pairs, heads, own, width, percent, few))
        no = judged.where("not linked")
        refused = no if refused is None else refused.union(no)
        labels = components(judged.where("linked"), labels)
        left = _left(shared, labels, sizes, threshold)
        pairs = cut(_blocks(left, sketches, refused, threshold, most))
        release(docs.sparkSession)
        left_over = pairs.count()
        if not left_over:
            break
        few = 2 * left_over <= FEW_NODES
        # Where the closest partners were refused, further ones follow in growing numbers.
        most *= 16
    roots = labels.join(heads, "node").groupBy("root").agg(F.min("id").alias("component"))
    named = labels.join(roots, "root").select("node", "component")
    of_node = (
        heads.join(named.withColumn("linked", F.lit(True)), "node", "left")
        .where("copies > 1 or linked")
        .select(F.col("node").alias("__node"), F.when(F.col("linked"), F.col("component")).otherwise(F.col("id")).alias("__component"), F.lit(True).alias("__hit"))
    )
    out = salted_join(everyone, of_node, ["__node"], F.struct("__id", "__hash"))
    component = F.when(F.col("__hit"), F.col("__component")).otherwise(F.col("__id"))
    return out.select("__id", "__hash", "__n", component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id and kept."""
    verdict = _judged(docs, id_col, text_col, width, percent, rows)
    return verdict.select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns unchanged.

    A row goes if its id and text aren't those of the document that names its component; a repeated row of one that stays, stays.
    """
    verdict = _judged(docs, id_col, text_col, width, percent, ROWS)
    losers = verdict.where(~F.col("kept")).select(F.col("__id").alias("__i"), F.col("__hash").alias("__h")).distinct()
    return docs.join(losers, docs[id_col].eqNullSafe(losers["__i"]) & (F.xxhash64(docs[text_col]) == losers["__h"]), "left_anti")
