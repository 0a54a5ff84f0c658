"""Byte-level BPE with overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own; where two neighbours agree on
a boundary inside their overlap, the pattern (which never looks back) matches alike from there on, so the left
chunk's pre-tokens before it and the right chunk's after it are those of the whole text. Pre-tokens are then
encoded piece by piece by rank merges. A text of at most ``chunk_chars`` is one chunk and needs no shuffle; the chunks
of longer ones are spread over tasks and come back together by row, as boundary lists and ids.
If no boundary agrees inside an overlap (one run longer than it), the chunks' texts are joined and matched again.

A null text counts as empty; an empty text has no ids and the digests of no bytes. Rows that repeat are encoded each.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take_memory, text_batches

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Distinct pre-tokens that a worker remembers; the memory starts anew beyond it.
CACHE = 300_000

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encodes pre-tokens through a bounded memory; ids are little-endian unsigned 32-bit integers in ``bytes``."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.spans = regex.compile(pattern).finditer
        self.ranks = load_ranks(path)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.engine = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.memory = _Memory(self.engine._core_bpe.encode_single_piece)

    def encode(self, text: str) -> bytes:
        return array("I", self.engine.encode_ordinary(text)).tobytes()

    def pre_tokens(self, text: str, start: int) -> tuple[list[int], list[int], bytes]:
        """Where each pre-token ends (``start`` added), how many ids each has, and the ids of all in order."""
        self.memory.trim()
        spans = list(self.spans(text))
        pieces = [self.memory[m.group()] for m in spans]
        return [start + m.end() for m in spans], [len(p) // 4 for p in pieces], b"".join(pieces)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))

    def digest(self, ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


class _Memory(dict):
    def __init__(self, merged):
        self.merged = merged

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.merged(piece.encode())).tobytes()
        self[piece] = ids
        return ids

    def trim(self):
        if len(self) > CACHE:
            self.clear()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(path, pattern)


def stitch(chunks: list, coder: Codec) -> bytes:
    """Ids of the whole text from its overlapping chunks ``(start, text, ends, counts, ids)``, in order."""
    out: list[bytes] = []

    def part(ends, counts, ids, low, high):
        """Ids of the pre-tokens that end in (low, high]."""
        at = 0
        got = []
        for e, c in zip(ends, counts, strict=True):
            if low < e <= high:
                got.append(ids[4 * at : 4 * (at + c)])
            at += c
        return b"".join(got)

    start, text, ends, counts, ids = chunks[0]
    low = -1
    for s, t, e, c, i in chunks[1:]:
        limit = start + len(text)
        known = set(map(int, e))
        common = next((x for x in ends if s < x < limit and x > low and x in known), None)
        if common is None:
            sure = max((x for x in ends if low <= x <= s), default=max(low, start))
            out.append(part(ends, counts, ids, low, sure))
            text = text[sure - start :] + t[limit - s :]
            start, low = sure, sure
            ends, counts, ids = coder.pre_tokens(text, start)
            continue
        out.append(part(ends, counts, ids, low, common))
        start, text, ends, counts, ids, low = s, t, e, c, i, common
    out.append(part(ends, counts, ids, low, float("inf")))
    return b"".join(out)


def encode_overlapping(text: str, coder: Codec, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> bytes:
    """Ids of a text by overlapping chunks (the whole path on one machine)."""
    if len(text) <= chunk_chars:
        return coder.encode(text)
    chunks = []
    for start in range(0, max(1, len(text) - overlap), chunk_chars):
        part = text[start : start + chunk_chars + overlap]
        chunks.append((start, part, *coder.pre_tokens(part, start)))
    return stitch(chunks, coder)


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 (and ids, with ``with_ids``)."""
    schema = RESULT + (", ids binary" if with_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def result(ids: bytes):
        found = codec(vocabulary, pattern).digest(ids)
        return (*found, ids) if with_ids else found

    @F.pandas_udf(schema)
    def whole(texts: pd.Series) -> pd.DataFrame:
        take_memory("byte_bpe", codec.cache_clear)
        coder = codec(vocabulary, pattern)
        return pd.DataFrame([result(coder.encode(t)) for t in texts], columns=names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    # Ids go as text, since pandas would turn a column with nulls into floats.
    rows = text_batches(docs).select(F.col(id_col).cast("string").alias("__id"), text.alias("__text"))
    short = rows.where(F.length("__text") <= chunk_chars).select("__id", whole("__text").alias("r"))

    # Chunks of long texts. The key is the row's identity and content, so rows that repeat come back as one group and are counted.
    keyed = rows.where(F.length("__text") > chunk_chars).withColumn("__key", F.sha2("__text", 256))
    copies = keyed.groupBy("__id", "__key").agg(F.count(F.lit(1)).alias("__copies"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("__text") - overlap - 1), F.lit(chunk_chars))
    chunks = (
        keyed.dropDuplicates(["__id", "__key"])
        .select("__id", "__key", "__text", F.explode(starts).alias("start"))
        .select("__id", "__key", "start", F.substr("__text", F.col("start") + 1, F.lit(chunk_chars + overlap)).alias("chunk"))
        .repartition("__id", "__key", "start")
    )

    def pre_tokenise(batches):
        """Each chunk's boundaries, and the ids of its pre-tokens with their counts, in order."""
        take_memory("byte_bpe", codec.cache_clear)
        coder = codec(vocabulary, pattern)
        for batch in batches:
            # Lists of boundaries are much larger than the chunks, so a few go at a time.
            for at in range(0, len(batch), 64):
                b = batch.iloc[at : at + 64]
                found = [coder.pre_tokens(t, int(s)) for s, t in zip(b["start"], b["chunk"], strict=True)]
                yield b.assign(ends=[f[0] for f in found], counts=[f[1] for f in found], ids=[f[2] for f in found])

    def join_chunks(group: pd.DataFrame) -> pd.DataFrame:
        take_memory("byte_bpe", codec.cache_clear)
        coder = codec(vocabulary, pattern)
        g = group.sort_values("start")
        ids = stitch(list(zip(g["start"].astype(int), g["chunk"], g["ends"], g["counts"], g["ids"], strict=True)), coder)
        return pd.DataFrame([(g["__id"].iloc[0], g["__key"].iloc[0], *result(ids))], columns=["__id", "__key", *names])

    long = (
        chunks.mapInPandas(pre_tokenise, "__id string, __key string, start int, chunk string, ends array<int>, counts array<int>, ids binary")
        .groupBy("__id", "__key")
        .applyInPandas(join_chunks, f"__id string, __key string, {schema}")
    )
    counted = copies.select(F.col("__id").alias("__i"), F.col("__key").alias("__k"), "__copies")
    long = (
        long.join(counted, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k")))
        .withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        .select(F.col("__id").cast(kind).alias(id_col), *names)
    )
    return short.select(F.col("__id").cast(kind).alias(id_col), "r.*").unionByName(long)
