"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document of at least one window gives whole windows first; what is left is one item. Each item goes into the fill
level ``h`` (0: a new window) that minimises the sum over levels of the squared number of partly filled windows at
that level, which the array of levels tracks: an item of size s changes the sum by
``(N[h+s] + 1)^2 - N[h+s]^2`` (unless that fills the window) plus ``(N[h] - 1)^2 - N[h]^2`` (if h > 0). Each task packs its own
rows in one pass with a memory of one window's worth of levels, so no row is moved; at its end the windows still partly
filled are closed up: their pieces are poured, cut where needed, into full windows, and the rest into windows
whose lengths are powers of two, which need no padding. Every id lies in exactly one piece.

Tokens come from the BPE with word ends that is given by path (``WordTokens``).
A null text counts as empty and, like an empty one, gives the single id ``end_id``. Rows that repeat are packed each. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, take_memory, text_batches

WINDOW = 2048
END_ID = 1
CACHE_WORDS = 400_000
#: Words of a text that are encoded before the memory of words is looked at again.
SLICE_WORDS = 10_000
#: Windows that a task may keep open; beyond it, they are poured into full ones.
MOST_OPEN = 4096
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class _Listed(dict):
    def __init__(self, judge):
        self.judge = judge

    def __missing__(self, token: int) -> bool:
        self[token] = found = self.judge(token)
        return found


class WordTokens(dict):
    """Word -> ids (little-endian unsigned 32-bit, in ``bytes``), equal to the tokenizer's without special tokens added.

    No step of the tokenizer looks across white space, so a text is the sequence of its words. A plain word (Latin
    letters, then signs) is one or two pre-tokens, which go to an engine that looks pairs up by what they join to, where
    the tokenizer looks them up by their two parts. Both take the same steps whenever every id of the result is one that
    the engine reaches on its own by listed pairs only (``_listed``): within such an id nothing else was ever joined. Any
    other word goes to the tokenizer itself. The memory of words is bounded and starts anew beyond it.
    """

    LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
    SIGNS = ".,!%&*$#|"
    #: White space to ``str.split`` but not to the tokenizer.
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(odd)}

        def raw(token: str) -> bytes:
            """The bytes of a token; the zero byte marks the end of a word."""
            end = token.endswith("</w>")
            return bytes(byte_of[c] for c in token[: len(token) - 4 * end]) + b"\0" * end

        vocab = {t: i for t, i in model["vocab"].items() if all(c in byte_of for c in t.removesuffix("</w>"))}
        special = {t["content"] for t in self.tokenizer_tokens(path)}
        self.ranks = {raw(t): i for t, i in vocab.items() if t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.pairs = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.engine = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        # The engine's order must be the order of the merges.
        order = [self.ranks[a + b] for a, b in self.pairs]
        self.ordered = all(x < y for x, y in zip(order, order[1:], strict=False))
        self.merged = self.engine._core_bpe.encode_single_piece
        self.listed = _Listed(self._listed)
        self.signs: dict[str, bytes] = {}

    @staticmethod
    def tokenizer_tokens(path: str) -> list[dict]:
        with open(path, encoding="utf-8") as f:
            return json.load(f)["added_tokens"]

    def _listed(self, token: int) -> bool:
        text = self.bytes_of[token]
        parts = [text[i : i + 1] for i in range(len(text))]
        if parts[-1] == b"\0" and len(parts) > 1:
            parts[-2:] = [parts[-2] + b"\0"]
        while len(parts) > 1:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks]
            if not ranked:
                return False
            i = min(ranked)[1]
            if (parts[i], parts[i + 1]) not in self.pairs:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str, known: dict[str, bytes]) -> bytes:
        """Ids of one pre-token, lower-cased."""
        ids = known.get(piece)
        if ids is None:
            found = self.merged(piece.encode() + b"\0")
            if self.ordered and all(map(self.listed.__getitem__, found)):
                ids = array("I", found).tobytes()
            else:
                ids = self._full(piece)
            known[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(self.SIGNS)
        if self.LETTERS.fullmatch(stem):
            # Lower-cased letters are a word too, so both are remembered in one place.
            low = stem.lower()
            ids = self._piece(word if low == word else low, self)
            if len(stem) < len(word):
                ids += self._piece(word[len(stem) :], self.signs)
        else:
            ids = self._full(word)
        self[word] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        self.signs.clear()

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self._full(text)
        words, out = text.split(), []
        for at in range(0, len(words), SLICE_WORDS):
            if len(self) + len(self.signs) > CACHE_WORDS:
                self.clear()
            out.append(b"".join(map(self.__getitem__, words[at : at + SLICE_WORDS])))
        return b"".join(out)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


class SumOfSquares:
    """Open windows by fill level. ``add`` returns the window an item goes to and its offset there."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def add(self, size: int) -> tuple[int, int]:
        top = self.window - size
        # Cost of going from level h to h + size, for h = 0 .. top; filling a window up costs nothing.
        cost = 2 * self.counts[size:] + 1
        cost[top] = 0
        cost[1:] += 1 - 2 * self.counts[1 : top + 1]
        cost[1:][self.counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        # Of equal costs the fullest level wins, so windows close early.
        level = top - int(np.argmin(cost[::-1]))
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window = self.made
            self.made += 1
        if level + size < self.window:
            self.open[level + size].append(window)
            self.counts[level + size] += 1
        return window, level


def powers(n: int) -> list[int]:
    """Powers of two that sum to n, largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


class Packer:
    """Packs documents' ids one after another; ``add`` and ``close`` yield the pieces of windows that are complete.

    A piece is ``(doc, start, length, ids_crc32, doc_tokens, window number, offset, window length)``.
    """

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.levels = SumOfSquares(window)
        #: Of each open window, the pieces in order: (doc, start, ids, doc_tokens).
        self.held: dict[int, list] = {}

    def _rows(self, number: int, pieces: list, size: int):
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, number, at, size
            at += len(ids) // 4

    def add(self, doc, ids: bytes):
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            part = ids[4 * start : 4 * (start + self.window)]
            yield from self._rows(self.levels.made, [(doc, start, part, total)], self.window)
            self.levels.made += 1
            start += self.window
        if start < total:
            number, level = self.levels.add(total - start)
            self.held.setdefault(number, []).append((doc, start, ids[4 * start :], total))
            if level + total - start == self.window:
                yield from self._rows(number, self.held.pop(number), self.window)
        if len(self.held) > self.most_open:
            yield from self._pour(last=False)

    def close(self):
        yield from self._pour(last=True)

    def _pour(self, last: bool):
        """Pour the open windows' pieces, cut where needed, into full windows; the rest stays open, or goes into powers of two."""
        loose = [p for pieces in self.held.values() for p in pieces]
        left = sum(len(p[2]) // 4 for p in loose)
        made, self.held = self.levels.made, {}
        sizes = [self.window] * (left // self.window) + (powers(left % self.window) if last else [left % self.window] * (left % self.window > 0))
        pieces: list = []
        room = iter(sizes)
        size = free = next(room, 0)
        for doc, start, ids, total in loose:
            while ids:
                take = min(len(ids) // 4, free)
                pieces.append((doc, start, ids[: 4 * take], total))
                start, ids, free = start + take, ids[4 * take :], free - take
                if not free:
                    if last or size == self.window:
                        yield from self._rows(made, pieces, size)
                        pieces = []
                        made += 1
                    size = free = next(room, 0)
        self.levels = SumOfSquares(self.window)
        self.levels.made = made
        if pieces:
            number, _ = self.levels.add(sum(len(p[2]) // 4 for p in pieces))
            self.held[number] = pieces


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and sequence_length.

    ``sequence_id`` is the task's number times 2^40 plus the window's number there.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")
    columns = ["__id", *(c.split()[0] for c in SCHEMA.split(", "))]

    def frame(rows: list) -> pd.DataFrame:
        base = TaskContext.get().partitionId() << 40
        return pd.DataFrame([(*r[:5], base + r[5], *r[6:]) for r in rows], columns=columns)

    def run(batches):
        take_memory("packing", word_tokens.cache_clear)
        tokens, packer = word_tokens(tokenizer), Packer(window)
        try:
            for b in batches:
                yield frame([r for doc, text in zip(b["__id"], b["__text"], strict=True) for r in packer.add(doc, tokens.encode(text) + end)])
            yield frame(list(packer.close()))
        finally:
            # An executor may keep more workers than it runs tasks, and gives them tasks in turn: one that waits holds nothing.
            del tokens, packer
            word_tokens.cache_clear()
            give_back()

    # Ids go as text, since pandas would turn a column with nulls into floats.
    rows = text_batches(docs).select(F.col(id_col).cast("string").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.mapInPandas(run, f"__id string, {SCHEMA}").select(F.col("__id").cast(kind).alias(id_col), *columns[1:])
