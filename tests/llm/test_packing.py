import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from weft.llm.packing import Packer, SumOfSquares, WordTokens, pack_documents, powers

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, sizes, window):
    at = defaultdict(list)
    for doc, start, length, _, total, seq, offset, size in rows:
        assert length > 0 and total == sizes[doc]
        at[seq].append((offset, length, size))
    docs = defaultdict(list)
    for doc, start, length, *_ in rows:
        docs[doc].append((start, length))
    for doc, size in sizes.items():
        end = 0
        for start, length in sorted(docs[doc]):
            assert start == end
            end += length
        assert end == size
    padding = 0
    for pieces in at.values():
        end = 0
        for offset, length, size in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window and all(p[2] == end for p in pieces)
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding


def test_packer_places_each_id_once_without_padding():
    rnd = random.Random(5)
    for most_open in (2, 4096):
        sizes = {k: rnd.choice([1, 2, rnd.randint(1, 63), rnd.randint(1, 300)]) for k in range(500)}
        packer, rows = Packer(64, most_open), []
        for k, n in sizes.items():
            rows += packer.add(k, np.arange(n, dtype="<u4").tobytes())
        rows += packer.close()
        assert check(rows, sizes, 64) == 0


def test_level_minimises_sum_of_squares():
    rnd = random.Random(2)
    packer = SumOfSquares(32)
    for _ in range(400):
        before = packer.counts.copy()
        size = rnd.randint(1, 31)

        def total(level, before=before, size=size):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + size < 32:
                c[level + size] += 1
            return int((c**2).sum())

        open_levels = [0, *(h for h in range(1, 33 - size) if before[h])]
        _, level = packer.add(size)
        assert total(level) == min(map(total, open_levels))


def test_powers():
    for n in range(200):
        assert sum(powers(n)) == n and all(p & (p - 1) == 0 for p in powers(n))


def test_word_tokens_equal_the_tokenizer():
    tokens, rnd = WordTokens(PATH), random.Random(1)
    parts = ["a", "é", "É", "\n", " ", "  ", "\t", "日本", "'s", "'", ".", "1", "😀", "\u0301", "\x1c", "\u2028", "The", "ß", "Σ", "ΑΣ", "İ", "ª", "µ", "\xa0", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "!!", "%%%", "thereof", "tion", "strengths"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 16)))
        assert tokens.encode(text) == tokens._full(text), repr(text)
    letters = "etaoinshrdlucmwyg"
    for _ in range(3000):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 14)))
        assert tokens.encode(word) == tokens._full(word), word


def test_pack_documents(spark):
    long = "many words, " * 3000
    data = [(1, "the cat sat"), (2, None), (3, ""), (4, long), (4, long), (None, "x"), (5, "\x1c odd 'tis <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in data], "doc_id long, text string, start string, __x int")
    rows = pack_documents(docs, PATH).collect()
    tokens = WordTokens(PATH)
    want = sorted((str(i), len(tokens._full(t or "")) // 4 + 1) for i, t in data)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == want
    for r in rows:
        text = dict(data)[r.doc_id] or ""
        ids = tokens._full(text) + (1).to_bytes(4, "little")
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    by = defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length
    assert all(v == 2048 or v & (v - 1) == 0 for v in by.values())
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_memories_are_shared():
    from weft.llm import common
    from weft.llm.near_dedup import _words, forget_words
    from weft.llm.packing import word_tokens

    common.take_memory("near_dedup", forget_words)
    _ = _words[b"a"]
    common.take_memory("packing", word_tokens.cache_clear)
    assert not _words and list(common._forget) == ["packing"]
    word_tokens(PATH)
    common.take_memory("packing", word_tokens.cache_clear)
    assert word_tokens.cache_info().currsize == 1
    common.take_memory("near_dedup", forget_words)
    assert word_tokens.cache_info().currsize == 0 and list(common._forget) == ["near_dedup"]


def test_waiting_workers_hold_nothing(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string").repartition(8)
    pack_documents(docs, PATH).collect()

    def held(batches):
        from weft.llm.packing import word_tokens

        for b in batches:
            yield b.assign(n=word_tokens.cache_info().currsize)[["n"]]

    # The same workers go on with these tasks.
    assert {r.n for r in docs.mapInPandas(held, "n long").collect()} == {0}


def test_memory_of_words_is_bounded_within_a_text(monkeypatch):
    from weft.llm import packing

    monkeypatch.setattr(packing, "CACHE_WORDS", 300)
    monkeypatch.setattr(packing, "SLICE_WORDS", 100, raising=False)
    tokens = WordTokens(PATH)
    text = " ".join(f"{'Ab'[i % 2]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{',.! '[i % 4]}" for i in range(3000))
    assert tokens.encode(text) == np.array(tokens.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    # A word and its lower-cased letters for each word of the last slice, at most.
    assert len(tokens) <= 300 + 2 * 100
