import hashlib
import random

import public_tokenizers
import tiktoken

from weft.llm.byte_bpe import Codec, encode_documents, encode_overlapping, load_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def texts(n, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "é", "\n", " ", "  ", "\t", "日本", "'s", "'", ".", "1", "😀", "e\u0301", "\x1c", "\u2028", "the"]
    return ["".join(rnd.choice(parts) * rnd.choice([1, 1, 1, 2, 9, 40]) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_overlapping_chunks_equal_the_whole():
    coder, library = Codec(PATH, PATTERN), reference()
    for t in texts(600):
        want = library.encode_ordinary(t)
        for chunk, overlap in ((16, 4), (7, 3), (50, 20)):
            ids = encode_overlapping(t, coder, chunk, overlap)
            assert list(memoryview(ids).cast("I")) == want, (repr(t), chunk)
            assert coder.decode(ids) == t.encode()


def test_encode_documents(spark):
    library = reference()
    data = [(k, t) for k, t in enumerate(texts(60, 3))] + [(100, None), (101, ""), (7, "again and again " * 30), (7, "again and again " * 30), (None, "no id " * 40)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in data], "doc_id long, text string, n_tokens int, __key string")
    rows = encode_documents(docs, PATH, PATTERN, chunk_chars=50, overlap=16, with_ids=True).collect()
    want = []
    for i, t in data:
        ids = library.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want.append((str(i), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert encode_documents(docs.limit(0), PATH, PATTERN).count() == 0
