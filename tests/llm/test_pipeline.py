from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_substring_dedup import brute as repeats
from weft.llm.language_id import predict, train


def test_stages_equal_brute_force(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in source.collect()]
    odd = [(90_001, None, "en", "s", 0), (90_002, "", None, "s", 0), (90_003, "123 !!", "en", "s", 6), (90_004, rows[0].text, "en", "s", 1)]
    docs = source.union(spark.createDataFrame(odd, source.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    data = {r.doc_id: r.text for r in docs.collect()}
    profile = train(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == source.columns and [f.dataType for f in out.schema] == [f.dataType for f in source.schema]
        return out

    docs = step("language_id", docs)
    want = {d: t for d, t in data.items() if t and any(map(str.isalpha, t)) and predict(t, profile)[0] != "und"}
    assert {r.doc_id: r.text for r in docs.collect()} == want
    docs = step("exact_dedup", docs)
    last = {t: d for d, t in sorted(want.items())}
    want = {d: t for t, d in last.items()}
    assert {r.doc_id: r.text for r in docs.collect()} == want
    docs = step("near_dedup", docs)
    kept = {d for d, _, c in near(sorted(want.items()), 5, 80) if d == c}
    want = {d: t for d, t in want.items() if d in kept}
    assert {r.doc_id: r.text for r in docs.collect()} == want
    docs = step("substring_dedup", docs)
    want = {int(d): t for d, t, n, _ in repeats(sorted(want.items())) if not (n and not t.strip())}
    assert {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = step("packing", docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for r in pieces:
        lengths[r.doc_id] += r.length
    assert lengths == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter({d: sum(r.length for r in whole if r.doc_id == d) for d in lengths}) == lengths
