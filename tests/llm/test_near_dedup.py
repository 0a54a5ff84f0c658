import random
import re

import numpy as np

from weft.llm import near_dedup
from weft.llm.near_dedup import bands_for, closest, components, drop_near_duplicates, fold, may_link, near_components, odd_sketch, shingle_set, similar


def shingles(text, width):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(data, width, percent):
    sets = [shingles(t, width) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True))]


def corpus(seed=3, families=12, size=14):
    """Families of edited copies whose similarities lie on both sides of the threshold."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    data = []
    for f in range(families):
        base = [word() for _ in range(rnd.choice([30, 120, 500]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // rnd.choice([12, 25, 40])))):
                copy[rnd.randrange(len(copy))] = word()
            base = copy if rnd.random() < 0.3 else base
            data.append(" ".join(copy))
    rnd.shuffle(data)
    data = [(100 + k, t) for k, t in enumerate(data)]
    hot = data[0][1]
    data += [(900 + k, hot.upper() if k % 2 else hot.replace(" ", "\n")) for k in range(40)]
    return data + [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two\tWORDS"), (6, "one"), (7, "x " * 30_000), (8, "x " * 40_000), (9, "two words more"), (None, hot), (None, "quite alone here it is"), (4, "other text of the same id")]


def compare(spark, data, width, percent):
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in data], "doc_id long, text string, kept int, node string")
    rows = near_components(docs, width=width, percent=percent).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows)
    assert got == sorted((str(d), n, str(c)) for d, n, c in brute(data, width, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return docs


def test_equals_brute_force(spark):
    compare(spark, corpus(), 3, 85)


def test_five_words_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    data = corpus(8, 6)
    docs = compare(spark, data, 5, 80)
    left = drop_near_duplicates(docs.where("doc_id is not null and doc_id <> 4"))
    keep = {d for d, _, c in brute([x for x in data if x[0] not in (None, 4)], 5, 80) if d == c}
    assert {r.doc_id for r in left.collect()} == keep and left.columns == docs.columns


def test_empty_and_alone(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert near_components(docs.limit(0)).count() == 0
    assert {r.doc_id: r.component_id for r in near_components(docs).collect()} == {1: 1, 2: 2}


def test_shared_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    compare(spark, data, 3, 85)


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for n in (40, 400, 3000):
        for share in (0.95, 0.86, 0.7):
            errors = []
            for _ in range(20):
                both = round(2 * n * share / (1 + share))
                pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
                a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
                x, y = odd_sketch(a), odd_sketch(b)
                size = min(len(x), len(y))
                ok, est = may_link(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum(), 8 * size, np.array(len(a) + len(b)), 0.85)
                true = both / (2 * n - both)
                errors.append(abs(float(est) - true))
                if true >= 0.85:
                    assert ok
                    assert similar(a, b, 85)
            assert np.mean(errors) < 0.02


def test_band_number_and_components(spark):
    assert (1 - 0.85**5) ** bands_for(0.85) <= 1e-7
    edges = [(k, k + 1) for k in range(20)] + [(50, 51), (52, 51)]
    rows = components(spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")).collect()
    want = {k: 0 for k in range(21)} | {50: 50, 51: 50, 52: 50}
    assert {r.node[0]: r.root[0] for r in rows} == want
    frame = lambda e: spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in e], "a binary, b binary")
    labels = components(frame(edges[::2]))
    rows = components(frame([*edges[1::2], (70, 60), (60, 5)]), labels).collect()
    assert {r.node[0]: r.root[0] for r in rows} == want | {60: 0, 70: 0}


def test_short_sequences():
    assert shingle_set("a b", 3).size == 1 and (shingle_set("A  B", 3) == shingle_set("a b", 3)).all()
    assert closest([], [], 0.8, 1) == []


def test_rows_that_share_an_id(spark):
    """Of rows with one id, or with none, only the one that is a near copy goes."""
    words = lambda name: " ".join(f"{name}{k}" for k in range(60))
    data = [(1, words("a")), (None, f"{words('a')} more"), (None, words("b")), (5, f"{words('a')} end"), (5, words("c")), (7, f"{words('c')} end"), (8, None), (None, None)]
    left = drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted((data[k] for k in (0, 2, 4, 6, 7)), key=str)
