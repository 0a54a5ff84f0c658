import random
import re

import numpy as np

from weft.llm.quality_rules import FALLING, FEATURES, Trees, fit_model, fit_trees, judge_quality, statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "b", "é", "#", "|", " ", " ", "\n", "\x1c", "\x0b", "\x85", "<"]) for _ in range(rnd.randint(0, 200)))
        assert statistics(text)[:5] == brute(text), repr(text)
    assert statistics(None)[:5] == statistics("")[:5] == (0, 0, 0, 0, 0)


def test_trees_are_monotone_and_flat_arrays_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 2]) + rng.normal(0, 0.2, 3000)) < 0.5).astype(float)
    trees = fit_trees(x, y, rounds=30, falling=(0, 1))
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.8
    for j in (0, 1):
        grid = np.repeat(rng.random((50, 3)), 40, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(trees.raw(grid).reshape(50, 40), axis=1) <= 1e-9).all()

    def walk(t: Trees, row):
        total = t.base
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        return total

    assert np.allclose([walk(trees, r) for r in x[:200]], trees.raw(x[:200]))


def test_judge_quality(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "in"]
    good = [(i, " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(60))) for i in range(150)]
    bad = [(1000 + i, " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) + "###" for _ in range(60))) for i in range(150)]
    odd = [(5000, None), (5001, ""), (5002, "same words in a row here now ok " * 40), (None, good[0][1]), (0, good[0][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in good + bad + odd], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:100]] + [(i, 0) for i, _ in bad[:100]] + [(0, None), (None, 1)], "doc_id long, quality int")
    model = fit_model(docs, labels, min_rows=5)
    assert {FEATURES.index(f) for f in FALLING}
    rows = judge_quality(docs, model).collect()
    assert len(rows) == 305
    verdict = {r.doc_id: r.kept for r in rows}
    assert all(verdict[i] for i, _ in good[100:]) and not any(verdict[i] for i, _ in bad[100:])
    assert not verdict[5000] and not verdict[5001] and not verdict[5002]
    assert fit_model(docs, labels.limit(0)) is None
    assert {r.doc_id: r.kept for r in judge_quality(docs, None).collect()}[1000]
    assert judge_quality(docs.limit(0), model).count() == 0


def test_held_out_labels(spark):
    """On the shared tables: nearly all labelled documents outside the fit are judged as labelled."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = fit_model(docs, labels.where("doc_id % 2 = 0"))
    judged = judge_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    passed = judged[~judged.base_failed]
    assert (passed.kept == (passed.quality == 1)).mean() > 0.97
