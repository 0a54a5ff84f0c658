import math
import zlib
from collections import Counter

import numpy as np

from weft.llm.language_id import fit_profile, grams, identify, mixture, predict, train


def profile():
    counts = {}
    for lang, words in {"aa": ["bana", "kala", "mata"], "bb": ["throng", "strict", "shrift"]}.items():
        for w in words:
            for g in grams(w):
                counts[lang, g] = counts.get((lang, g), 0) + 20
    return fit_profile(counts)


def test_mixture_finds_proportions():
    rng = np.random.default_rng(1)
    side = rng.random(4000) < 0.7
    logs = np.where(side[:, None], np.array([0.0, -6.0]), np.array([-6.0, 0.0]))
    likelihood, share = mixture(logs, np.ones(4000))
    assert abs(share[0] - side.mean()) < 0.02
    grid = [(np.log(np.exp(logs) @ np.array([a, 1 - a])).sum(), a) for a in np.linspace(0.01, 0.99, 99)]
    assert likelihood >= max(grid)[0] - 1e-2


def test_predict():
    p = profile()
    assert predict("bana kala mata bana", p)[0] == "aa"
    lang, score, langs, shares = predict("bana kala mata " * 30 + "throng strict shrift " * 20, p)
    assert lang == "aa" and langs == ["aa", "bb"] and abs(shares[0] - 0.6) < 0.05 and 0 <= score <= 1
    for text in (None, "", "123 _ !!", " \n"):
        assert predict(text, p) == ("und", 0.0, [], [])
    assert predict("bana", None)[0] == "und"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs, train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    out = rows[rows.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bana kala", "aa", 1), (3, None, "aa", 1), (4, "strict throng", None, 2), (4, "strict throng", None, 2), (None, "x", "bb", 3)], "doc_id long, text string, lang string, score int")
    assert identify(docs, train(docs)).count() == 5
    empty = docs.limit(0)
    assert train(empty) is None and identify(empty, None).count() == 0
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}


def test_repeated_ids_and_signs(spark):
    """One row stands for an id in training; number signs are no letters; a very long text is read whole."""
    rows = [(1, None, "aa", 1), (1, "bana kala mata", "aa", 1), (1, "bana kala mata", "aa", 1), (1, "throng", "bb", 1), (2, "strict throng shrift", "bb", 2), (None, "kala", "bb", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    p = train(docs)
    want = Counter((lang, g) for lang, words in (("aa", "bana kala mata"), ("bb", "strict throng shrift")) for w in words.split() for g in grams(w))
    held = {i for i in (1, 2) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert not held and sorted(p.index) == sorted({g for _, g in want})
    assert np.allclose(p.rows, fit_profile(want).rows)
    for text in ("\u00b2 \u00bd", "\u2167 7 \u0667", "_"):
        assert predict(text, p) == ("und", 0.0, [], [])
    assert predict("throng strict " * 200_000 + "bana", p)[0] == "bb"


def brute(text, counts):
    """Languages and shares in plain arithmetic: every n-gram of every word looked up, expectation-maximisation word by word."""
    langs = sorted({lang for lang, _ in counts})
    size = len({g for _, g in counts}) + 1
    below = {lang: sum(n for (m, _), n in counts.items() if m == lang) + 0.5 * size for lang in langs}
    words, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words[word] += 1
            word = ""
    if not words:
        return "und", []
    logs = {w: {m: sum(math.log((counts.get((m, g), 0) + 0.5) / below[m]) for g in grams(w)) for m in langs} for w in words}
    total = sum(words.values())

    def fit(chosen):
        share = {m: 1 / len(chosen) for m in chosen}
        for _ in range(15):
            new = dict.fromkeys(chosen, 0.0)
            for w, n in words.items():
                top = max(logs[w].values())
                joint = {m: math.exp(logs[w][m] - top) * share[m] for m in chosen}
                for m in chosen:
                    new[m] += n * joint[m] / sum(joint.values()) / total
            change, share = max(abs(new[m] - share[m]) for m in chosen), new
            if change < 1e-4:
                break
        return sum(n * (math.log(sum(math.exp(logs[w][m] - max(logs[w].values())) * share[m] for m in chosen)) + max(logs[w].values())) for w, n in words.items()), share

    chosen = [max(langs, key=lambda m: (sum(n * logs[w][m] for w, n in words.items()), -langs.index(m)))]
    best, share = fit(chosen)
    while len(chosen) < len(langs):
        mix = {w: math.log(sum(math.exp(logs[w][m] - max(logs[w].values())) * share[m] for m in chosen)) + max(logs[w].values()) for w in words}
        gain = {m: sum(n * max(0, logs[w][m] - mix[w]) for w, n in words.items()) for m in langs if m not in chosen and sum(n * math.exp(min(50, logs[w][m] - mix[w])) for w, n in words.items()) > total}
        if not gain or max(gain.values()) <= 0.5 * math.log(max(2, total)):
            break
        found, new = fit([*chosen, m := max(gain, key=gain.get)])
        if found - best <= 0.5 * math.log(max(2, total)):
            break
        chosen, best, share = [*chosen, m], found, new
    return max(chosen, key=lambda m: share[m]), sorted(chosen)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    counts = Counter()
    for r in rows:
        if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            for w, n in Counter("".join(c if c.isalpha() else " " for c in r.text.lower()).split(" ")).items():
                counts.update({(r.lang, g): n for g in grams(w) if w} if len(set(grams(w))) == len(grams(w)) else Counter({(r.lang, g): n * k for g, k in Counter(grams(w)).items()}))
    counts = {k: n for k, n in counts.items()}
    texts = sorted((r.text for r in rows if r.text), key=len)[:60] + [f"{a.text[:300]} {b.text[:300]}" for a, b in zip(rows[:20], rows[60:80], strict=True)]
    p = train(docs)
    got = [predict(t, p) for t in texts]
    assert [(lang, sorted(langs)) for lang, _, langs, _ in got] == [brute(t, counts) for t in texts]
    assert sum(len(langs) > 1 for _, _, langs, _ in got) >= 5
