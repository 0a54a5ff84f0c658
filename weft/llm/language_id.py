"""Multilingual mixture inference: which languages a document is written in, and in what proportions.

Training counts character n-grams (of ``N`` signs, with word edges) of labelled documents and smooths them to a
log-probability an n-gram and language. A document is a bag of words; a word's likelihood under a language is that of its
n-grams. Expectation-maximisation estimates the document's mixing proportions over a language set. Sets grow from the best single language by the
one that helps most, as long as the likelihood gained exceeds the penalty of half the log of the number of words for each
further proportion. The prediction is the language with the largest proportion in the chosen set, its score that proportion
times the posterior probability of the single best language among single ones where only one is chosen.

The counts are taken over a sample of at most ``SAMPLE_ROWS`` labelled documents (the smallest hashes of doc_id; of rows that
repeat a doc_id, one: that of the first language, then text hash), each read whole; every n-gram counts. A prediction reads nothing but the text, whole and however long. Null text, or a text
without a letter (``str.isalpha``), gives ``und`` with score 0. Without any labelled document every text is ``und``. Ties go to the language that
sorts first. Rows that repeat are predicted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, take_memory, text_batches

SAMPLE_ROWS = 3_000
N = 3
CACHE_WORDS = 100_000
UNKNOWN = "und"
RESULT = "lang_pred string, score double, langs array<string>, shares array<double>"
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (``str.isalpha``), lower-cased."""
    found = _WORDS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # The class also takes number signs such as superscripts, fractions and Roman numerals.
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split(" ") if w]


def grams(word: str, n: int = N) -> list[str]:
    """Character n-grams of a word with its edges; a shorter word with edges is one gram itself."""
    edged = f" {word} "
    return [edged[i : i + n] for i in range(max(1, len(edged) - n + 1))]


class Profile:
    """Log-probabilities of n-grams by language: row ``index[gram]`` of ``rows``; the last row is for grams never seen."""

    def __init__(self, langs: list[str], index: dict[str, int], rows: np.ndarray):
        self.langs, self.index, self.rows = langs, index, rows
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.logs = np.zeros((1024, len(self.langs)))

    def __getstate__(self):
        return self.langs, self.index, self.rows

    def __setstate__(self, state):
        self.langs, self.index, self.rows = state
        self.clear()

    def words(self, words) -> np.ndarray:
        """Log-likelihoods, words by languages: the sum over a word's n-grams. Words are remembered up to a bound."""
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.clear()
                new = list(words)
            parts = [grams(w) for w in new]
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            get, unseen = self.index.get, len(self.rows) - 1
            at = np.fromiter((get(g, unseen) for p in parts for g in p), np.int64, int(lengths.sum()))
            sums = np.add.reduceat(self.rows[at], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
            n = len(self.known)
            if n + len(new) > len(self.logs):
                grown = np.zeros((2 * (n + len(new)), len(self.langs)))
                grown[:n] = self.logs[:n]
                self.logs = grown
            self.logs[n : n + len(new)] = sums
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return self.logs[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def fit_profile(counts: dict[tuple[str, str], int], smoothing: float = 0.5) -> Profile:
    """``counts``: of (language, n-gram)."""
    langs = sorted({lang for lang, _ in counts})
    column = {lang: i for i, lang in enumerate(langs)}
    index = {g: i for i, g in enumerate(sorted({g for _, g in counts}))}
    table = np.zeros((len(index) + 1, len(langs)))
    for (lang, gram), n in counts.items():
        table[index[gram], column[lang]] += n
    below = table.sum(axis=0) + smoothing * len(table)
    return Profile(langs, index, np.log(table + smoothing) - np.log(below))


def mixture(logs: np.ndarray, weights: np.ndarray, steps: int = 15) -> tuple[float, np.ndarray]:
    """Log-likelihood and proportions by expectation-maximisation; ``logs``: words by languages."""
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(logs - top)
    share = np.full(logs.shape[1], 1 / logs.shape[1])
    total = weights.sum()
    for _ in range(steps):
        joint = p * share
        mass = joint.sum(axis=1)
        new = (weights / mass) @ joint / total
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return float(weights @ (np.log(p @ share) + top[:, 0])), share


def predict(text: str | None, profile: Profile | None) -> tuple[str, float, list[str], list[float]]:
    if not text or profile is None or not profile.langs:
        return UNKNOWN, 0.0, [], []
    bag = Counter(words_of(text))
    if not bag:
        return UNKNOWN, 0.0, [], []
    logs = profile.words(bag)
    weights = np.fromiter(bag.values(), np.float64, len(bag))
    single = weights @ logs
    chosen = [int(np.argmax(single))]
    best, share = float(single[chosen[0]]), np.ones(1)
    top, total = logs.max(axis=1, keepdims=True), weights.sum()
    penalty = 0.5 * np.log(max(2.0, total))
    while len(chosen) < len(profile.langs):
        # A further language can help only through words that it explains better than the mixture does, and only if the
        # likelihood, which is concave in the proportions, rises where its proportion leaves zero.
        now = np.log(np.exp(logs[:, chosen] - top) @ share) + top[:, 0]
        over = {j: logs[:, j] - now for j in range(len(profile.langs)) if j not in chosen}
        gains = [(float(weights @ np.maximum(0, d)), -j) for j, d in over.items() if weights @ np.exp(np.minimum(d, 50)) > total]
        if not gains or max(gains)[0] <= penalty:
            break
        j = max(gains)[1]
        found, new = mixture(logs[:, [*chosen, -j]], weights)
        if found - best <= penalty:
            break
        chosen, best, share = [*chosen, -j], found, new
    order = sorted(range(len(chosen)), key=lambda i: (-share[i], profile.langs[chosen[i]]))
    posterior = np.exp(single - single.max())
    score = float(share[order[0]] * (1 / posterior.sum() if len(chosen) == 1 else 1.0))
    return profile.langs[chosen[order[0]]], min(1.0, score), [profile.langs[chosen[i]] for i in order], [float(share[i]) for i in order]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(crc32_of(id_col), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Profile | None:
    """The profile of at most ``rows`` labelled documents that are not held out.

    The n-gram counts are summed by a shuffle; their number is bounded by the sample and they come to the driver.
    """
    sample = (
        text_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.min(F.struct(F.col(lang_col).cast("string").alias("__lang"), F.xxhash64(text_col).alias("__hash"))).alias("first"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
        .select("__id", "first.*")
    )
    own = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
    # Equal rows count once.
    chosen = own.join(F.broadcast(sample), ["__id", "__lang", "__hash"]).dropDuplicates(["__id"])

    def count(batches):
        for b in batches:
            bags: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b["__lang"], b["__text"], strict=True):
                bags[lang].update(words_of(text))
            found: Counter = Counter()
            for lang, bag in bags.items():
                for w, n in bag.items():
                    for g in grams(w):
                        found[lang, g] += n
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "gram", "n"])

    counts = chosen.select("__lang", "__text").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    return fit_profile({(a, g): n for a, g, n in counts.itertuples(index=False)})


def predicted(profile: Profile | None, text: Column) -> Column:
    """The prediction as a struct column (``RESULT``)."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        take_memory("language_id")
        return pd.DataFrame([predict(t, profile) for t in texts], columns=["lang_pred", "score", "langs", "shares"])

    return run(text)


def identify(docs: DataFrame, profile: Profile | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, lang_pred, score, langs and shares."""
    return text_batches(docs).select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), predicted(profile, F.col(text_col)).alias("__r")).select(id_col, "held_out", "__r.*")
