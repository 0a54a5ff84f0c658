"""Document statistics, base rules, and gradient-boosted trees over them with monotonic constraints.

The trees are fitted on the driver on a sample of labelled documents that has at most ``SAMPLE_ROWS`` rows (the smallest
hashes of doc_id), flattened to numpy node arrays, and scored for whole batches of documents at once. The features
in ``FALLING`` may only lower a document's score. Every text is read whole.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words and fails the base rules. Without labels (an empty table,
or one class only) there is no model, and a document that passes the base rules is kept. Labels that repeat for a doc_id
count as their majority (ties: the lower). Rows that repeat are judged each; an empty table gives an empty result.

Equal words and equal windows are found by 64-bit hashes of the words; windows with equal hashes are compared word hash by
word hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
THRESHOLD = 0.5

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "words_per_line"]
#: Features whose growth may only lower the score.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share")

_RNG = np.random.default_rng(20240501)
_MULTIPLIERS = _RNG.integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?"


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that is found twice or more, the first included."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += codes[k : k + n] * _MULTIPLIERS[k]
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    at = np.flatnonzero(same)
    a, b = order[at], order[at + 1]
    true = np.ones(len(at), bool)
    for k in range(window):
        true &= codes[a + k] == codes[b + k]
    starts = np.zeros(len(codes) + 1, np.int64)
    hit = np.zeros(n, bool)
    hit[a[true]] = hit[b[true]] = True
    starts[: n] += hit
    starts[window : window + n] -= hit
    return int((np.cumsum(starts)[: len(codes)] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The five counts of the contract, then what else the features need."""
    if not text:
        return (0,) * 11
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    drop = len(raw) - len(raw.translate(None, SPACE))
    return (
        len(words),
        len(text) - drop,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(codes),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _DIGITS)),
        len(raw) - len(raw.translate(None, _MARKS)),
        len(set(words)),
        len(lines),
        len(text),
    )


def features(s: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each row of ``statistics``."""
    words, chars, symbols, dup, repeat, upper, digits, marks, distinct, lines, _ = (s[:, k].astype(float) for k in range(11))
    per_word = np.maximum(words, 1)
    per_char = np.maximum(chars, 1)
    per_line = np.maximum(lines, 1)
    return np.column_stack([np.log1p(words), chars / per_word, symbols / per_word, dup / per_line, repeat / per_word, upper / per_char, digits / per_char, marks / per_word, distinct / per_word, words / per_line])


@dataclass(frozen=True)
class Trees:
    """Trees of one depth as flat node arrays: node ``k`` of a tree goes to ``left[k]`` if its feature is at most its threshold."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, min_rows: int = 20, falling: tuple[int, ...] = ()) -> Trees:
    """Second-order boosting of logistic loss over histogram splits.

    A split on a falling feature is taken only if its right value is no higher than its left; the midpoint of the two
    then bounds all values below on either side, so the whole tree is monotone.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    raw = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(0.0)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        own = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        if level == depth or len(rows) < 2 * min_rows:
            return leaf(own * rate)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2) + (total_g * own + (total_h + ridge) * own**2 / 2)
            ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
            if j in falling:
                ok &= vr <= vl
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            return leaf(own * rate)
        j, k, vl, vr = best[1]
        node = leaf(0.0)
        feature[node], threshold[node] = j, float(edges[j][k])
        middle = (vl + vr) / 2
        side = binned[rows, j] <= k
        bounds = ((middle, high), (low, middle)) if j in falling else ((low, high), (low, high))
        left[node] = grow(rows[side], g, h, level + 1, *bounds[0])
        right[node] = grow(rows[~side], g, h, level + 1, *bounds[1])
        return node

    everyone = np.arange(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        first = len(feature)
        roots.append(grow(everyone, p - y, p * (1 - p), 0, -np.inf, np.inf))
        tree = Trees(0.0, depth, np.array([roots[-1]]), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))
        raw += tree.raw(x)
        if len(feature) == first + 1:
            break
    return Trees(base, depth, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def _stats_frame(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.int64).reshape(len(texts), 11)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, those whose doc_id hashes lowest."""
    # The sample's bound makes it safe to broadcast and to collect.
    one = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg((F.avg(F.col(label_col).cast("double")) > 0.5).cast("double").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(_stats_frame(texts))))

    found = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .join(F.broadcast(one), "__id")
        .select("__id", "__y", measured("__text").alias("x"))
        .dropDuplicates(["__id"])
        .select("__y", "x")
        .toPandas()
    )
    if not len(found):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.array(found["x"].tolist()), found["__y"].to_numpy()


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, **options) -> Trees | None:
    x, y = labelled_sample(docs, labels, id_col, text_col, label_col, rows)
    if len(y) == 0 or y.min() == y.max():
        return None
    order = np.lexsort(x.T[::-1])
    falling = tuple(FEATURES.index(f) for f in FALLING)
    return fit_trees(x[order], y[order], falling=falling, **options)


def judge_quality(docs: DataFrame, model: Trees | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: id, the five counts, base_failed, kept and score."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        s = _stats_frame(texts)
        out = pd.DataFrame(s[:, : len(COUNTS)], columns=COUNTS)
        out["score"] = model.score(features(s)) if model is not None and len(s) else 1.0
        return out

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        docs.select(F.col(id_col), judged(F.col(text_col)).alias("__r"))
        .select(id_col, "__r.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .select(id_col, *COUNTS, "base_failed", "kept", "score")
    )
