"""Reading level of documents by gradient-boosted regression trees.

Features describe distributions of length (words in sentences, letters in words), vocabulary (share of long and of
new words, of word pieces), syntax (clauses, connectives, commas and brackets in a sentence) and cohesion (words that
neighbouring sentences share). Trees are fitted to the mean of each document's ratings; predictions made out of fold,
with whole sources held out, give the cut points from grade to level and the model's cross-validated error.

``max_labelled`` bounds the labelled documents a model is fitted on (the first by hash of the key); everything is
scored. Ratings: repeated rows count once, null and impossible levels are ignored, several raters are averaged after
the median, so one stray rating moves little.

Defined results: only documents in ``languages``, by their own function words whatever ``lang`` says, and of at least
``min_chars`` characters get a row; null texts get none; repeated rows give one row; without any rating every document
gets the middle level.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.llm.sentences import table_of
from mentionloom.session import cut

LANGUAGES = ("en", "de", "fr", "es")
MAX_LABELLED = 20_000
# Words that join clauses or subordinate one to another.
CONNECTIVES = {
    "en": "although though while whereas because since unless until whether which who whom whose that if as inasmuch insofar notwithstanding despite even but and so then or",
    "de": "obwohl wenngleich während wohingegen weil da sofern falls ob dass damit nachdem bevor indem infolgedessen beziehungsweise trotz ungeachtet aber denn und doch oder",
    "fr": "bien quoique alors tandis parce puisque sauf jusque si que qui dont où lorsque quand afin mesure malgré nonobstant car mais et puis ou",
    "es": "aunque mientras porque pues salvo hasta si que quien cuyo cuando donde aun bien medida pese obstante pero y luego o",
}
_JOIN = {k: frozenset(v.split()) for k, v in CONNECTIVES.items()}
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»“)]*\s+(?=[^\Wa-zß-öø-ÿ]|[\"„“«¿¡(—])|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")
NAMES = (
    "language", "log_words", "sentence_mean", "sentence_median", "sentence_p90", "sentence_std", "word_mean", "word_std", "word_p90",
    "share_7", "share_9", "share_11", "share_13", "share_short", "distinct", "distinct_long", "commas", "brackets", "joins", "join_kinds",
    "sentence_long_words", "sentence_letters", "sentence_short_share", "sentence_long_share", "overlap", "overlap_next", "caps", "digits", "quotes", "syllables",
)
_VOWELS = re.compile("[aeiouyäöüáéíóúàèìòùâêîôûœæ]+", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")


def features(text: str, lang: str) -> list[float]:
    """The numbers in ``NAMES`` for one text."""
    parts = [w for w in map(_WORD.findall, _SENTENCE.split(text)) if len(w) > 1]
    if not parts:
        parts = [_WORD.findall(text) or ["a"]]
    words = [w for p in parts for w in p]
    n, k = len(words), len(parts)
    lengths = list(map(len, words))
    sent = sorted(map(len, parts))
    mean_sent = n / k
    # words by length; all shares and moments come from this histogram
    h = np.bincount(lengths, minlength=16)
    c, scale = h.cumsum(), np.arange(len(h))
    mean_word = float((h * scale).sum()) / n
    low = list(map(str.lower, words))
    distinct = set(low)
    join = _JOIN[lang]
    found = [w for w in low if w in join]
    longs = n - int(c[8])
    sets = [{w for w in p if len(w) > 3} for p in parts]
    shared = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(sets, sets[1:])]
    return [
        float(LANGUAGES.index(lang)), math.log1p(n), mean_sent, float(sent[k // 2]), float(sent[int(0.9 * (k - 1))]),
        math.sqrt(sum((x - mean_sent) ** 2 for x in sent) / k), mean_word, math.sqrt(max(0.0, float((h * scale**2).sum()) / n - mean_word**2)),
        float(np.searchsorted(c, 0.9 * n)), *((n - int(c[x - 1])) / n for x in (7, 9, 11, 13)), int(c[4]) / n,
        len(distinct) / n**0.7, sum(len(w) >= 9 for w in distinct) / max(1, len(distinct)),
        text.count(",") / k, (text.count("(") + text.count("—")) / k, len(found) / k, len(set(found)) / max(1.0, math.log1p(n)),
        longs / k, float((h * scale).sum()) / k, sum(x <= 8 for x in sent) / k, sum(x >= 20 for x in sent) / k,
        sum(x > 0 for x in shared) / max(1, len(shared)), sum(shared) / max(1, len(shared)),
        sum(map(str.istitle, words)) / n, len(_DIGITS.findall(text)) / k, sum(map(text.count, "“”«»„\"")) / k, len(_VOWELS.findall(text)) / n,
    ]


@dataclass
class Trees:
    """Gradient-boosted regression trees on histograms: squared loss, rows and columns subsampled by a fixed seed."""

    n_trees: int = 300
    depth: int = 3
    rate: float = 0.05
    min_leaf: int = 6
    bins: int = 48
    l2: float = 1.0
    base: float = 3.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Trees:
        rng, (n, m) = np.random.default_rng(seed), x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        b, self.base = self._binned(x), float(y.mean())
        now, nodes = np.full(n, self.base), 2 ** (self.depth + 1) - 1
        for _ in range(self.n_trees):
            rows = rng.random(n) < 0.8
            cols = np.sort(rng.permutation(m)[: max(1, int(m * 0.6))])
            g = y - now
            feature, cut_at, value = np.full(nodes, -1), np.zeros(nodes, np.int32), np.zeros(nodes)
            at = np.zeros(n, np.int32)
            value[0] = g[rows].sum() / (rows.sum() + self.l2)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                live = rows & (at >= first)
                node = at[live] - first
                best = np.full(width, 1e-6)
                for j in cols:
                    size = self.bins + 1
                    key = node * size + b[live, j]
                    s = np.bincount(key, g[live], width * size).reshape(width, size).cumsum(1)
                    c = np.bincount(key, minlength=width * size).reshape(width, size).cumsum(1)
                    ts, tc = s[:, -1:], c[:, -1:]
                    gain = s**2 / (c + self.l2) + (ts - s) ** 2 / (tc - c + self.l2) - ts**2 / (tc + self.l2)
                    gain[(c < self.min_leaf) | (tc - c < self.min_leaf)] = -1
                    where = gain.argmax(1)
                    top = gain[np.arange(width), where]
                    for q in np.flatnonzero(top > best):
                        best[q], i = top[q], where[q]
                        feature[first + q], cut_at[first + q] = j, i
                        value[2 * (first + q) + 1] = s[q, i] / (c[q, i] + self.l2)
                        value[2 * (first + q) + 2] = (ts[q, 0] - s[q, i]) / (tc[q, 0] - c[q, i] + self.l2)
                split = feature[at] >= 0
                split &= at >= first
                go = np.where(split, b[np.arange(n), np.maximum(feature[at], 0)] > cut_at[at], False)
                at = np.where(split, 2 * at + 1 + go, at).astype(np.int32)
            value *= self.rate
            now = now + value[at]
            self.trees.append((feature, cut_at, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), self.base)
        b, out, r = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut_at, value in self.trees:
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (b[r, np.maximum(f, 0)] > cut_at[at]), at).astype(np.int32)
            out += value[at]
        return out


@dataclass
class Model:
    """Trees, the cut points between levels and the cross-validated errors by level."""

    trees: Trees
    cuts: np.ndarray
    error: float

    def levels(self, x: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, self.trees.predict(x), side="right")


def calibrated(grades: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The cut points between levels that put most out-of-fold grades right (misses by more weigh more)."""
    cuts = np.array([1.5, 2.5, 3.5, 4.5])
    if not len(grades):
        return cuts
    loss = lambda c: np.abs(1 + np.searchsorted(c, grades, side="right") - levels).sum() + (1 + np.searchsorted(c, grades, side="right") != levels).sum()
    for _ in range(3):
        for i in range(4):
            lo, hi = (cuts[i - 1] if i else 1.0) + 0.05, (cuts[i + 1] if i < 3 else 5.0) - 0.05
            tries = np.linspace(max(lo, i + 1.1), min(hi, i + 1.9), 33)
            losses = np.array([loss(np.r_[cuts[:i], t, cuts[i + 1 :]]) for t in tries])
            good = tries[losses == losses.min()]
            cuts[i] = good[np.argmin(np.abs(good - (i + 1.5)))]
    return cuts


def fit(x: np.ndarray, y: np.ndarray, groups: np.ndarray, folds: int = 5, seed: int = 7, **params: float) -> Model:
    """A model on all rows, its cut points and error from folds that hold out whole groups."""
    if len(y) < 20:
        return Model(Trees(base=float(y.mean()) if len(y) else 3.0), np.array([1.5, 2.5, 3.5, 4.5]), float("nan"))
    names = np.unique(groups)
    fold_of = dict(zip(names, np.random.default_rng(seed).permutation(len(names)) % folds))
    fold = np.array([fold_of[g] for g in groups])
    out = np.full(len(y), y.mean())
    for k in range(folds):
        held = fold == k
        if held.any() and not held.all():
            out[held] = Trees(**params).fit(x[~held], y[~held], seed).predict(x[held])
    cuts = calibrated(out, np.clip(np.rint(y), 1, 5))
    error = float(np.mean(1 + np.searchsorted(cuts, out, side="right") != np.clip(np.rint(y), 1, 5)))
    return Model(Trees(**params).fit(x, y, seed), cuts, error)


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for k, s, t, g in pdf.itertuples(index=False):
            lang = table_of(t, g)
            if lang in LANGUAGES:
                rows.append((k, s, features(t, lang)))
        yield pd.DataFrame(rows, columns=["id", "source", "x"])


def measure(documents: DataFrame, min_chars: int = 400, key: str = "doc_id") -> DataFrame:
    """(id, source, x): the features of the documents in question, each once."""
    kind = documents.schema[key].dataType.simpleString()
    chosen = documents.where(F.col("text").isNotNull() & (F.coalesce("n_chars", F.length("text")) >= min_chars))
    return chosen.select(F.col(key), F.coalesce("source", F.lit("")), "text", "lang").mapInPandas(_measured, f"id {kind}, source string, x array<float>")


def train(measured: DataFrame, ratings: DataFrame, max_labelled: int = MAX_LABELLED, key: str = "doc_id") -> Model:
    """A model of at most ``max_labelled`` labelled documents."""
    one = ratings.where("level BETWEEN 1 AND 5").select(key, "rater_id", "level").distinct().groupBy(F.col(key).alias("k")).agg(
        ((F.percentile("level", F.lit(0.5)) * 2 + F.avg("level")) / 3).alias("y"))
    rows = measured.join(one, measured["id"] == one["k"]).groupBy("id").agg(F.first("source").alias("source"), F.first("x").alias("x"), F.first("y").alias("y"))
    pdf = rows.orderBy(F.xxhash64("id"), "id").limit(max_labelled).toPandas()
    x = np.array(pdf["x"].tolist(), np.float64).reshape(len(pdf), len(NAMES))
    return fit(x, pdf["y"].to_numpy(np.float64), pdf["source"].to_numpy())


def reading_levels(documents: DataFrame, ratings: DataFrame, min_chars: int = 400, max_labelled: int = MAX_LABELLED, key: str = "doc_id") -> DataFrame:
    """(key, level, grade): the level from 1 to 5 of each document in question."""
    kind = documents.schema[key].dataType.simpleString()
    measured = cut(measure(documents, min_chars, key))
    model = train(measured, ratings, max_labelled, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), np.float64).reshape(len(pdf), len(NAMES))
            grade = model.trees.predict(x)
            yield pd.DataFrame({key: pdf["id"], "level": (1 + np.searchsorted(model.cuts, grade, side="right")).astype(np.int32), "grade": grade})

    return measured.select("id", "x").mapInPandas(run, f"`{key}` {kind}, level int, grade double")
