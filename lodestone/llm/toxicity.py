"""Toxicity scores: gradient-boosted trees over dense text features with isotonic calibration.

Lexicon. The words that mark toxic texts are learnt, not listed. From the training rows, words (lower case, obfuscation
undone) and their first 4, 5 and 6 letters are counted by class, one per document; a term enters the lexicon if it is at
least LIFT times as frequent in toxic texts and a likelihood-ratio test says so by SIGMA standard deviations. At most
TERMS terms are kept, the most certain ones. Its weight is its smoothed log-odds.

Features of a whole text: densities of lexicon hits (plain, distinct, strong ones, hits that only undoing obfuscation
shows), hits near a second person, capitals, punctuation and obfuscation rates, lengths and repetition. Training rows are
measured with the lexicon of the other half of them, so a text never meets words learnt from itself; new texts are
measured with the lexicon of all. Trees (logistic loss, Newton leaves, quantile bins) and the isotonic map are fitted in
numpy on at most `max_labels` labelled documents, chosen by hash of the id, so the bound holds at any corpus size; the
map is fitted on a third of them that the trees have not seen. Scoring covers every row and depends on the text alone.

Cases: null text counts as empty; rows without an id are scored, never learnt from; a document labelled twice counts
once as its larger label; of several rows of a labelled id the least text counts; without labels of both kinds the score
is the base rate (0.5 with none at all).
"""
from __future__ import annotations

import re
from collections import Counter
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, plus, spare

MAX_LABELS, THRESHOLD = 20_000, 0.3
TERMS, SIGMA, LIFT, FLUSH = 2_000, 5.0, 4.0, 300_000
#: Pronouns of the second person; they are grammar and say nothing by themselves.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te ti tú usted ustedes toi ton ta vous votre vos".split())
LEET = str.maketrans("013457@$!|", "oieastasii")

NAMES = ["hit_share", "hit_log", "distinct_hits", "strong_share", "most", "weight_log", "near_second", "disguised_hits"]
SHAPES = ["second_share", "obfuscated_share", "capital_rate", "capital_words", "punct_rate", "exclaim_rate", "question_rate", "digit_rate", "symbol_rate", "length_log", "word_length", "distinct_share"]
_EDGE = ".,;:!?\"'()[]{}<>|*#&=+-_/\\~`%$@^"
_INNER = re.compile(r"[.\-_*]")
_OBF = re.compile(r"(?<![^\W_])(?:[^\W\d_]+[@$!|*013457]+[^\W\d_]+|[^\W\d_](?:[.\-_*][^\W\d_]){2,})(?![^\W_])")


def plain(word: str) -> str:
    return word.lower().strip(_EDGE)


def undone(word: str) -> str:
    """The word without obfuscation: look-alikes read as letters, separators inside dropped."""
    return _INNER.sub("", plain(word).translate(LEET))


def terms(word: str) -> list[str]:
    """The word itself and, marked by a hat, its stems."""
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)]


class Tokens(dict):
    """Raw token -> what is known of it without a lexicon; tokens are remembered up to a bound.

    (plain form, is a pronoun of the second person, obfuscated runs, is in capitals)
    """

    def known(self, token: str) -> tuple:
        if token.isalpha():  # nothing to strip or undo
            p = token.lower()
            return p, p in SECOND, 0, token.isupper()
        p = plain(token)
        return p, p in SECOND, len(_OBF.findall(token)), token.isupper()

    def __missing__(self, token: str) -> tuple:
        if len(self) > 200_000:
            self.clear()
        self[token] = out = self.known(token)
        return out


class Lexicon(Tokens):
    """Tokens that also know their weight, and whether only undoing obfuscation shows it."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights, self.stems = weights, {t[1:]: w for t, w in weights.items() if t[0] == "^"}

    def weight(self, word: str) -> float:
        """The largest weight of the word and its stems (see terms)."""
        stem, n = self.stems.get, len(word)
        return max(self.weights.get(word, 0.0), stem(word[:4], 0.0) if n > 4 else 0.0, stem(word[:5], 0.0) if n > 5 else 0.0, stem(word[:6], 0.0) if n > 6 else 0.0)

    def known(self, token: str) -> tuple:
        base = super().known(token)
        seen = self.weight(base[0])
        below = seen if token.isalpha() else self.weight(undone(token))
        return *base, max(seen, below), below > seen


def shape(text: str, raw: list[str], counts: dict[str, int], tokens: Tokens) -> list[float]:
    """What does not depend on any lexicon. counts: how often each token of raw occurs."""
    n = max(1, len(raw))
    each = [(tokens[t], k) for t, k in counts.items()]
    b = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    chars = max(1, len(text))
    capitals = b[65:91].sum()
    letters = max(1, capitals + b[97:123].sum())
    punct = b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()
    return [
        sum([k for t, k in each if t[1]]) / n, sum([k * t[2] for t, k in each if t[2]]) / n, capitals / letters, sum([k for t, k in each if t[3]]) / n, punct / chars, b[33] / chars, b[63] / chars, b[48:58].sum() / chars,
        b[[35, 36, 37, 38, 42, 60, 62, 64, 94, 124]].sum() / chars, np.log1p(len(raw)), chars / n, len({t[0] for t, _ in each}) / n,
    ]


def features(text: str, lexicon: Lexicon) -> list[float]:
    raw = text.split()
    n, counts = max(1, len(raw)), Counter(raw)
    hits = {t: (k, *known[4:]) for (t, k), known in zip(counts.items(), map(lexicon.__getitem__, counts)) if known[4]}
    near = 0
    if hits:
        you = np.array([i for i, w in enumerate(raw) if lexicon[w][1]])
        at = np.array([i for i, w in enumerate(raw) if w in hits])
        if len(you):
            j = np.searchsorted(you, at)
            near = int((np.minimum(abs(at - you[np.maximum(j - 1, 0)]), abs(at - you[np.minimum(j, len(you) - 1)])) <= 5).sum())
    total = sum(k for k, _, _ in hits.values())
    return [
        total / n, log1p(total), float(len({undone(t) for t in hits})), sum(k for k, w, _ in hits.values() if w > 4) / n, max([w for _, w, _ in hits.values()], default=0.0), log1p(sum(k * w for k, w, _ in hits.values())), near / n, float(sum(k for k, _, h in hits.values() if h)),
        *shape(text, raw, counts, lexicon),
    ]


def matrix(texts: list, lexicon: Lexicon) -> np.ndarray:
    return np.array([features(t or "", lexicon) for t in texts], np.float64).reshape(len(texts), len(NAMES) + len(SHAPES))


def _counted(batches):
    """(t, fold, toxic, n): documents per term, flushed at a bounded size; term '' counts the documents themselves."""
    counts: Counter = Counter()

    def flush():
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["t", "fold", "toxic", "n"])
        counts.clear()
        return out

    for b in batches:
        for text, fold, y in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), b.column("toxic").to_pylist()):
            words = set(map(undone, set((text or "").split()))) - {""}
            counts.update((t, fold, y) for t in {t for w in words for t in terms(w)} | {""})
            if len(counts) > FLUSH:
                yield flush()
    yield flush()


def evidence(a, b, n_a, n_b):
    """Likelihood ratio (twice its log) of a term in a of n_a toxic and b of n_b other texts, against one common rate. Columns."""
    part = lambda k, n, rate: F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)
    p = (a + b) / (n_a + n_b)
    return 2 * (part(a, n_a, p) + part(b, n_b, p) + part(n_a - a, n_a, 1 - p) + part(n_b - b, n_b, 1 - p))


def lexicons(rows: DataFrame, stash: Stash) -> dict[int, Lexicon]:
    """From rows (text, toxic, fold): the lexicon of fold 0, of fold 1 and, at -1, of both. Each has TERMS terms at most."""
    counts = rows.mapInArrow(_counted, "t string, fold int, toxic int, n long").groupBy("t").pivot("fold", [0, 1])
    sums = counts.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("b")).na.fill(0)
    sums = stash.put(sums.withColumns({"-1_a": F.col("0_a") + F.col("1_a"), "-1_b": F.col("0_b") + F.col("1_b")}))
    whole = sums.where("t = ''").first()
    out = {}
    for k in (0, 1, -1):
        n_a, n_b = (float(whole[f"{k}_{c}"]) if whole else 0.0 for c in "ab")
        if not n_a or not n_b:
            out[k] = Lexicon({})
            continue
        a, b = F.col(f"{k}_a").cast("double"), F.col(f"{k}_b").cast("double")
        odds = F.log(((a + 0.5) / (n_a + 1)) / ((b + 0.5) / (n_b + 1)))
        sure = evidence(a, b, n_a, n_b)
        best = sums.where("t <> ''").where((a * n_b > LIFT * b * n_a) & (sure >= SIGMA**2)).select("t", odds.alias("w"), sure.alias("g")).orderBy(F.desc("g"), "t").limit(TERMS)
        out[k] = Lexicon({r.t: r.w for r in best.collect()})
    return out


class Boosted:
    """Logistic gradient boosting on binned features; complete trees of fixed depth."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.base, self.trees, self.edges = 0.0, [], None

    def _binned(self, x):
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x, y):
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        if not 0 < y.sum() < len(y):
            return self
        b, f, width = self._binned(x), np.full(len(y), self.base), self.bins + 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h, node = y - q, q * (1 - q), np.zeros(len(y), np.int64)
            feat, cutoff = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width)
            for d in range(self.depth):
                first, best = 2**d - 1, np.full(2**d, 1e-9)
                for j in range(b.shape[1]):
                    key = (node - first) * width + b[:, j]
                    gs = np.bincount(key, g, 2**d * width).reshape(-1, width).cumsum(1)
                    hs = np.bincount(key, h, 2**d * width).reshape(-1, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    at = gain.argmax(1)
                    better = gain[np.arange(2**d), at] > best
                    best[better] = gain[np.arange(2**d), at][better]
                    feat[first : first + 2**d][better], cutoff[first : first + 2**d][better] = j, at[better]
                node = 2 * node + 1 + (b[np.arange(len(y)), feat[node]] > cutoff[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            f += value[leaf]
            self.trees.append((feat, cutoff, value))
        return self

    def margin(self, x):
        b, f = self._binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feat, cutoff, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feat[node]] > cutoff[node])
            f += value[node - (2**self.depth - 1)]
        return f


def isotonic(x, y) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; ties of x are pooled first. Points (x, value) to interpolate between."""
    order = np.argsort(x, kind="stable")
    xs, start = np.unique(x[order], return_index=True)
    total, weight = np.add.reduceat(y[order].astype(float), start), np.diff([*start, len(x)]).astype(float)
    blocks: list[list[float]] = []
    for lo, s, w in zip(xs, total, weight):
        blocks.append([lo, lo, s, w])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            lo2, hi, s2, w2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + s2, blocks[-1][3] + w2]
    px = np.array([v for lo, hi, _, _ in blocks for v in (lo, hi)])
    py = np.array([(s + 0.05) / (w + 0.1) if w < 20 else s / w for _, _, s, w in blocks for _ in (0, 1)])
    return px, np.maximum.accumulate(py)


class Model:
    """Lexicon, trees and calibration; `third` marks the rows that calibrate."""

    def __init__(self, x, y, third, lexicon: Lexicon | None = None):
        self.lexicon = Lexicon({}) if lexicon is None else lexicon
        fit, rest = (~third, third) if len(set(y[third])) == 2 and len(set(y[~third])) == 2 else (np.ones(len(y), bool),) * 2
        self.trees = Boosted().fit(x[fit], y[fit])
        self.constant = None if len(set(y)) == 2 else float(y.mean()) if len(y) else 0.5
        self.px, self.py = isotonic(self.trees.margin(x[rest]), y[rest]) if self.constant is None else (None, None)

    def score(self, x):
        """The isotonic value, with a thousandth of the raw order kept to break its steps."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        m = self.trees.margin(x)
        return np.clip(0.999 * np.interp(m, self.px, self.py) + 0.001 / (1 + np.exp(-m)), 0, 1)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def labelled(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """doc_id, text, toxic, fold of at most max_labels documents outside the held-out quarter."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Fit on at most max_labels rows outside the held-out quarter; only their features and the lexicon reach the driver."""
    with Stash(docs.sparkSession) as stash:
        rows = stash.put(labelled(docs, labels, max_labels))
        learnt = lexicons(rows, stash)
        other = {0: learnt[1].weights, 1: learnt[0].weights}

        def measured(batches):
            lex = {k: Lexicon(w) for k, w in other.items()}
            for b in batches:
                x = [features(t or "", lex[f]) for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

        got = rows.mapInArrow(measured, "doc_id long, toxic int, x array<double>").collect()
    got = sorted(got, key=lambda r: r.doc_id)
    x = np.array([r.x for r in got], np.float64).reshape(len(got), len(NAMES) + len(SHAPES))
    ids = np.array([r.doc_id for r in got], np.int64)
    return Model(x, np.array([r.toxic for r in got], np.float64), (ids * 2654435761 >> 8) % 3 == 0, learnt[-1])


def scored(docs: DataFrame, model: Model, name: str = "score"):
    """docs with its score in a further column; every column and row stays."""
    names = docs.columns
    schema = plus(docs, name, "double")

    def apply(batches):
        lexicon = Lexicon(model.lexicon.weights)
        for b in batches:
            s = model.score(matrix(b.column("text").to_pylist(), lexicon))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s, pa.float64())], names=[*names, name])

    return docs.mapInArrow(apply, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose predicted label is 0, with their own columns, whatever their names."""
    (name,) = spare(docs, "score")
    return scored(docs, train(docs, labels), name).where(F.col(name) < THRESHOLD).select(*docs.columns)
