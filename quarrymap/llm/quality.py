"""Quality classifier by positive-unlabelled learning.

A network with one small hidden layer minimises the non-negative unbiased risk: the loss of trusted positives, weighted by
the class prior, plus what unlabelled text costs as negatives beyond the positives' share of it, never below zero. The prior
is estimated from positives and unlabelled text alone: a network that tells the one from the other is fitted on half of the
sample, and on the other half the prior is the least ratio, over score limits, of the share of unlabelled text above the limit
to that of positives, with a bound for chance (best bin estimation). Labels that are not positive are not used at all.
Features are of the text alone: hashed shapes of words and a few rates; labels, language, source and id never enter a score.

The fit uses a bounded sample of labelled positives and of unlabelled text (``POSITIVES``, ``UNLABELLED``, in ids), chosen by
a hash of the id and never from the held-out fold; of rows with one id the smallest text is taken. Every row is scored, by
its whole text. Null and empty texts have all rates zero and get a score as well. An id with several labels is a positive if
all of them are 1. Rows without an id count as held out. If there are no positives or no other text, every score is 0.5. An
empty table gives an empty one. Repeated rows are scored alike, other columns pass through, and columns of the result's names
are replaced; helper columns begin with ``_qm_``, names that a table must not have.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.arrow import with_python
from quarrymap.session import table

#: Bounds of the sample that the classifier is fitted on, in documents.
POSITIVES, UNLABELLED = 3000, 6000
FOLDS = 5
THRESHOLD = 0.3
SHAPES = 64
HIDDEN, STEPS, RATE, DECAY = 12, 300, 0.02, 1e-3
#: Bounds of the class prior, and the confidence and slack with which its limit is chosen.
PRIORS, CHANCE, SLACK = (0.05, 0.95), 0.1, 0.01

_SHAPE = bytes(ord("d") if 0x30 <= b <= 0x39 else ord("X") if 0x41 <= b <= 0x5A else ord("x") if 0x61 <= b <= 0x7A or b >= 0x80 else b for b in range(256))
_bucket: dict[bytes, int] = {}


def _shape_bucket(shape: bytes) -> int:
    """The bucket of a word's shape, in which runs of one kind count once and longer ones twice."""
    if (k := _bucket.get(shape)) is None:
        out = bytearray()
        for b in shape:
            if out[-2:] != bytes((b, b)):
                out.append(b)
        k = zlib.crc32(bytes(out)) % SHAPES
        if len(_bucket) < 100_000:
            _bucket[shape] = k
    return k


def features(text: str | None) -> list[float]:
    """The features of one text, each between about 0 and a few units."""
    raw = (text or "").encode()
    shapes, words = raw.translate(_SHAPE), raw.split()
    n, size = len(words), len(raw)
    out = [0.0] * (SHAPES + 10)
    if not n:
        return out
    for shape, count in Counter(shapes.split()).items():
        out[_shape_bucket(shape)] += count / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = shapes.count(b"x") + shapes.count(b"X")
    distinct = len(set(words))
    out[SHAPES:] = [
        np.log1p(n) / 5,
        distinct / n,
        np.log1p(distinct) / np.log1p(n),
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        1 - len(set(lines)) / len(lines),
        shapes.count(b"X") / max(1, letters),
        sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!"))) / size * 4,
        size / n / 10,
        shapes.count(b"d") / size * 4,
        np.log1p(n / len(lines)) / 5,
    ]
    return out


def _features(texts):
    return [[[float(x) for x in features(t)] for t in texts]]


class Model:
    """The network, with the features' means and scales."""

    def __init__(self, seed: int = 7):
        self.seed = seed
        self.bias: float | None = 0.0

    def _descend(self, x: np.ndarray, slope) -> Model:
        """Full-batch Adam; ``slope`` gives the loss's slope by the outputs."""
        self.bias = None
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 0.02)
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        rng = np.random.default_rng(self.seed)
        weights = [rng.normal(0, 0.3 / np.sqrt(x.shape[1]) * 3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, STEPS + 1):
            hidden = np.tanh(x @ weights[0] + weights[1])
            d = slope(hidden @ weights[2] + weights[3][0])
            back = np.outer(d, weights[2]) * (1 - hidden**2)
            slopes = [x.T @ back, back.sum(0), hidden.T @ d, d.sum(keepdims=True)]
            for i, (w, s) in enumerate(zip(weights, slopes, strict=True)):
                s = s + DECAY * w * (i % 2 == 0)
                first[i] = 0.9 * first[i] + 0.1 * s
                second[i] = 0.999 * second[i] + 0.001 * s * s
                w -= RATE * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = weights
        return self

    def fit_telling(self, positive: np.ndarray, unlabelled: np.ndarray) -> Model:
        """The logistic loss of telling positives from unlabelled text, both with half of the weight."""
        n, m = len(positive), len(unlabelled)
        target = np.repeat([1.0, 0.0], [n, m])
        weight = np.repeat([0.5 / n, 0.5 / m], [n, m])
        return self._descend(np.concatenate([positive, unlabelled]), lambda g: weight * (1 / (1 + np.exp(-g)) - target))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
        """The non-negative risk of the logistic loss."""
        n, m = len(positive), len(unlabelled)
        if not n or not m:
            self.bias = 0.0
            return self

        def slope(g):
            p = 1 / (1 + np.exp(-g))
            loss_as_negative = np.logaddexp(0, g)
            negative_risk = loss_as_negative[n:].mean() - prior * loss_as_negative[:n].mean()
            if negative_risk >= 0:
                return np.concatenate([prior * ((p[:n] - 1) - p[:n]) / n, p[n:] / m])
            return np.concatenate([prior * p[:n] / n, -p[n:] / m])  # only undo the part below zero

        return self._descend(np.concatenate([positive, unlabelled]), slope)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.bias is not None:
            g = np.full(len(x), self.bias)
        else:
            x = np.clip((x - self.mean) / self.scale, -6, 6)
            g = np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3][0]
        return 1 / (1 + np.exp(-g))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> float:
    """The share of positives in unlabelled text, from ``PRIORS[0]`` to ``PRIORS[1]``, by best bin estimation."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    teller = Model(seed).fit_telling(positive[::2], unlabelled[::2])
    of_positive, of_all = np.sort(teller.scores(positive[1::2])), np.sort(teller.scores(unlabelled[1::2]))
    n, m = len(of_positive), len(of_all)
    above = 1 - np.arange(n) / n  # the share of positives from each positive's score on
    shares = 1 - np.searchsorted(of_all, of_positive, side="left") / m
    chance = np.sqrt(np.log(4 / CHANCE) / 2) * (1 / np.sqrt(m) + 1 / np.sqrt(n))
    best = int(np.argmin((shares + (1 + SLACK) * chance) / above))
    return float(np.clip(shares[best] / above[best], *PRIORS))


def _held_out(id):
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """The features of the bounded samples of labelled positives and of unlabelled text, one row for each id."""
    key, width = F.col(f"`{id}`"), SHAPES + 10
    open_labels = labels.where(~_held_out(id) & F.col(f"`{label}`").isNotNull()).groupBy(key.alias("id")).agg(F.min(f"`{label}`").alias("label"))
    positive = open_labels.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(POSITIVES).select("id", F.lit(1).alias("kind"))
    others = docs.where(~_held_out(id)).select(key.alias("id")).distinct().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(UNLABELLED).select("id", F.lit(0).alias("kind"))
    chosen = positive.unionAll(others)  # at most POSITIVES + UNLABELLED ids
    texts = docs.select(key.alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "id")
    # One text for each id: however often an id comes, it weighs once and no more rows are collected than ids were chosen.
    once = texts.groupBy("id", "kind").agg(F.min("text").alias("text"))
    rows = with_python(once, _features, ["text"], [T.StructField("x", T.ArrayType(T.DoubleType()))], drop=["text"]).collect()
    rows.sort(key=lambda r: zlib.crc32(str(r.id).encode()))
    return tuple(np.array([r.x for r in rows if r.kind == k]).reshape(-1, width) for k in (1, 0))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model of the bounded samples."""
    positive, unlabelled = sample(docs, labels, id, text, label)
    return Model().fit(positive, unlabelled, class_prior(positive, unlabelled))


def _scores(texts, model):
    return [model.scores(np.array([features(t) for t in texts]).reshape(-1, SHAPES + 10)).tolist()]


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    return with_python(docs, partial(_scores, model=model), [text], [T.StructField(out, T.DoubleType(), False)])


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject."""
    return score(docs, fit(docs, labels, id, text), text, "_qm_score").where(F.col("_qm_score") >= THRESHOLD).drop("_qm_score")
