"""Quality scores learned from preference pairs (Bradley-Terry), thresholded by a quantile of the scores.

Every text has a vector of surface features (shares of kinds of characters, word and line statistics, repetition),
each spread over hinges at quantiles of the training sample. A linear score is learned so that the logistic of a
difference of two scores is the chance that the first text is the better one; pairs are drawn at random between rows
of label 1 and rows of label 0. The cut is the lowest quantile of the training scores whose balanced accuracy is next to
the best, and scores are shown on a logistic scale on which that cut is 0.3.

Results in odd cases: null texts count as empty and have a score too; with no training rows, or rows of one label
only, every score is 0.5; rows with a null label or key do not train; repeated rows are scored alike; very long
texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, over_texts, remainder

#: Scores from here on are predicted as good.
CUT = 0.3
#: Bounds of the training sample: rows, code points of a text, and preference pairs.
ROWS, MAX_CHARS, PAIRS = 6000, 50_000, 30_000
#: The lowest quantile within so much of the best balanced accuracy is taken: in doubt a text stays.
SLACK = 0.004
KNOTS = (0.1, 0.3, 0.5, 0.7, 0.9, 0.97)

_KINDS = ["lower", "upper", "digit", "blank", "newline", "high", "stop", "bar", "mark", "symbol", "control"]
_KIND = np.full(256, 10, np.uint8)
for _c in range(256):
    _s = chr(_c)
    if "a" <= _s <= "z":
        _KIND[_c] = 0
    elif "A" <= _s <= "Z":
        _KIND[_c] = 1
    elif "0" <= _s <= "9":
        _KIND[_c] = 2
    elif _s in " \t":
        _KIND[_c] = 3
    elif _s in "\n\r":
        _KIND[_c] = 4
    elif _c >= 0x80:
        _KIND[_c] = 5
    elif _s in ".,;:?'\"()-":
        _KIND[_c] = 6
    elif _s in "|\\/_<>{}[]":
        _KIND[_c] = 7
    elif _s == "!":
        _KIND[_c] = 8
    elif 0x20 < _c < 0x7F:
        _KIND[_c] = 9

_TAIL = re.compile(r"[^\s\w.,;:?'\")\]!-](?=\s|$)")


def features(text: str | None) -> list[float]:
    text = text or ""
    counts = np.bincount(_KIND[np.frombuffer(text.encode(), np.uint8)], minlength=len(_KINDS)).astype(float)
    n = max(counts.sum(), 1.0)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, k = max(len(words), 1), max(len(lines), 1)
    kinds = len(set(words))
    return [
        *(counts / n),
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / w,
        kinds / w,
        np.log1p(kinds) / np.log1p(w),
        1 - len(set(lines)) / k,
        np.log1p(w / k),
        len(_TAIL.findall(text)) / w,
        counts[1] / max(counts[0] + counts[1], 1.0),
        counts[6] / w,
        float(text[-1:] in (".", "!", "?", '"')),
    ]


class Model:
    """Centre and scale of the features, the hinges' knots, the weights, the cut and the scale of the scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centre, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        self.knots = np.quantile(self._plain(x), KNOTS, axis=0)
        f = self.expand(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        d = f[rng.choice(good, PAIRS)] - f[rng.choice(bad, PAIRS)]
        w, ahead, step = np.zeros(f.shape[1]), np.zeros(f.shape[1]), 4.0 / max(np.einsum("ij,ij->i", d, d).mean(), 1e-9)
        for k in range(300):
            v = w + (k / (k + 3)) * (w - ahead)
            p = 1 / (1 + np.exp(np.clip(d @ v, -40, 40)))
            ahead, w = w, v + step * (d.T @ p / len(d) - 1e-3 * v)
        self.weights = w
        s = f @ w
        quantiles = np.quantile(s, np.linspace(0.001, 0.999, 999))
        right = np.array([((s[good] >= q).mean() + (s[bad] < q).mean()) / 2 for q in quantiles])
        self.cut = float(quantiles[np.flatnonzero(right >= right.max() - SLACK)[0]])
        self.spread = float(max(np.median(np.abs(s - self.cut)), 1e-9))

    def _plain(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = self._plain(x)
        return np.concatenate([z, *(np.maximum(z - k, 0) for k in self.knots)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = (self.expand(x) @ self.weights - self.cut) / self.spread
        return 1 / (1 + np.exp(-np.clip(2 * s + np.log(CUT / (1 - CUT)), -500, 500)))


def vectors(docs: DataFrame, *kept: str) -> DataFrame:
    """The kept columns and the feature vector of every row."""
    return docs.select(*kept, over_texts(lambda: lambda texts: {"x": [features(t) for t in texts]}, "x array<double>", "text").alias("r")).select(*kept, F.col("r.x").alias("x"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, max_chars: int = MAX_CHARS) -> Model | None:
    """Learns from a bounded sample of labelled rows; only their feature vectors come to the driver."""
    got = vectors(labelled_sample(docs, labels.where(F.col("quality").isin(0, 1)), "quality", rows, max_chars), "doc_id", "label").orderBy("doc_id").toArrow()
    y = np.array(got.column("label").to_pylist(), int)
    if len({*y.tolist()} & {0, 1}) < 2:
        return None
    return Model(np.array(got.column("x").to_pylist()), y)


def score_column(model: Model | None, text: str = "text"):
    def make():
        if model is None:
            return lambda texts: {"score": [0.5] * len(texts)}
        return lambda texts: {"score": model.score(np.array([features(t) for t in texts]).reshape(len(texts), -1)).tolist() if texts else []}

    return over_texts(make, "score double", text)["score"]


def training_rows(labels: DataFrame) -> DataFrame:
    return labels.where(remainder("doc_id", 5) != 0)


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every row."""
    return docs.select("doc_id", score_column(model).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned without labels of rows whose crc32 remainder by 5 is 0."""
    model = fit(docs, training_rows(labels))
    return scores(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
