"""Toxicity scores from gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of three lexicons (a short list of insults, words and word beginnings that the training sample
shows in toxic texts far more often than chance), how dense their hits get within a window, how near they stand to
words of the second person, and rates of capitals, punctuation and obfuscated spelling. The two learned lexicons
are filled from one half of the sample when the other half's features are made, so that trees do not trust them too
much; all of the sample fills those used for prediction.

Trees grow on histograms of binned features by Newton steps of the logistic loss, in numpy. A part of the sample,
kept from the trees, fits the isotonic step function from raw scores to chances.

Results in odd cases: null texts count as empty and get a score; with no training rows, or rows of one label only,
every score is 0; rows with a null label or key do not train; repeated rows are scored alike; long texts are read
whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, over_texts, remainder

#: Scores from here on are predicted as toxic.
CUT = 0.7
#: Bounds of the training sample: rows, and code points of a text.
ROWS, MAX_CHARS = 8000, 20_000
#: Lengths of learned word beginnings; words in a window; words between a hit and a second person.
STARTS, WINDOW, NEAR = (3, 4, 5, 6, 7), 25, 4
#: A learned entry has at least so many hits in toxic texts, and so many standard errors over chance.
HITS, ERRORS, ENTRIES = 5, 5.5, 400

# fixed values: insults and words of the second person
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless disgusting clown jerk fool imbecile "
    "bastard cretin degenerate filth lowlife nitwit pig rat scumbag sicko swine vermin coward creep crap shit fuck asshole bitch "
    "connard salaud merde abruti crétin débile ordure idiote salope con arschloch scheisse scheiße dummkopf trottel abschaum depp "
    "schwein wichser estúpido imbécil basura mierda cabrón pendejo gilipollas puta escoria inútil".split()
)
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú usted ustedes tus vosotros".split())

WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"[^\W\d_]+[*@$#0-9]+[^\W\d_]+|([^\W\d_])\1\1")
LOUD = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+")
NAMES = 21


class Lexicon:
    """Words and word beginnings that mark toxic texts, each with the logarithm of how much more often they are there."""

    def __init__(self, words: dict[str, float], starts: dict[str, float]):
        self.words, self.starts = words, starts
        self.heads = {w[: STARTS[0]] for w in (*words, *starts)}

    def hits(self, words: list[str]) -> tuple[list[int], list[int], list[float]]:
        """Places of insults, places of learned entries, and the weights of the latter."""
        first = [i for i, w in enumerate(words) if w in INSULTS]
        n, heads = STARTS[0], self.heads
        found = [(i, w) for i, w in enumerate(words) if w[:n] in heads] if heads else []
        weight = [max(self.words.get(w, 0.0), *(self.starts.get(w[:k], 0.0) for k in STARTS)) for _, w in found]
        return first, [i for (i, _), x in zip(found, weight, strict=True) if x], [x for x in weight if x]


def learn_lexicon(texts: list[str], labels: list[int]) -> Lexicon:
    counts: dict[int, tuple[Counter, Counter]] = {n: (Counter(), Counter()) for n in (0, *STARTS)}
    seen: dict[int, Counter] = {n: Counter() for n in (0, *STARTS)}
    total = [0, 0]
    for text, y in zip(texts, labels, strict=True):
        words = [w for w in WORD.findall(text.lower()) if len(w) >= STARTS[0]]
        total[y] += len(words)
        for n in counts:
            own = words if n == 0 else [w[:n] for w in words if len(w) >= n]
            counts[n][y].update(own)
            if y:
                seen[n].update(set(own))
    share = total[1] / max(sum(total), 1)

    def marked(n: int) -> dict[str, float]:
        found = []
        for w, k in counts[n][1].items():
            expected = (k + counts[n][0][w]) * share
            z = (k - expected) / np.sqrt(expected + 1)
            if k >= HITS and seen[n][w] >= 3 and z >= ERRORS:
                found.append((z, w, float(np.log((k + 0.5) / (counts[n][0][w] + 0.5) * (total[0] + 1) / (total[1] + 1)))))
        return {w: x for _, w, x in sorted(found, reverse=True)[:ENTRIES] if x > 1}

    return Lexicon(marked(0), {w: x for n in STARTS for w, x in marked(n).items()})


def _densest(hits: list[int]) -> int:
    most = low = 0
    for high, at in enumerate(hits):
        while at - hits[low] >= WINDOW:
            low += 1
        most = max(most, high - low + 1)
    return most


def _capitals(text: str) -> int:
    """Upper-case characters of every alphabet, as str.isupper tells them."""
    plain = text.encode("ascii", "ignore")
    own = len(plain) - len(plain.translate(None, CAPITALS))
    return own if len(plain) == len(text) else own + sum(map(str.isupper, "".join(BEYOND_ASCII.findall(text))))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = WORD.findall(text.lower())
    n, size = max(len(words), 1), max(len(text), 1)
    insults, learned, weights = lexicon.hits(words)
    every = sorted({*insults, *learned})
    near = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in every)
    letters = sum(map(len, words)) or 1
    strong = sum(x >= 3 for x in weights)
    return [
        100 * len(insults) / n,
        float(len(insults)),
        100 * len(learned) / n,
        float(len(learned)),
        100 * sum(weights) / n,
        sum(weights),
        100 * strong / n,
        float(strong),
        sum(sorted(weights)[-3:]),
        100 * len(every) / n,
        float(len(every)),
        float(_densest(every)),
        near / max(len(every), 1),
        100 * near / n,
        _capitals(text) / letters,
        len(LOUD.findall(text)) / n,
        100 * text.count("!") / size,
        100 * text.count("?") / size,
        100 * (text.count(".") + text.count(",")) / size,
        100 * sum(1 for _ in ODD.finditer(text)) / n,
        np.log1p(len(words)),
    ]


class Trees:
    """Boosted trees of fixed depth over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        grid = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
        # zeros prevail in most densities: what lies over zero is cut by its own quantiles too
        self.edges = [np.unique(np.concatenate([g, np.quantile(c[c > 0], np.linspace(0, 1, bins + 1)[:-1]) * 0.999999 if (c > 0).any() else []])) for g, c in zip(grid, x.T, strict=True)]
        b = self.binned(x)
        width = max(len(e) for e in self.edges) + 1
        base = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start, self.depth, self.trees = float(np.log(base / (1 - base))), depth, []
        f = np.full(len(y), self.start)
        flat = b + np.arange(b.shape[1]) * width
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), int)
            splits: list[tuple[int, int]] = []
            for level in range(depth):
                for k in range(2**level):
                    rows = np.flatnonzero(node == 2**level - 1 + k)
                    feature, cut = 0, width
                    if len(rows) >= 20:
                        m = b.shape[1] * width
                        gs = np.bincount(flat[rows].ravel(), np.repeat(g[rows], b.shape[1]), m).reshape(-1, width).cumsum(axis=1)
                        hs = np.bincount(flat[rows].ravel(), np.repeat(h[rows], b.shape[1]), m).reshape(-1, width).cumsum(axis=1)
                        gt, ht = gs[:, -1:], hs[:, -1:]
                        gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                        gain[(hs < 1) | (ht - hs < 1)] = -1
                        at = int(gain.argmax())
                        if gain.flat[at] > 1e-6:
                            feature, cut = divmod(at, width)
                    splits.append((feature, cut))
                    node[rows] = 2 * node[rows] + 1 + (b[rows, feature] > cut)
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            f += value[leaf]
            self.trees.append((np.array(splits), value))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out, at = np.full(len(x), self.start), np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[at, splits[node, 0]] > splits[node, 1])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from score, chance) of the best non-decreasing fit, by pooling adjacent violators. Each step's chance
    is drawn a little to the mean of all, as if half a row of either label were added."""
    order = np.argsort(s, kind="stable")
    pools: list[list[float]] = []
    for v, t in zip(s[order].tolist(), y[order].tolist(), strict=True):
        if pools and pools[-1][0] == v:
            pools[-1][1] += t
            pools[-1][2] += 1
        else:
            pools.append([v, t, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, t2, n2 = pools.pop()
            pools[-1][1] += t2
            pools[-1][2] += n2
    return np.array([p[0] for p in pools]), np.maximum.accumulate([(p[1] + 0.5) / (p[2] + 1) if p[1] not in (0, p[2]) else (p[1] + 0.05) / (p[2] + 0.1) for p in pools])


class Model:
    def __init__(self, texts: list[str], labels: list[int], seed: int = 5):
        y = np.array(labels)
        order = np.random.default_rng(seed).permutation(len(texts))
        halves = order[::2], order[1::2]
        x = np.zeros((len(texts), NAMES))
        for own, other in (halves, halves[::-1]):
            lexicon = learn_lexicon([texts[i] for i in other], [labels[i] for i in other])
            for i in own.tolist():
                x[i] = features(texts[i], lexicon)
        self.lexicon = learn_lexicon(texts, labels)
        kept = order[: len(order) // 4]
        grown = order[len(order) // 4 :]
        if len({*y[kept].tolist()}) < 2 or len({*y[grown].tolist()}) < 2:
            kept = grown = order
        self.trees = Trees(x[grown], y[grown])
        self.steps, self.chance = isotonic(self.trees.raw(x[kept]), y[kept])

    def score(self, texts: list) -> np.ndarray:
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), NAMES))
        # between two steps the chance is read off the line that joins their starts
        return np.interp(raw, self.steps, self.chance)


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, max_chars: int = MAX_CHARS) -> Model | None:
    """Learns from a bounded sample of labelled rows."""
    got = labelled_sample(docs, labels.where(F.col("toxic").isin(0, 1)), "toxic", rows, max_chars).orderBy("doc_id").toArrow()
    y = got.column("label").to_pylist()
    return Model(got.column("text").to_pylist(), y) if len(set(y)) == 2 else None


def score_column(model: Model | None, text: str = "text"):
    def make():
        if model is None:
            return lambda texts: {"score": [0.0] * len(texts)}
        return lambda texts: {"score": model.score(texts).tolist() if texts else []}

    return over_texts(make, "score double", text)["score"]


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every row."""
    return docs.select("doc_id", score_column(model).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned without labels of rows whose crc32 remainder by 3 is 1."""
    out = remainder("doc_id", 3) == 1
    model = fit(docs, labels.where(~out))
    return scores(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")
