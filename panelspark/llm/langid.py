"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's features are the byte n-grams of its lower-cased words (word ends marked), each hashed into a table of
embeddings. The text is the mean of its embeddings; a linear layer and a softmax over the languages follow. All is
trained by stochastic gradient descent in numpy on a bounded sample. For prediction the linear layer is folded into
the table, so a text costs one look-up for each n-gram and language, whatever its length.

A temperature, fitted on rows kept out of training, calibrates the score; the least score at which accepted
rows of that part are right often enough is the rejection threshold (column ``accepted``).

Results in odd cases: null texts and texts without a letter are ``und`` with score 0 and not accepted; with no
training rows every text is so; ties go to the first language by name; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, over_texts, remainder

#: Lengths of the byte n-grams, slots of the embedding table, and its width.
GRAMS, SLOTS, WIDTH = (3, 4), 1 << 16, 16
#: Bound of the training sample in rows, and of the length of its texts in code points.
ROWS, MAX_CHARS = 3000, 20_000
LETTER = regex.compile(r"\p{L}")

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, offset) of every n-gram within a word of folded bytes; a blank before or after counts to the word."""
    slots, offsets = [], []
    wide, blank = data.astype(np.uint32), data == 0x20
    for n in GRAMS:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= wide[k : k + m]
        h ^= h >> 15
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> 13
        inner = ~blank[1 : 1 + m]
        for k in range(2, n - 1):
            inner &= ~blank[k : k + m]
        at = np.flatnonzero(inner)
        slots.append((h[at] & np.uint32(SLOTS - 1)).astype(np.int64))
        offsets.append(at)
    if not slots:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(slots), np.concatenate(offsets)


def folded(text: str) -> np.ndarray:
    return _FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]


class Model:
    """Languages, the folded table of logits by slot, the bias, the temperature and the rejection threshold."""

    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray):
        self.names, self.table, self.bias = names, np.ascontiguousarray(table.T.astype(np.float32)), bias
        self.temperature, self.threshold = 1.0, 0.0

    def logits(self, texts: list[str], piece: int = 1 << 20) -> np.ndarray:
        """Logits of each text. Texts are read in pieces of bounded length, whose sums are added up."""
        total = np.zeros((len(texts), len(self.names)))
        count = np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def flush():
            data = np.concatenate([x for _, x in held])
            starts = np.cumsum([0, *(len(x) for _, x in held)])
            slots, offsets = grams(data)
            if len(slots):
                row = np.searchsorted(starts, offsets, "right") - 1
                for c in range(len(self.names)):
                    np.add.at(total[:, c], [i for i, _ in held], np.bincount(row, self.table[c][slots], len(held)))
                np.add.at(count, [i for i, _ in held], np.bincount(row, minlength=len(held)))
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            data, at = folded(text), 0
            while at < len(data) - 1:
                # a piece ends with the blank that starts the next one, so no n-gram within a word is lost or met twice
                end = at + piece
                if end < len(data):
                    ahead = np.flatnonzero(data[end - 1 :] == 0x20)
                    end += int(ahead[0])
                held.append((i, data[at:end]))
                size += len(held[-1][1])
                at = min(end, len(data)) - 1
                if size >= piece:
                    flush()
                    size = 0
        if held:
            flush()
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list) -> dict:
        known = [t if t is not None and LETTER.search(t) else None for t in texts]
        z = self.logits([t or "" for t in known]) / self.temperature
        p = softmax(z)
        best = p.argmax(axis=1)
        score = [float(p[i, b]) if t is not None else 0.0 for i, (b, t) in enumerate(zip(best, known, strict=True))]
        return {"lang_pred": [self.names[b] if t is not None else "und" for b, t in zip(best, known, strict=True)], "score": score, "accepted": [t is not None and s >= self.threshold for s, t in zip(score, known, strict=True)]}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, precision: float = 0.99, seed: int = 7) -> Model | None:
    """The model learned from texts and their languages; a fifth of them is kept for calibration."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (SLOTS, WIDTH))
    w, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    order = rng.permutation(len(texts))
    held = order[: len(order) // 5]
    fit = order[len(order) // 5 :]
    rows = {i: np.unique(grams(folded(texts[i]))[0], return_counts=True) for i in fit.tolist()}
    steps = epochs * len(fit)
    for k in range(steps):
        if k % len(fit) == 0:
            fit = rng.permutation(fit)
        i = int(fit[k % len(fit)])
        slots, n = rows[i]
        if not len(slots):
            continue
        share = n / n.sum()
        lr = rate * (1 - k / steps)
        x = share @ emb[slots]
        g = softmax((x @ w + bias)[None])[0]
        g[y[i]] -= 1
        back = w @ g
        w -= lr * np.outer(x, g)
        bias -= lr * 0.1 * g
        # the gradient of a mean is spread thin over many n-grams; its weight is raised to the n-grams' own scale
        emb[slots] -= lr * np.minimum(share[:, None] * len(slots), 5.0) * back
    model = Model(names, emb @ w, bias)
    if len(held):
        z, right = model.logits([texts[i] for i in held]), y[held]
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), right], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
        p = softmax(z / model.temperature)
        score, hit = p.max(axis=1), p.argmax(axis=1) == right
        down = np.argsort(-score)
        good = np.flatnonzero(np.cumsum(hit[down]) / np.arange(1, len(down) + 1) >= precision)
        model.threshold = float(score[down][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, rows: int = ROWS, max_chars: int = MAX_CHARS) -> Model | None:
    """Trains on a bounded sample of the rows that have a language; ``docs`` holds no row that must stay unseen."""
    sample = labelled_sample(docs, docs, "lang", rows, max_chars, "string").orderBy("doc_id").toArrow()
    return train(sample.column("text").to_pylist(), sample.column("label").to_pylist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row."""

    def make():
        if model is None:
            return lambda texts: {"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "accepted": [False] * len(texts)}
        return model.predict

    return docs.select("doc_id", over_texts(make, "lang_pred string, score double, accepted boolean", "text").alias("r")).select("doc_id", "r.*")


def held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: learned without the rows whose crc32 remainder by 4 is 2."""
    out = remainder("doc_id", 4) == 2
    model = fit(docs.where(~out))
    return identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "accepted")
