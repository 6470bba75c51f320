"""Encoding and decoding with the merge-type vocabulary of a SentencePiece model file.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they would make (ties: leftmost
first), merges the best until none is left, and spells symbols without a piece as bytes. Where no piece holds a
word-start mark after another character, no merge crosses a word start, so texts are cut there (and at characters
that no piece holds) and each distinct part is encoded once a worker. The parts new in an Arrow batch are checked
against the sentencepiece library, both ways, before they are used.

Results in odd cases: null and empty texts have no ids and decode to the empty text; bytes of invalid or broken
sequences decode to U+FFFD as the library does; texts of any length are encoded whole; repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, over_texts

#: The mark that stands for a blank.
MARK = "▁"
#: Letters, as a class of a pattern.
LATIN = "A-Za-zÀ-ɏ"
#: Parts that a worker keeps encoded; when more would be held, those that came only once are let go.
HELD = 300_000
#: Parts up to this length are merged side by side in arrays, longer ones one by one.
SHORT = 24


class Pieces:
    """A vocabulary, read from a model file."""

    def __init__(self, model: bytes | None = None, path: str | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model) if model is not None else sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.cost = {self.names[i]: -lib.get_score(i) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.plain = [None] * n
        for i in plain:
            self.plain[i] = self.names[i]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.hidden = {i for i in range(n) if lib.is_control(i)}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.chars = {c for p in self.ids for c in p}
        lone = "" if "\n" in self.chars else "\n"
        # parts never share a merge: no piece holds a mark after another character, or a character that is in no piece
        # nor, with most vocabularies, a letter and what is no letter after it
        letter, blank = re.compile(f"[{LATIN}]"), f"[ {MARK}]*"
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.part = re.compile(r"(?s).+")
        elif any(letter.match(p[0]) and not letter.match(p[1]) for p in self.pairs):
            self.part = re.compile(f"{lone + '|' if lone else ''}{blank}[^ {MARK}{lone}]+|[ {MARK}]+")
        else:
            self.part = re.compile(f"{blank}[{LATIN}]+|{lone + '|' if lone else ''}{blank}[^ {MARK}{lone}{LATIN}]+[{LATIN}]*|[ {MARK}]+")
        self.held: dict[str, str] = {}
        #: parts met again since the last time that parts were let go
        self.again: set[str] = set()
        #: of parts whose decoded form is another text
        self.odd: dict[str, str] = {}
        self.said = list(map(str, range(n)))
        self._tables(n)

    def merge(self, text: str) -> list[str]:
        """The symbols of a text after all merges, by the agenda."""
        cost = self.cost
        symbols: list = list(text)
        n = len(symbols)
        if n < 2:
            return symbols
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in cost:
                agenda.append((cost[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or right[i] != j or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue  # one of both has been merged since
            symbols[i], symbols[j] = pair, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                new = pair + symbols[k]
                if new in cost:
                    heapq.heappush(agenda, (cost[new], i, k, new))
            k = left[i]
            if k >= 0:
                new = symbols[k] + pair
                if new in cost:
                    heapq.heappush(agenda, (cost[new], k, i, new))
        return [s for s in symbols if s is not None]

    def spell(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def encode_part(self, part: str) -> list[int]:
        """The ids of a part, cut further where two neighbours are together in no piece."""
        out: list[int] = []
        at = 0
        for k in range(1, len(part) + 1):
            if k == len(part) or part[k - 1 : k + 1] not in self.pairs:
                for s in self.merge(part[at:k]):
                    out += self.spell(s)
                at = k
        return out

    def parts(self, text: str) -> list[str]:
        """Parts of a text, before which a blank is put; blanks stand for marks."""
        return self.part.findall(" " + text) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.parts(text or "") for i in self.encode_part(part.replace(" ", MARK))]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; the mark that starts it is dropped where ``first``."""
        try:
            joined = "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # a byte or a control
            pass
        else:
            return (joined[1:] if first and joined.startswith(MARK) else joined).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i is not None and i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_text(raw))
                raw = bytearray()
            if i is None or i in self.hidden:
                continue
            out.append(self.plain[i] if i != self.unknown else " ⁇ ")
        joined = "".join(out)
        if first and joined.startswith(MARK) and ids and ids[0] not in self.byte_of:
            joined = joined[1:]
        return joined.replace(MARK, " ")

    def _tables(self, n: int) -> None:
        """An open-addressed table from pairs of ids to the id of their union, and the ids of single characters."""
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.n, self.bits = n, max(4, (4 * len(pairs)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int64)
        self.union = np.full(1 << self.bits, -1, np.int32)
        key = np.array([a * n + b for a, b, _ in pairs], np.int64)
        made = np.array([i for _, _, i in pairs], np.int32)
        at = self._hash(key)
        while len(key):
            free = self.slot[at] == -1
            self.slot[at[free]] = key[free]
            won = self.slot[at] == key
            self.union[at[won]] = made[won]
            key, made, at = key[~won], made[~won], (at[~won] + 1) & ((1 << self.bits) - 1)
        self.price = np.full(n + 1, np.inf)
        for p, i in self.ids.items():
            self.price[i] = self.cost[p]
        self.single = {c: self.ids[c] for c in self.chars if c in self.ids}

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _unions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each pair's union, or -1."""
        key = a.astype(np.int64) * self.n + b
        key[(a < 0) | (b < 0)] = -2
        at = self._hash(key)
        out = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            slot = self.slot[at]
            hit = slot == key[open_]
            out[open_[hit]] = self.union[at[hit]]
            on = ~hit & (slot != -1)
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_all(self, parts: list[str]) -> list[list[int]]:
        """The ids of short parts, all of whose characters are pieces: in each round every part makes the first
        merge of its own agenda."""
        count, wide = len(parts), max(map(len, parts))
        sym = np.full((count, wide + 1), -1, np.int32)
        length = np.fromiter(map(len, parts), np.int64, count)
        flat = np.fromiter(map(self.single.__getitem__, "".join(parts)), np.int32, int(length.sum()))
        sym[np.arange(wide + 1) < length[:, None]] = flat
        make = self._unions(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(count, wide)
        cost = np.where(make >= 0, self.price[make], np.inf)
        right = np.tile(np.arange(1, wide + 2), (count, 1))
        left = np.tile(np.arange(-1, wide), (count, 1))
        rows = np.arange(count)
        while len(rows):
            j = cost[rows].argmin(axis=1)  # the leftmost of the best
            on = np.isfinite(cost[rows, j])
            rows, j = rows[on], j[on]
            if not len(rows):
                break
            k = right[rows, j]
            sym[rows, j] = make[rows, j]
            sym[rows, k] = -1
            cost[rows, np.minimum(k, wide - 1)] = np.inf
            after = np.minimum(right[rows, np.minimum(k, wide)], wide)
            right[rows, j] = after
            inside = after < wide
            left[rows[inside], after[inside]] = j[inside]
            union = self._unions(sym[rows, j], sym[rows, after])
            make[rows, j] = union
            cost[rows, j] = np.where(union >= 0, self.price[union], np.inf)
            before = left[rows, j]
            has = before >= 0
            r, b = rows[has], before[has]
            union = self._unions(sym[r, b], sym[r, j[has]])
            make[r, b] = union
            cost[r, b] = np.where(union >= 0, self.price[union], np.inf)
        alive = sym >= 0
        ids = sym[alive].tolist()
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        out: list = [None] * len(parts)
        known = self.single.keys()
        short = [k for k, p in enumerate(parts) if len(p) <= SHORT and known >= set(p)]
        short.sort(key=lambda k: len(parts[k]))
        for at in range(0, len(short), 8192):
            group = short[at : at + 8192]
            for k, ids in zip(group, self.merge_all([parts[k] for k in group]), strict=True):
                out[k] = ids
        return [x if x is not None else self.encode_part(p) for x, p in zip(out, parts, strict=True)]

    def learn(self, new: list[str]) -> None:
        """Encodes parts, decodes them, and checks both against the library."""
        marked = [p.replace(" ", MARK) for p in new]
        ids = self.encode_parts(marked)
        said = self.said.__getitem__
        # parts in a row are a text again, in which the library must find the same ids; those without a mark of
        # their own are put after a line's end, as they stand in texts
        text, want, shown = [], [], []
        for name, p, mine in zip(new, marked, ids, strict=True):
            self.held[name] = ",".join(map(said, mine))
            back = self.decode(mine, first=False)
            if back != p.replace(MARK, " "):
                self.odd[name] = back
            if p[0] != MARK:
                text.append("\n")
                want += self.spell("\n")
                shown.append("\n")
            elif p.strip(MARK) == "":
                # only marks: a new line ends it, else the next part's marks would count to it
                text.append(p + "\n")
                want += mine + self.spell("\n")
                shown.append(back + "\n")
                continue
            text.append(p)
            want += mine
            shown.append(back)
        theirs = self.library.encode("".join(["a", *text]).replace(MARK, " "), num_threads=1)
        back = self.library.decode(theirs)
        if theirs != self.encode_part(MARK + "a") + want or back != "a" + "".join(shown):
            odd = [p for p, mine in zip(marked, ids, strict=True) if self.library.encode(("a\n" + p).replace(MARK, " ")) != self.encode_part(MARK + "a") + self.spell("\n") + mine]
            raise ValueError(f"encoding differs from the library's: {odd[:5]!r}")

    def digests(self, texts: list) -> dict:
        """For each text: the number of its ids, and the SHA-256 of the ids and of the decoded text."""
        out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        split = [self.parts(t or "") for t in texts]
        held = self.held
        every = set().union(*split)
        new = every.difference(held)
        self.again |= every - new
        if new and len(held) + len(new) > HELD:
            # parts that came again stay, unless they alone are too many
            stay = self.again if len(self.again) <= HELD // 2 else every - new
            old = {p: held[p] for p in stay}
            held.clear()
            held.update(old)
            self.odd = {p: t for p, t in self.odd.items() if p in held}
            self.again.clear()
            new = every.difference(held)
        if new:
            self.learn(list(new))
        for text, parts in zip(texts, split, strict=True):
            line = ",".join(map(held.__getitem__, parts))
            if self.odd and not self.odd.keys().isdisjoint(parts):
                shown = "".join(self.odd.get(p) or p.replace(MARK, " ") for p in parts)[1:]
            else:
                shown = (text or "").replace(MARK, " ")
            out["n_tokens"].append(line.count(",") + 1 if line else 0)
            out["ids_sha256"].append(hashlib.sha256(line.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
        return out


def _text(raw: bytearray) -> str:
    """Bytes as text; each byte that starts no valid sequence is U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def loaded(model: bytes) -> Pieces:
    """The vocabulary of a model, read once a worker."""
    return kept(hashlib.sha256(model).hexdigest(), lambda: Pieces(model))


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row. The file is read on the driver and sent along."""
    with open(path, "rb") as f:
        model = f.read()

    def make():
        return loaded(model).digests

    return docs.select("doc_id", over_texts(make, "n_tokens long, ids_sha256 string, decoded_sha256 string", "text").alias("r")).select("doc_id", "r.*")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every row."""
    with open(path, "rb") as f:
        model = f.read()

    def make():
        p = loaded(model)

        def f(texts: list) -> dict:
            ids = [p.encode(t) for t in texts]
            return {"ids": ids, "decoded": [p.decode(x) for x in ids]}

        return f

    return docs.select("doc_id", over_texts(make, "ids array<int>, decoded string", "text").alias("r")).select("doc_id", F.col("r.ids"), F.col("r.decoded"))
