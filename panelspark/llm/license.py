"""Licence detection by ordered signature rules.

A text is reduced to its lower-cased words. Base: the places where the words of a few phrases stand in a row.
Beyond that, some hundreds of hand-written patterns name licences. A pattern is tried only on texts that hold all
the keywords of one of its spellings (``gates``). Detections are taken by priority (kind of rule), then length, then place, then order of
writing; one that lies within a detection already taken is suppressed, others stay even if they overlap.

Results in odd cases: null texts count as empty (no words, no labels, score 0); texts of any length are read whole;
repeated rows are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from re import _parser

import numpy as np
from pyspark.sql import DataFrame

from .common import kept, over_texts
from .license_rules import KINDS, rules

#: The base phrases.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: What a base phrase alone is worth.
BASE_SCORE = 0.5

_SPACE = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for c in range(256))


#: Stands for a character that a pattern leaves open.
OPEN = "\0"


def spellings(pattern: str) -> set[str]:
    """What a rule's pattern can match: every branch, with and without every optional part; open words are ``OPEN``."""

    def of(nodes) -> set[str]:
        found = {""}
        for op, value in nodes:
            kind = str(op)
            if kind == "LITERAL":
                own = {chr(value)}
            elif kind == "IN":
                own = {chr(x) for o, x in value if str(o) == "LITERAL"} if all(str(o) == "LITERAL" for o, _ in value) else {OPEN}
            elif kind == "BRANCH":
                own = set().union(*map(of, value[1]))
            elif kind == "SUBPATTERN":
                own = of(value[-1])
            elif kind == "MAX_REPEAT":
                least, most, part = value
                own = ({""} if not least else set()) | of(part) if most else {""}
            elif kind in ("ASSERT", "ASSERT_NOT", "AT"):
                own = {""}
            else:
                raise ValueError(f"no spellings of {kind} in {pattern}")
            found = {a + b for a in found for b in own}
        return found

    # words of a text are never empty, so no match has two blanks in a row
    return {x for x in of(_parser.parse(pattern)) if "  " not in x and x == x.strip()}


def gates(words: tuple[str, ...], pattern: str) -> list[frozenset]:
    """Sets of words of which one occurs whole in every match: the rule's keywords for spellings that hold them,
    else what such a spelling has of them and of the other forms of 'license', else all of its words."""
    found = set()
    for x in spellings(pattern):
        own = frozenset(w for w in x.split() if OPEN not in w)
        some = own & {*words, "license", "licence", "licenses", "licences"}
        found.add(frozenset(words) if own.issuperset(words) else some if len(some) >= len(words) > 1 else own)
    return sorted((g for g in found if not any(other < g for other in found)), key=sorted)


def _blanks(line: str) -> np.ndarray:
    """The places of the blanks of a line, so that words before a place are counted by a search."""
    return np.fromiter((m.start() for m in re.finditer(" ", line)), np.int64)


class Scanner:
    def __init__(self):
        self.rules = [(label, *KINDS[kind], gates(words, pattern), re.compile(rf"(?<= )(?:{pattern})(?= )")) for label, kind, words, pattern in rules()]
        self.keys: dict[str, list[tuple[int, frozenset]]] = {}
        for k, (*_, every, _) in enumerate(self.rules):
            for gate in every:
                # gated by its longest keyword first: the rarest, mostly
                self.keys.setdefault(max(sorted(gate), key=len), []).append((k, gate))
        self.words = frozenset(self.keys)
        self.wanted = frozenset(w.encode() for *_, every, _ in self.rules for g in every for w in g) | {b"license"}

    def words_of(self, text: str | None) -> list[bytes]:
        return (text or "").encode().lower().translate(_SPACE).split()

    def base(self, line: str) -> list[tuple[int, str]]:
        """(place, label) of every base phrase in a line of words with a blank before and after each."""
        blanks, found = _blanks(line), []
        for phrase, label in PHRASES.items():
            at = line.find(f" {phrase} ")
            while at >= 0:
                found.append((int(np.searchsorted(blanks, at)), label))
                at = line.find(f" {phrase} ", at + 1)
        return sorted(found)

    def detect(self, line: str, have: frozenset) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, label, confidence) of what is not suppressed, by place."""
        hits, blanks = [], _blanks(line)
        for k in {k for key in self.words & have for k, gate in self.keys[key] if gate <= have}:
            label, priority, sure, _, pattern = self.rules[k]
            for m in pattern.finditer(line):
                hits.append((-priority, -(m[0].count(" ") + 1), int(np.searchsorted(blanks, m.start())) - 1, k, label, sure))
        starts = sorted({h[2] for h in hits})
        place = {x: i for i, x in enumerate(starts)}
        # furthest end of what is taken, by ranges of starts (a Fenwick tree)
        reach, taken = [0] * (len(starts) + 1), []
        for _, size, start, _, label, sure in sorted(hits):
            end, i = start - size, place[start] + 1
            furthest = 0
            while i:
                furthest = max(furthest, reach[i])
                i &= i - 1
            if furthest >= end:
                continue
            taken.append((start, end, label, sure))
            i = place[start] + 1
            while i < len(reach):
                reach[i] = max(reach[i], end)
                i += i & -i
        return sorted(taken)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Number of words, base places, and detections of a text."""
        words = self.words_of(text)
        # as text only for what can hit, which is seldom
        have = frozenset(x.decode("ascii") for x in self.wanted.intersection(words))
        if not self.words & have and "license" not in have:
            return len(words), [], []
        line = f" {b' '.join(words).decode()} "
        return len(words), self.base(line) if "license" in have else [], self.detect(line, have)


def _scanner() -> Scanner:
    return kept("license rules", Scanner)


def detections(docs: DataFrame) -> DataFrame:
    """doc_id and the array of detections (first, after, label, confidence; in words) of every row."""

    def make():
        s = _scanner()
        return lambda texts: {"found": [[{"first": a, "after": b, "label": x, "confidence": c} for a, b, x, c in s.scan(t)[2]] for t in texts]}

    return docs.select("doc_id", over_texts(make, "found array<struct<first:long,after:long,label:string,confidence:double>>", "text").alias("r")).select("doc_id", "r.found")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""

    def make():
        s = _scanner()

        def f(texts: list) -> dict:
            out: dict = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for text in texts:
                n, base, found = s.scan(text)
                labels = {x for _, x in base}
                out["n_words"].append(n)
                out["n_base"].append(len(base))
                out["first_word"].append(base[0][0] if base else None)
                out["last_word"].append(base[-1][0] if base else None)
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | {x for *_, x, _ in found})))
                out["score"].append(max([BASE_SCORE] * bool(base) + [c for *_, c in found], default=0.0))
            return out

        return f

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", over_texts(make, schema, "text").alias("r")).select("doc_id", "r.*")
