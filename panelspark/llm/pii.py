"""Personal data found by anchors: an Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and
identifier cues in one pass over a text, and a local parser for each kind expands the anchor both ways and
validates what it has found.

Base kinds, each with the spans of its pattern, leftmost and non-overlapping within the kind: ``email``, ``ip``
(four dotted numbers up to 255), ``card`` (14 to 19 digits that pass the Luhn test), ``phone`` (a plus sign and 10
to 15 digits). Further kinds, found at cues: ``iban`` (letters and check digits valid modulo 97, read whole
where they start within 45 code points of the cue), ``account``
(digits named by a cue as an account, a social security, tax or passport number), ``secret`` (a value named by a
cue as a key, token or password, of any length from 16 on, or from 4 on with a digit where a separator follows a
password's cue; shorter ones and words without a digit are not told from prose) and ``login`` (user and password before the host of an address). ``dial`` and
``pan`` are phone and card numbers in stretches that their patterns reject because more digits follow or precede.

Spans count code points, ends exclusive. Results in odd cases: null and empty texts have no spans; kinds may overlap
one another; texts of any length are read whole; repeated rows are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

KINDS = ("email", "ip", "card", "phone", "dial", "pan", "iban", "account", "secret", "login")
BASE = KINDS[:4]

# fixed values: cues of the further kinds, in lower case
ACCOUNT_CUES = ("account", "acct", "a/c", "ssn", "social security", "passport", "tax id", "konto", "cuenta", "compte", "routing", "driver license", "license no", "id number")
SECRET_CUES = ("token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "api key", "access_key", "private_key", "bearer")
PASSWORD_CUES = ("password", "passwd", "pwd", "secret")
IBAN_CUES = ("iban",)
#: An account number of a bank starts so many code points after its cue at most.
IBAN_WINDOW = 45
#: The least length of a secret, and of one that a password's cue and a separator announce.
SECRET_LEAST, PASSWORD_LEAST = 16, 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_SHAPES = ((4, 4, 4, 4), (4, 6, 5), (16,), (15,))
_DIAL = re.compile(r"[ ().0-9-]+")
_BANK = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NAMED = re.compile(r"[^0-9A-Za-z\n]{0,3}(?:(?:no|number|num|nr|id|is|#)[^0-9A-Za-z\n]{0,3}){0,2}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I)
_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
_VALUE = re.compile(r"[A-Za-z_]{0,6}\s{0,2}([:=]|=>|is)?\s{0,2}[\"']?([A-Za-z0-9+/_\-]+(?:\.[A-Za-z0-9+/_\-]+)*)")
_PASSWORD = re.compile(r"[A-Za-z_]{0,6}[\"']?\s{0,2}(?:=>|[:=])\s{0,2}[\"']?([^\s\"'<>]+)")
_LOGIN = re.compile(r"[A-Za-z0-9._~%+-]{1,64}:[^\s/@:\"'<>]{1,64}@")


def _automaton():
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c if c in "@+" else "digit", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("iban", IBAN_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


_ANCHORS = None


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _dial(run: str) -> int:
    """The length of the shortest start of a run that ends with a group of digits and has 10 to 15 of them."""
    count = 0
    for k, c in enumerate(run):
        count += c.isdigit()
        if count >= 10 and c.isdigit() and not run[k + 1 : k + 2].isdigit():
            return k + 1 if count <= 15 else 0
    return 0


def _cards(chain: str) -> list[tuple[int, int]]:
    """Card numbers made of whole groups of a chain: one group of 15 or 16 digits, or the usual groupings."""
    groups, out, k = [(m.start(), m.end()) for m in _GROUP.finditer(chain)], [], 0
    while k < len(groups):
        for shape in _SHAPES:
            part = groups[k : k + len(shape)]
            if tuple(b - a for a, b in part) == shape and luhn("".join(chain[a:b] for a, b in part)):
                out.append((part[0][0], part[-1][1]))
                k += len(shape) - 1
                break
        k += 1
    return out


def iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _secret(text: str, cue: int, at: int) -> tuple[int, int, int] | None:
    """(start, end, where reading stopped) of the value after a cue; the end is 0 where it is no secret."""
    if text[cue:at].lower() in PASSWORD_CUES and (m := _PASSWORD.match(text, at)):
        value = m[1].rstrip(".,;:!?)]}")
        if len(value) >= PASSWORD_LEAST and any(c.isdigit() for c in value):
            return m.start(1), m.start(1) + len(value), m.end(1)
    if not (m := _VALUE.match(text, at)):
        return None
    value = m[2]
    # without a separator one part has the length, so that names of hosts and files in prose are none
    size = len(value) if m[1] else max(map(len, value.split(".")))
    good = size >= SECRET_LEAST and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return m.start(2), m.end(2) if good else 0, m.end(2)


def _lower(text: str) -> str:
    """Lower case by code point: every letter stays at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data of a text, by start, then by kind as listed."""
    global _ANCHORS
    if not text:
        return []
    if _ANCHORS is None:
        _ANCHORS = _automaton()
    found: list[tuple[int, int, str]] = []
    mail_end = dots_end = chain_end = dial_end = value_end = bank_end = 0
    for end, (what, size) in _ANCHORS.iter(_lower(text)):
        at = end - size + 1
        if what == "digit":
            # the runs of digits and dots, and of digits, blanks and hyphens, that start here
            if at >= dots_end:
                m = _NUMBERS.match(text, at)
                dots_end = m.end()
                if "." in m[0]:
                    parts = m[0].split(".")
                    start = at
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        width = sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                            found.append((start, start + width, "ip"))
                        start += width + 1
            if at >= chain_end:
                m = _CHAIN.match(text, at)
                chain_end = m.end() if m else at + 1
                if m and chain_end - at >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((at, chain_end, "card"))
                    else:
                        found += [(at + a, at + b, "pan") for a, b in _cards(m[0])]
        elif what == "@":
            start = at
            while start > mail_end and text[start - 1] in _LOCAL:
                start -= 1
            m = _LABEL.match(text, at + 1) if start < at else None
            if m:
                mail_end = m.end()
                found.append((start, mail_end, "email"))
        elif what == "+":
            if at >= dial_end and "0" <= text[at + 1 : at + 2] <= "9" and text[at + 1 : at + 2].isascii():
                m = _DIAL.match(text, at + 2)
                stop = at + 2 + len(m[0].rstrip(" ().-")) if m else 0
                if stop > at + 3:
                    dial_end = stop
                    count = sum(c.isdigit() for c in text[at:stop])
                    if 10 <= count <= 15:
                        found.append((at, stop, "phone"))
                    elif count > 15 and (part := _dial(text[at:stop])):
                        found.append((at, at + part, "dial"))
        elif what == "account":
            if (m := _NAMED.match(text, end + 1)) and sum(c.isdigit() for c in m[1]) >= 6:
                found.append((m.start(1), m.end(1), "account"))
        elif what == "secret":
            # a cue within a value that was read to its end starts none of its own
            if end + 1 >= value_end:
                value = _secret(text, at, end + 1)
                if value:
                    start, stop, whole = value
                    value_end = whole
                    if stop:
                        found.append((start, stop, "secret"))
        elif what == "iban":
            for head in _HEAD.finditer(text, end + 1, end + 1 + IBAN_WINDOW + 3):
                if head.start() >= bank_end and (m := _BANK.match(text, head.start())):
                    stop = next((e for e in range(m.end(), m.start() + 14, -1) if text[e - 1] != " " and iban(text[m.start() : e])), 0)
                    if stop:
                        bank_end = stop
                        found.append((m.start(), stop, "iban"))
        elif m := _LOGIN.match(text, end + 1):
            found.append((m.start(), m.end() - 1, "login"))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[0], rank[s[2]], s[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redact(text: str | None) -> str | None:
    """The text with each stretch of personal data replaced by its kind in brackets; overlapping spans as one, named
    by the first."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans(text):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detected(docs: DataFrame) -> DataFrame:
    """doc_id and the array of spans (start, end, kind) of every row."""

    def make():
        return lambda texts: {"spans": [[{"start": a, "end": b, "kind": k} for a, b, k in spans(t)] for t in texts]}

    return docs.select("doc_id", over_texts(make, "spans array<struct<start:long,end:long,kind:string>>", "text").alias("r")).select("doc_id", "r.spans")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row."""

    def make():
        def f(texts: list) -> dict:
            every = [spans(t) for t in texts]
            base = [[s for s in x if s[2] in BASE] for x in every]
            out = {f"n_{k}": [sum(s[2] == k for s in x) for x in base] for k in BASE}
            return out | {"base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], "spans": [joined(x) for x in every]}

        return f

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", over_texts(make, schema, "text").alias("r")).select("doc_id", "r.*")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows with personal data replaced in ``text``, and ``n_chars`` counted anew where there is such a column."""

    def make():
        return lambda texts: {"text": [redact(t) for t in texts]}

    out = docs.withColumn("text", over_texts(make, "text string", "text")["text"])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
