import hashlib
import random
import re

from panelspark.llm import pii

SCHEMA = "doc_id long, text string, n_chars long, spans string, kind string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.BASE.index(s[2])))


def luhn(s):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(s[::-1])) % 10 == 0


def valid_card(rnd, n):
    body = "".join(rnd.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(8)
    bits = [*"@@..-- +()0123456789aZé_%\n", "x@y.zz", "1.2.3.4", "255", "256", "+1 (234) 567-8901", "+", "://", "İ", "ß", "４", "²", "token ", "account ", "iban "]
    for k in range(30_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))
        if k % 5 == 0:
            text += rnd.choice(["", " ", "-", "1"]) + valid_card(rnd, rnd.randrange(13, 21)) + rnd.choice(["", " ", ".5", "a"])
        assert [s for s in pii.spans(text) if s[2] in pii.BASE] == brute(text), text


def kinds(text):
    return [(text[a:b], k) for a, b, k in pii.spans(text) if k not in pii.BASE]


def test_further_kinds():
    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32, thanks") == [("GB82 WEST 1234 5698 7654 32", "iban")]
    assert kinds("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert kinds("Account number: 12345678 and SSN 123-45-6789.") == [("12345678", "account"), ("123-45-6789", "account")]
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == [("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "secret")]
    assert kinds("a token of thanks, password protected, on account of 12") == []
    assert kinds("see http://me:pw1@host.example/x") == [("me:pw1", "login")]


def test_redaction():
    assert pii.redact(None) is None and pii.redact("clean text") == "clean text"
    assert pii.redact("mail a@b.co now, 10.0.0.1!") == "mail [EMAIL] now, [IP]!"
    assert pii.redact("+1 (234) 567-8901 4111 1111 1111 1111") == "[DIAL] [PAN]"
    assert pii.redact("+1 (234) 567-8901 10.1.2.3") == "[DIAL] [IP]"


def test_table(spark):
    long = "word " * 30_000 + "a@b.co"
    rows = [(1, "mail a@b.co or +1 (234) 567-8901", 3, "s", "k"), (2, None, None, None, None), (3, "", 0, "", ""), (4, long, 1, "", ""), (1, "x", 1, "", ""), (None, "1.2.3.4", 7, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pii.digests(df).collect()
    assert len(got) == len(rows)
    want = sorted(((i, brute(t or "")) for i, t, *_ in rows), key=str)
    have = sorted(((r.doc_id, r) for r in got), key=lambda x: str((x[0], brute(next(t or "" for i, t, *_ in rows if i == x[0]) if x[0] != 1 else ""))))
    assert sorted(r.base_sha256 for _, r in have) == sorted(hashlib.sha256(pii.joined(b).encode()).hexdigest() for _, b in want)
    assert sorted(r.n_email for r in got) == sorted(sum(s[2] == "email" for s in b) for _, b in want)
    clean = {(r.doc_id, r.text, r.n_chars) for r in pii.redacted(df).collect() if r.doc_id in (None, 2, 3)}
    assert clean == {(None, "[IP]", 4), (2, None, None), (3, "", 0)}
    assert len(pii.detected(df).where("doc_id = 4").first().spans) == 1
    assert pii.digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_values_are_covered_whole():
    key = "a1B2" * 50
    assert kinds(f"token: {key}.") == [(key, "secret")] and kinds(f"api key {key}") == [(key, "secret")]
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    assert kinds(f"Bearer {jwt}, then") == [(jwt, "secret")]
    assert kinds("password: hunter2secret9") == [("hunter2secret9", "secret")] and kinds('pwd="p@ss1".') == [("p@ss1", "secret")]
    assert kinds("the password is long, secret 12345 and password: please") == []
    number = "GB82 WEST 1234 5698 7654 32"
    assert kinds(f"iban of the other recipient is {number}") == [(number, "iban")]
    assert kinds(f"IBAN GB83 WEST 1234 5698 or {number}") == [(number, "iban")]
    assert pii.redact(f"secret={key}{key}") == "secret=[SECRET]"


def test_many_cues_in_one_value_are_read_once():
    import time

    began = time.process_time()
    assert pii.spans("token" * 40_000) == []
    assert time.process_time() - began < 5
