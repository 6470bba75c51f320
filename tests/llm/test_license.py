import random
import re

from panelspark.llm import license as lic
from panelspark.llm.license_rules import KINDS, rules

SCHEMA = "doc_id long, text string, labels string, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in lic.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def labels(text):
    return [x for *_, x, _ in lic.Scanner().scan(text)[2]]


def test_rules_are_hundreds_and_sound():
    every = rules()
    assert len(every) >= 200 and len({r[0] for r in every}) >= 80
    for label, kind, words, pattern in every:
        assert kind in KINDS and words and label == label.strip()
        re.compile(pattern)


def test_base_against_brute_force():
    rnd = random.Random(6)
    bits = ["mit", "MIT", "license", "License", "apache", "general", "public", "-", ",", "\n", "é", "x1", "İ", "Kelvin K", "mit license", "\x7f", "_"]
    s = lic.Scanner()
    for _ in range(4000):
        text = rnd.choice(["", " "]).join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randrange(25)))
        n, base, _ = s.scan(text)
        assert (n, base) == brute(text), text


def test_detections():
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("This file is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0-or-later"]
    assert labels("see https://www.apache.org/licenses/LICENSE-2.0.html") == ["apache-2.0"]
    assert labels("Released under the MIT License. Fonts: SIL Open Font License 1.1") == ["mit", "ofl-1.1"]
    assert labels("er ging mit der Lizenz nach Hause; a license to kill") == []


def test_one_within_another_is_suppressed():
    s = lic.Scanner()
    words = "under the terms of the gnu lesser general public license version 2 1".split()
    found = s.detect(f" {' '.join(words)} ", frozenset(words))
    assert [x for *_, x, _ in found] == ["lgpl-2.1"]
    for i, a in enumerate(found):
        assert not any(j != i and b[0] <= a[0] and a[1] <= b[1] for j, b in enumerate(found))


def test_table(spark):
    rows = [(1, "MIT License and mit-license", "x", "y"), (2, None, None, None), (3, "", "", ""), (4, "word " * 50_000 + "apache license", "", ""), (1, "plain", "", ""), (None, "general public license", "", "")]
    got = lic.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        n, base = brute(t)
        want.append((i, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base}))))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(want, key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert lic.detections(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 3").first().found == []
    assert lic.digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_spelling_reaches_its_rule():
    s = lic.Scanner()
    for k, (label, _, words, pattern) in enumerate(rules()):
        for x in lic.spellings(pattern):
            line = " " + x.replace(lic.OPEN, "open") + " "
            if s.rules[k][-1].search(line):
                have = frozenset(line.split()) & {w.decode() for w in s.wanted}
                assert any(g <= have for g in s.rules[k][-2]) and s.scan(line)[2], (label, line)
    assert labels("Released under the MIT Licence") == ["mit"] and labels("the BSD Licence") == ["bsd"]
    assert labels("noncommercial purposes only") == labels("non-commercial use only") == ["non-commercial"]
    assert labels("FreeBSD license") == ["bsd-2-clause"] and labels("Mulan PSL v2") == ["mulan-psl-2.0"]


def test_many_notices_in_one_text():
    """A log of notices takes time in proportion, and each notice is found at its place."""
    import time

    s = lic.Scanner()
    notice = "Licensed under the MIT License and the Apache License version 2.0 or the GNU General Public License v3 or later. "
    one = s.scan(notice)
    began = time.perf_counter()
    n, base, found = s.scan(notice * 20_000)
    assert time.perf_counter() - began < 20
    assert n == 20_000 * one[0] and len(base) == 20_000 * len(one[1]) and base[-1][0] == one[1][-1][0] + 19_999 * one[0]
    inside = [(a % one[0], b - a, x) for a, b, x, _ in found if a // one[0] == (b - 1) // one[0]]
    assert {(a, b - a, x) for a, b, x, _ in one[2]} <= set(inside)


def test_suppression_against_every_pair():
    import random

    rnd = random.Random(4)
    s = lic.Scanner()
    words = "mit apache gnu general public license version 2 3 0 or later lesser bsd clause mozilla the under licensed".split()
    for _ in range(60):
        line = " " + " ".join(rnd.choice(words) for _ in range(400)) + " "
        have = frozenset(line.split())
        hits = []
        for k in {k for key in s.words & have for k, gate in s.keys[key] if gate <= have}:
            label, priority, sure, _, pattern = s.rules[k]
            hits += [(-priority, -(m[0].count(" ") + 1), line.count(" ", 0, m.start()) - 1, k, label, sure) for m in pattern.finditer(line)]
        taken = []
        for _, size, start, _, label, sure in sorted(hits):
            if not any(a <= start and start - size <= b for a, b, *_ in taken):
                taken.append((start, start - size, label, sure))
        assert s.detect(line, have) == sorted(taken)
