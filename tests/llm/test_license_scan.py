import random
import re

import pytest

from panelweave.llm.license_scan import PHRASES, TEMPLATES, Scanner, compile_template, scan_licenses

SCHEMA = "doc_id long, text string, labels string, spans string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def accepts(template, ws):
    """Whether a whole list of words passes, by regular expression over joined words."""
    out = []
    for m in re.finditer(r"\[\[|\]\]|\{\{(\d+)\.\.(\d+)(?::([^}]*))?\}\}|[^\s\[\]{}]+", template):
        if m[0] == "[[":
            out.append("(?:")
        elif m[0] == "]]":
            out.append(")?")
        elif m[1]:
            out.append(f"(?:(?:{m[3] or '[^ ]+'}) ){{{m[1]},{m[2]}}}")
        else:
            out.append(re.escape(m[0]) + " ")
    return re.fullmatch("".join(out), "".join(w + " " for w in ws)) is not None


def test_automata_accept_what_the_markup_says():
    rng = random.Random(4)
    for template in ("a [[b]] c", "[[a [[b]]]] c {{1..3}} d", "{{0..2:[0-9]+}} x", "a {{1..1:b|c}} [[{{0..1}} d]]", "[[a]] [[a]] a"):
        a = compile_template(template)
        for _ in range(1500):
            ws = [rng.choice("abcdx19") for _ in range(rng.randrange(7))]
            ends = [k for k in range(len(ws) + 1) if accepts(template, ws[:k])]
            assert a.longest([w.encode() for w in ws], 0) == (max(ends) if ends else -1)
    for bad in ("a ]]", "[[ a"):
        with pytest.raises(ValueError):
            compile_template(bad)


def brute(text):
    ws = words(text)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(ws), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in at}))


TEXTS = [
    None, "", "...", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "MIT licenses mit LICENSE; Mit-License",
    "GNU  general\npublic\tlicense gnu general public", "cc by cc by", "émit license mit licensé", "mit " * 50000 + "license",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Licensed under the Apache License, Version 3.0",
]


def test_base_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = "GNU General public LICENSE apache cc by mit 4 the under . -".split()
    texts = TEXTS + [" ".join(rng.choices(vocab, k=40)) for _ in range(200)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, TEXTS[3], "x", "y"), (None, "mit license", None, None)]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_template_labels():
    scan = Scanner().scan
    want = {3: "mit,mit-notice", 4: "gpl,gpl-3.0-notice", 5: "cc-by,cc-by-nc-notice", 6: "apache,apache-2.0-notice", 12: "gpl,gpl-2.0-header", 13: "apache"}
    for i, labels in want.items():
        assert scan(TEXTS[i])[5] == labels


def sample(template, rng):
    """A text that the template accepts, with optional regions taken or left by chance."""
    out, depth, taken = [], 0, [True]
    for m in re.finditer(r"\[\[|\]\]|\{\{(\d+)\.\.(\d+)(?::([^}]*))?\}\}|[^\s\[\]{}]+", template):
        if m[0] == "[[":
            taken.append(taken[-1] and rng.random() < 0.5)
        elif m[0] == "]]":
            taken.pop()
        elif taken[-1]:
            word = "9" if m[3] and "0-9" in m[3] else (m[3] or "acme").split("|")[0]
            out += [word] * rng.randint(int(m[1]), int(m[2])) if m[1] else [m[0]]
    assert not depth
    return out


def test_each_wording_has_its_own_label_and_relatives_do_not():
    rng, scan = random.Random(3), Scanner().scan
    beside = {  # wordings that stand whole within another
        "apache-2.0-header": {"apache-2.0-notice"},
    }
    for label, template in TEMPLATES.items():
        for _ in range(4):
            ws = sample(template, rng)
            got = {x[2] for x in scan("before " + " ".join(w.title() for w in ws) + ". After")[7]}
            assert got == {label} | beside.get(label, set()), (label, got)
            # One mandatory word less: not accepted any more.
            plain = [w for w in re.sub(r"\[\[.*?\]\]", " ", re.sub(r"\[\[[^\[\]]*\]\]", " ", template)).split() if re.fullmatch("[a-z]{6,}", w)]
            if plain:
                word = rng.choice(plain)
                assert label not in {x[2] for x in scan(" ".join(w if w != word else "xx" for w in ws))[7]}, (label, word)
