"""License scan against plain searches for the phrases."""

import random
import re

import pytest

from fathom.llm import license_scan as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def check(df, docs):
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_base"], r["first_word"] if r["n_base"] else None, r["last_word"] if r["n_base"] else None, r["base_labels"]) for r in df.collect())
    want = sorted((r["doc_id"] or -1, *brute(r["text"])) for r in docs.collect())
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_base_columns_like_brute_force(odd, table):
    for docs in (odd, table("documents")):
        check(L.scan_documents(docs), docs)


@pytest.mark.parametrize("text, labels, full", [
    ("x Licensed under the Apache License, Version 2.0. y", "apache-2.0", True),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0", True),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0", True),
    ("it was released with the mit license", "mit", False),
    ("cc by cc by", "cc-by", True),
    ("the license of the version", "", None),
    ("public general license, rights all reserved", "", None),
    (None, "", None), ("", "", None),
])
def test_labels_and_score(spark, text, labels, full):
    r = L.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == labels
    assert r["score"] == 0 if full is None else (r["score"] == 1) is full and 0 < r["score"] <= 1


def test_rarest_word_decides_only_the_order():
    text = b"all rights reserved by all under all rights reserved".split()
    for idf in ({}, {b"all": 9.0}, {b"rights": 9.0}, {b"reserved": 9.0, b"all": 1.0}):
        index = L.Index(L.BASE_TEMPLATES, idf)
        assert [m.start for m in index.scan(text)] == [0, 6]


@pytest.mark.parametrize("changed", ["obtaining associated documentation", "any to a copy", "files documentation software associated"])
def test_any_changed_words_a_template_tolerates(changed):
    mit = next(t for t in L.NOTICE_TEMPLATES if t.text.startswith("Permission is hereby granted"))
    text = [b"xyz" if w in changed.encode().split() else w for w in mit.words]
    for idf in ({}, {w: 9.0 for w in changed.encode().split()}, {w: float(i) for i, w in enumerate(mit.words)}):
        for before in (0, 2):
            found = L.Index((mit,), idf).scan([b"x"] * before + text + [b"y"])
            assert [(m.start, round(m.coverage * 20)) for m in found] == [(before, 20 - text.count(b"xyz"))]


def tried_everywhere(template, words):
    """The rule, without an index: (start, coverage) of a template's matches."""
    own, found = template.words, {}
    shift = L.SHIFT if template.key_phrases else 0
    spare = int((1 - template.min_coverage) * len(own) + 1e-9) if template.key_phrases else 0
    at = lambda p: words[p] if 0 <= p < len(words) else None
    for start in range(-len(own) - shift, len(words) + shift):
        near = [any(at(start + k + d) == w for d in range(-shift, shift + 1)) for k, w in enumerate(own)]
        missing = near.count(False)
        moved = sum(x and at(start + k) != own[k] for k, x in enumerate(near))
        if missing <= spare and any(near):
            found[start] = (missing, moved, start)
    kept = []
    for start in sorted(found, key=found.get):
        if all(abs(start - other) > shift for other in kept):
            kept.append(start)
    joined = lambda a, b: b" " + b" ".join(words[max(0, a):max(0, b)]) + b" "
    has = lambda s: all(b" " + b" ".join(L.alnum_words(p)) + b" " in joined(s - shift, s + len(own) + shift) for p in template.key_phrases or (template.text,))
    return sorted((s, round(1 - found[s][0] / len(own), 9)) for s in kept if has(s))


def test_every_template_like_trying_every_place():
    rng = random.Random(5)
    templates = L.NOTICE_TEMPLATES + L.BASE_TEMPLATES
    words = [t.words for t in templates]
    n = 0
    for _ in range(300):
        text = [b"x"] * rng.randrange(3)
        for own in rng.choices(words, k=2):
            for w in own:
                x = rng.random()    # kept, changed, dropped, or one inserted before it
                text += [w] if x > 0.12 else [b"xyz"] if x > 0.08 else [] if x > 0.04 else [b"xyz", w]
        index = L.Index(templates, {w: rng.random() for own in words for w in own if rng.random() > 0.1})
        want = sorted((t.label, t.text, *m) for t in templates for m in tried_everywhere(t, text))
        assert sorted((m.template.label, m.template.text, m.start, round(m.coverage, 9)) for m in index.scan(text)) == want
        n += len(want)
    assert n > 300


def test_whole_table_like_trying_every_place(odd, table):
    templates = L.BASE_TEMPLATES + L.NOTICE_TEMPLATES
    for docs in (odd.where("length(text) < 5000"), table("documents").where("length(text) < 3000")):
        want = []
        for r in docs.collect():
            w = L.alnum_words(r["text"])
            found = [(t.label, c) for t in templates if set(t.words) & set(w) for _, c in tried_everywhere(t, w)]
            want.append((r["doc_id"] or -1, ",".join(sorted({x for x, _ in found})), max((c for _, c in found), default=0.0)))
        got = [(r["doc_id"] or -1, r["labels"], round(r["score"], 9)) for r in L.scan_documents(docs).collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("text, label", [
    ("Permission is hereby granted, free of charge, to any and every person obtaining a copy of this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or modification, are permitted", "bsd"),
])
def test_inserted_and_dropped_words(spark, text, label):
    r = L.scan_documents(spark.createDataFrame([(1, "x y " + text + " z")], "doc_id long, text string")).first()
    assert r["labels"] == label and len(r["matches"]) == 1 and r["score"] > 0.9


def test_empty_table(none):
    assert L.scan_documents(none).collect() == []
