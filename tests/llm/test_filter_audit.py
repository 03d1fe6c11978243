"""Filter audit against applying every order to every document."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from fathom.llm import filter_audit as A


def failures(rows):
    out = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        first = min((j for j, x, _ in rows if (x or "") == t and j is not None), default=None)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
               "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first < i}
        out.append((i, lang or "", {k for k, v in bad.items() if v}))
    return out


def brute(rows, labels):
    found = failures(rows)
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    out, removed_in = {}, {}
    for part in {p for _, p, _ in found}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in found if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                out[part, order, step] = [len(left), len(here), sum(letter in f for _, f in gone),
                                          sum(f == {letter} for _, p, f in found if p == part),
                                          sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
                gone += here
                removed_in[part, letter] = removed_in.get((part, letter), 0) + len(here)
    return {(*k, *v, removed_in[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_set(df):
    got = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def sample(rng):
    words = ["ab", "CD", "e#", "é", "x", "Y", "q9", "longer"]
    many = " ".join(f"w{k}" for k in range(120))
    rows = [(i if i % 11 else None, rng.choice([None, "", many, many + " X", many.upper(), "w " * 120, " ".join(rng.choices(words, k=rng.randrange(150)))]),
             rng.choice(["en", "de", None, ""])) for i in range(90)]
    rows += [(3, many, "en"), (3, many, "de"), (200, many + "😀" * 50, "fr")]
    labels = [(rng.randrange(95), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(70)] + [(None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_like_applying_every_order(spark, seed):
    rows, labels = sample(random.Random(seed))
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, lang string, n long, _id string").repartition(4)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert as_set(A.audit(docs, marks)) == brute(rows, labels)


def test_odd_and_empty(spark, odd, none):
    marks = spark.createDataFrame([(1, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert as_set(A.audit(odd, marks)) == brute(rows, [(1, 1, 0), (8, 0, 1)])
    assert as_set(A.audit(odd, marks.limit(0))) == brute(rows, [])
    assert A.audit(none, marks).collect() == []


def plain_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return [len(w), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text)), len(text), len(set(w))]


def test_transducer_like_expressions(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab A#é€😀\t\n\x0b\x1c\xa0") for _ in range(rng.randrange(60))) for _ in range(500)] + ["", "x" * 300 + " y " + "é" * 300 + " x"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    assert A.block_counts(np.frombuffer(b"".join(raw), np.uint8), bounds).tolist() == [plain_counts(t) for t in texts]
    monkeypatch.setattr(A, "BLOCK", 50)     # every text in pieces, some of them one word
    assert [A.long_counts(b).tolist() for b in raw] == [plain_counts(t) for t in texts]


def test_equal_keys_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(A, "POWERS", np.zeros(16, np.uint64))       # every word has the same key
    text = b"aa bb aa cc bb aa dd"
    assert A.block_counts(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist() == [[7, 0, 0, 20, 4]]


def test_very_long_text(spark):
    text = "word other " * 400_000 + "A" * 300_000
    got = A.text_counts(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    assert [got[c] for c in ("n_words", "n_capitals", "n_symbols", "n_points", "n_distinct")] == [800_001, 300_000, 0, len(text), 3]
