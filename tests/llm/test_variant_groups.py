"""Spelling variants against comparing all pairs of words in Python."""

import random
import re
import zlib
from collections import Counter

from fathom.llm import variant_groups as V

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    near = {w: [x for x in counts if is_near(w, x)] for w in counts}
    best = {w: min(xs, key=lambda x: (-counts[x], x)) for w, xs in near.items() if xs}
    form = {w: b for w, b in best.items() if counts[b] >= 10 * counts[w]}
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def as_set(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_texts_like_all_pairs(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7, 10))) for _ in range(25)]

    def variant(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:i] + w[i + 1:], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1:]])
    rows = [(i if i % 9 else None, " ".join(variant(rng.choice(stems)).upper() if i % 5 == 0 else variant(rng.choice(stems)) for _ in range(40)))
            for i in range(60)] + [(7, None), (8, ""), (9, "x"), (61, "aaaaaaaaa, aaaaaaaa! aaaaaaaa-aaaaaaaaa; aaaaaaaaaa aaaaaaaaaa")]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string").repartition(5)
    assert as_set(V.group_variants(docs)) == brute(brute_counts(rows))


def test_words_over_many_ranges(spark, monkeypatch):
    """Cuts between ranges run through the tries; chains of three forms."""
    rng = random.Random(5)
    monkeypatch.setattr(V, "RANGE_WORDS", 7)
    monkeypatch.setattr(V, "SAMPLE_PER_RANGE", 3)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 8))): rng.choice([2, 3, 20, 30, 400, 5000]) for _ in range(150)}
    counts |= {"zzzzzzz": 2, "zzzzzzy": 20, "zzzzzxy": 200, "zzzzwxy": 2000, "b" * 40_000: 2, "b" * 40_001: 60, "ÿ" * 9: 3, "a": 9}
    got = as_set(V.group_words(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)))
    assert got == brute(counts)
    assert ("zzzzzzz", "zzzzzzy", "zzzzwxy", 2, 1, 20) in got


def test_odd_and_empty(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert as_set(V.group_variants(odd)) == brute(brute_counts(rows))
    assert V.group_variants(none).collect() == []


def test_very_long_text_and_hot_word(spark):
    rows = [(1, "thousand " * 300_000 + "thousend thousend"), *[(i, "thousand") for i in range(2, 400)]]
    got = as_set(V.group_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(brute_counts(rows))
