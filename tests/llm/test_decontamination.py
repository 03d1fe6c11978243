"""Decontamination against looking up every window, and the suffix array
against sorting."""

import hashlib
import random
import re

import numpy as np
import pytest

from fathom.llm import decontamination as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    at = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            at.setdefault(tuple(w[i:i + window]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in at}:
            for i in range(len(w) - n + 1):
                if (own := at.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def compare(docs, tests, **options):
    got = [tuple(r[c] for c in COLUMNS) for r in D.contamination_report(docs, tests, **options).collect()]
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in tests.select("item_id", "text").collect()])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 60])
def test_like_brute_force(spark, odd, table, block_words):
    texts = [r["text"] for r in odd.select("text").collect() if r["text"]]
    items = [(i, " ".join(words(t)[5 * i:5 * i + 25])) for i, t in enumerate(texts[:20])]
    items += [(50, "one"), (51, "one two"), (50, "other words"), (52, None), (53, "  "), (54, items[0][1]), (55, items[0][1][:60])]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = compare(odd, tests, block_words=block_words)
    assert any(r[5] for r in got) and not all(r[5] for r in got)
    left = D.drop_contaminated(odd, tests)
    assert left.columns == odd.columns and left.count() == sum(not r[5] for r in got)


def test_tables(table):
    assert any(r[5] for r in compare(table("documents"), table("benchmark")))


def longest(text, items):
    """Words and first place of the longest run of words that an item holds."""
    w, best, at = words(text), 0, None
    every = [f" {' '.join(words(t))} " for _, t in items]
    for i in range(len(w)):
        while i + best < len(w) and any(f" {' '.join(w[i:i + best + 1])} " in e for e in every):
            best, at = best + 1, i
    return best, at


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 30])
def test_every_document_has_its_longest_match(spark, block_words):
    rng = random.Random(8)
    make = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, make(25)) for i in range(6)] + [(9, None), (10, "")]
    rows = [(i, make(rng.randrange(40))) for i in range(60)] + [(70 + i, "zz " * i + items[0][1][:2 * i + 9] + " zz") for i in range(8)]
    rows += [(90, items[1][1]), (91, items[1][1]), (92, None), (93, ""), (94, "zz zz"), (95, items[2][1] + " zz " + items[2][1])]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["longest_match"], r["longest_at"]) for r in D.contamination_report(docs, tests, block_words=block_words).collect()}
    assert got == {i: longest(t, items) for i, t in rows}


def test_empty_tables(none, odd, spark):
    tests = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert D.contamination_report(none, tests).collect() == []
    assert not any(r["contaminated"] for r in D.contamination_report(odd, tests.where("false")).collect())


def test_suffix_array_and_longest_matches():
    rng = random.Random(5)
    for alphabet in (2, 5, 400):
        docs = [[rng.randrange(alphabet) for _ in range(rng.randrange(60))] for _ in range(12)]
        docs += docs[:3]
        items = [(i, [str(rng.randrange(alphabet)).encode() for _ in range(30)]) for i in range(4)]
        items += [(9, [str(x).encode() for x in docs[0][3:40]])]
        block = D.build_block(items, 10)
        ids = [np.array([block.vocabulary.get(str(x).encode(), D.BREAK) for x in d], np.int64) for d in docs]
        shard = D.Shard(ids, block)
        def suffix(p):
            end = p
            while shard.tokens[end] >= D.FIRST:
                end += 1
            return shard.tokens[p:end].tolist()[:block.longest]
        order = [suffix(p) for p in shard.order]
        assert order == sorted(order) and len(order) == (shard.tokens >= D.FIRST).sum()
        best, place = shard.longest_matches(shard.search())
        for s, (start, n) in enumerate(zip(block.starts, block.sizes)):
            own = block.tokens[start:start + n].tolist()
            want = max((next((k for k in range(min(len(x), n)) if x[k] != own[k]), min(len(x), n)) for x in order), default=0)
            assert best[s] == want and (want == 0 or suffix(place[s])[:want] == own[:want])
