"""SimHash near-dedup: the Golay keys' guarantee, and links and components
against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from fathom.llm import simhash as S


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_roots(values, bits=2):
    root = {v: v for v in values}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    values = sorted(set(values))
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_two_words_two_bits_apart_share_a_key():
    rng = random.Random(1)
    for _ in range(300):
        w = rng.getrandbits(23)
        for n in (0, 1, 2):
            other = w
            for b in rng.sample(range(23), n):
                other ^= 1 << b
            a, c = S.segment_keys(np.array([w, other]))
            assert set(a) & set(c)
            assert len(a) in (1, 6)


@pytest.mark.parametrize("bucket", [1, 4, 32])
def test_components_like_all_pairs(spark, bucket):
    rng = random.Random(bucket)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = set(centres)
    for c in centres[:3]:
        x = c
        for _ in range(60):     # a chain of one- and two-bit steps, and a cloud
            x ^= 1 << rng.randrange(64)
            fps.add(x if rng.random() < 0.5 else c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "_fp long")
    for bits in (2, 1, 0):
        want = brute_roots(list(fps), bits)
        got = {r["node"] % (1 << 64): r["root"] for r in S.components(S.fingerprint_links(df, bits, bucket)).collect()}
        groups = {}
        for f, r in want.items():
            groups.setdefault(r, set()).add(f)
        mine = {}
        for f in fps:
            mine.setdefault(got.get(f, ("alone", f)), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_documents_like_brute_force(odd, table):
    for docs in (odd, table("documents")):
        rows = docs.select("doc_id", "text").collect()
        fp = [brute_fingerprint(r["text"]) for r in rows]
        roots = brute_roots(fp)
        least = {}
        for r, f in zip(rows, fp):
            if r["doc_id"] is not None:
                least[roots[f]] = min(least.get(roots[f], r["doc_id"]), r["doc_id"])
        want = sorted(((r["doc_id"], f"{f:016x}", least.get(roots[f])) for r, f in zip(rows, fp)), key=repr)
        got = S.near_duplicates(docs).collect()
        assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == want
        kept = S.keep_one(docs)
        assert kept.columns == docs.columns
        assert kept.count() == len(set(roots.values())) == sum(r["keep"] for r in got)


def test_empty_table(none):
    assert S.near_duplicates(none).collect() == [] and S.keep_one(none).collect() == []
