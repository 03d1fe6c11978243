"""Context-tree weighting against the sequential recursion, and the base
model against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import lm_scoring as M


class BruteTree:
    """The recursion Pw = (Pe + product of Pw) / 2, decision by decision."""

    def __init__(self, texts, depth):
        self.n, self.children, self.depth = Counter(), {}, depth
        for t in texts:
            for path, node, b in self.turns(t):
                for c in path:
                    self.n[c, node, b] += 1
                for c, longer in zip(path, path[1:]):
                    self.children.setdefault((c, node), set()).add(longer)

    def turns(self, t):
        """(contexts from the empty one on, node, turn) of every decision."""
        s = b"\xff" * self.depth + t + b"\xff"
        for i in range(self.depth, len(s)):
            path, node = [s[i - k:i] for k in range(self.depth + 1)], 1
            for bit in range(7, -1, -1):
                b = s[i] >> bit & 1
                yield path, node, b
                node = 2 * node + b

    def pe(self, c, node):
        a, b = self.n[c, node, 0], self.n[c, node, 1]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(self, c, node):
        if (c, node) not in self.children:
            return self.pe(c, node)
        return np.logaddexp(self.pe(c, node), sum(self.pw(x, node) for x in self.children[c, node])) - math.log(2)

    def p(self, path, node, b):
        c = path[0]
        kt = (self.n[c, node, b] + .5) / (self.n[c, node, 0] + self.n[c, node, 1] + 1)
        if len(path) == 1:
            return kt
        stop = math.exp(self.pe(c, node) - math.log(2) - self.pw(c, node)) if self.n[c, node, 0] + self.n[c, node, 1] else .5
        return stop * kt + (1 - stop) * self.p(path[1:], node, b)

    def score(self, t):
        return sum(math.log10(self.p(path, node, b)) for path, node, b in self.turns(t))


TEXTS = ["abab", "", None, "ab cab", "É", "abab abab", "xbab", "zz cab " * 3, "abab", "q" * 40]


@pytest.mark.parametrize(("depth", "head"), [(3, 1 << 20), (5, 1 << 20), (5, 0), (6, 12)])
def test_scores_like_the_recursion(spark, monkeypatch, depth, head):
    """With all grams broadcast, none, and some, in many buckets."""
    monkeypatch.setattr(M, "SLICE", 4 if head < 1 << 20 else 1 << 16)    # read on the driver
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    brute = BruteTree([(t or "").encode().lower() for t in TEXTS[:5]], depth)
    rows = M.score_documents(docs, F.col("doc_id") >= 5, depth=depth, head_grams=head).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        t = (TEXTS[r["doc_id"]] or "").encode().lower()
        assert abs(r["score"] - brute.score(t)) < 1e-6
        assert r["bits_per_byte"] is None if not t else abs(r["bits_per_byte"] + r["score"] / math.log10(2) / len(t)) < 1e-9


@pytest.mark.parametrize("piece", [1, 7, 1 << 21])
def test_grams_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(M, "PIECE", piece)
    texts = [b"abc", b"", b"a longer text"]
    got = [(int(i), int(g)) for of, grams in M.text_grams(texts, 5) for i, g in zip(of, grams)]
    padded = [b"\xff" * 5 + t + b"\xff" for t in texts]
    assert got == [(i, int.from_bytes(s[at - 5:at][::-1] + s[at:at + 1])) for i, s in enumerate(padded) for at in range(5, len(s))]


def test_slices_keep_contexts_of_three_bytes(monkeypatch):
    monkeypatch.setattr(M, "SLICE", 3)
    grams = np.array([c << 24 | i for c, n in ((1, 2), (2, 5), (3, 1), (4, 9)) for i in range(n)])
    cuts = list(M.slices(grams, 5))
    assert [c.stop for c in cuts[:-1]] == [c.start for c in cuts[1:]] and cuts[0].start == 0 and cuts[-1].stop == len(grams)
    tops = [set((grams[c] >> 24).tolist()) for c in cuts]
    assert len(cuts) > 1 and sum(map(len, tops)) == 4


def test_bytes_sum_to_one(spark):
    """All 256 next bytes of a context, scored without being learned."""
    counts = [(int.from_bytes(b"the q"[::-1]) << 8 | b, 3 * (b in b"ux"), 3 * (b in b"ux") + 1) for b in range(256)]
    counts += [(int.from_bytes(b"ooo q"[::-1]) << 8 | ord("a"), 9, 9), (int.from_bytes(b"the z"[::-1]) << 8 | ord("b"), 2, 2)]
    logs = M.fit_grams(spark.createDataFrame(counts, "gram long, n long, m long")).collect()
    own = [r["log"] for r in logs if r["gram"] >> 8 == int.from_bytes(b"the q"[::-1])]
    assert len(own) == 256 and abs(sum(10.0 ** x for x in own) - 1) < 1e-9


def test_depth_out_of_range(none):
    with pytest.raises(ValueError, match="depth"):
        M.score_documents(none, F.lit(False), depth=7)


def test_same_scores_with_other_partitions(table):
    docs = table("documents").select("doc_id", "text")
    runs = [sorted(map(tuple, M.score_documents(docs.repartition(n), F.col("doc_id") % 5 == 0, head_tokens=50, head_grams=2000).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


def brute_base(rows):
    held = {i: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for i, r in enumerate(rows)}
    words = [[*(r["text"] or "").encode().lower().split(), None] for r in rows]
    c = Counter(w for i, ws in enumerate(words) if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(r["doc_id"], held[i], len(words[i]), sum(c[w] > 0 for w in words[i]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i])) for i, r in enumerate(rows)]


@pytest.mark.parametrize("head", [0, 20, M.HEAD_TOKENS])
def test_base_like_brute_force(odd, table, head):
    for docs in (odd, table("documents")):
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
        got = [tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in M.score_documents(docs, held, head_tokens=head).collect()]
        want = brute_base(docs.select("doc_id", "text").collect())
        key = lambda r: repr((*r[:5], round(r[5], 6)))
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6


def test_scores_are_better_than_uniform(table):
    docs = table("documents")
    rows = {r["doc_id"]: len(r["text"].encode()) + 1 for r in docs.collect()}
    got = M.score_documents(docs, F.col("doc_id") % 5 == 0).collect()
    own = [r for r in got if r["held_out"]]
    assert sum(-r["score"] for r in own) / math.log10(2) < 4 * sum(rows[r["doc_id"]] for r in own)     # bits a byte


def test_no_rows_and_none_to_learn_from(none, spark):
    assert M.score_documents(none, F.lit(False)).collect() == []
    r = M.score_documents(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(True)).first()
    assert abs(r["score"] - 3 * math.log10(1 / 256)) < 1e-5 and r["n_known"] == 0 and r["base_score"] == 0
