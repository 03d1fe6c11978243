"""Packing: ids against the tokenizer, bins against their law."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fathom.llm import packing as P
from fathom.llm.queries import tokenizer_path


def brute_pieces(rows, capacity):
    t, out = Tokenizer.from_file(tokenizer_path()), []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            out.append((doc_id, i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_and_bins(odd, table, capacity):
    for docs in (odd, table("documents")):
        rows = docs.select("doc_id", "text").collect()
        got = P.pack(docs, tokenizer_path(), capacity).collect()
        assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=repr) == sorted(brute_pieces(rows, capacity), key=repr)
        total = sum(r["length"] for r in got)
        assert -(-total // capacity) <= check_bins(got, capacity) <= 1.03 * total / capacity + 2


TEXTS = ["I'm the cat's 3.14 café ÉTÉ", "a\tb\nc  d", "<|endoftext|> x<|startoftext|>y", "ΣΑΣ İ ß", "é ́x", "   z", "漢字 かな 12", "", " ", "!!! ... ''", "x" * 300]


def test_chunks_give_the_tokenizers_ids(monkeypatch):
    whole = Tokenizer.from_file(tokenizer_path())
    monkeypatch.setattr(P, "CACHE", 3)
    chunked = P.ChunkTokenizer(tokenizer_path())
    for t in [*TEXTS, " ".join(TEXTS), *TEXTS]:
        assert np.frombuffer(chunked.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_plan_holds_every_count_and_fills_well():
    rng = random.Random(3)
    for capacity in (10, 64, 2048):
        counts = {x: rng.randint(0, 50) for x in rng.sample(range(1, capacity + 1), min(capacity, 200))}
        bins = P.plan_bins(counts, capacity)
        held = {}
        for b in bins:
            assert sum(b.lengths) <= capacity and b.times > 0
            for x in b.lengths:
                held[x] = held.get(x, 0) + b.times
        assert held == {x: n for x, n in counts.items() if n}
        assert sum(b.times for b in bins) <= 1.05 * sum(x * n for x, n in counts.items()) / capacity + 2 + sum(n for x, n in counts.items() if 2 * x > capacity)


def test_two_replace_the_smallest():
    # greedy: 60 + 30, gap 10; the 30 gives way to 25 + 15, which fill it
    assert sorted(P.plan_bins({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0].lengths) == [15, 25, 60]


def test_empty_table(none):
    assert P.pack(none, tokenizer_path()).collect() == []
