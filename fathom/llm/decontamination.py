"""Benchmark decontamination with training suffix arrays.

Training documents are cut into shards of consecutive documents. Each shard
gets a suffix array over its words (prefix doubling on packed word ids), and
every suffix of the test items is binary-searched in it. The search gives
the suffix's longest verbatim match in the shard and, for windows, the range
of all places where it occurs. It also merges the sorted test suffixes into the
array: a training suffix shares most words with one of its two neighbours
among them, so every document gets its own longest match and its place,
whatever other documents hold. Of equally long matches the first place counts.

Words not in the test items cannot be part of a match: they end a suffix, and
suffixes start only at test words. So the array orders exactly the suffixes a
search can end in, and an order up to the longest test item's length is a
full order.

A window is ``window`` consecutive words of an item; an item with fewer
words, but at least one, is one window. Every word of a document inside any
occurrence of a window is hit. Null and empty texts have no words and no
hits; null or empty items have no windows. Items are identified by item_id:
rows that repeat an id add their windows to it, and a null id counts as an
item but is left out of the list. Repeated document rows are judged each. A
document longer than a shard is a shard of its own, whole.

The test items are read in blocks of at most ``BLOCK_WORDS`` words; each
block is broadcast, a bounded size, and each is searched over all documents.
Between blocks the documents' state is stored, so any number of items works
in the same memory, at one pass over the documents per block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import alnum_words, aside, chunks, pylist, store

BLOCK_WORDS = 1_000_000
SHARD_BYTES = 6 << 20
SHARD_ROWS = 4096
BREAK, END, FIRST = 0, 1, 2  # a training word outside the tests; an item's end; the first word id


@dataclass
class TestBlock:
    """Distinct test suffixes and windows of a block of items."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray      # word ids of the items, each closed by END
    starts: np.ndarray      # suffix starts in tokens
    sizes: np.ndarray       # words left in the item from there
    windows: np.ndarray     # the window's length at that suffix; 0 if none starts there
    items: list[list]       # of each suffix with a window: the item ids
    longest: int
    order: np.ndarray       # the suffixes (as indices of starts) in order of their words

    @property
    def bits(self) -> int:
        return max(1, int(len(self.vocabulary) + FIRST).bit_length())


def build_block(items: list[tuple], window: int) -> TestBlock:
    vocabulary: dict[bytes, int] = {}
    at: dict[tuple, int] = {}
    tokens: list[int] = []
    starts, sizes, windows, owners = [], [], [], []
    longest = 0
    for item_id, words in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + FIRST) for w in words]
        longest, base = max(longest, len(ids)), len(tokens)
        tokens += [*ids, END]
        for i in range(len(ids)):
            w = window if i + window <= len(ids) else len(ids) if i == 0 else 0
            key = tuple(ids[i:i + w])
            if w and key in at:     # its places are those of the first such window
                owners[at[key]].append(item_id)
                w = 0
            elif w:
                at[key] = len(starts)
            starts.append(base + i)
            sizes.append(len(ids) - i)
            windows.append(w)
            owners.append([item_id])
    block = TestBlock(vocabulary, np.array(tokens, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64),
                      np.array(windows, np.int64), owners, longest, np.zeros(0, np.int64))
    key, per = _packed(block.tokens, block.bits)
    block.order = np.searchsorted(block.starts, suffix_array(block.tokens, key, per, longest + 1))
    return block


def read_blocks(tests: DataFrame, window: int, block_words: int) -> Iterator[TestBlock]:
    """Blocks of items, streamed through the driver one block at a time."""
    held, n = [], 0
    for r in tests.select("item_id", "text").where("text is not null").toLocalIterator():
        words = alnum_words(r["text"])
        if held and n + len(words) > block_words:
            yield build_block(held, window)
            held, n = [], 0
        if words:
            held.append((r["item_id"], words))
            n += len(words)
    yield build_block(held, window)


def _packed(tokens: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """At every place the next few word ids in one integer, most significant
    first, and how many those are. After a BREAK or END only zeros follow."""
    per = max(1, 62 // bits)
    key, going = np.zeros(len(tokens), np.int64), np.ones(len(tokens), bool)
    padded = np.concatenate([tokens, np.zeros(per, np.int64)])
    for j in range(per):
        here = padded[j:j + len(tokens)]
        key = (key << bits) | np.where(going, here, 0)
        going &= here >= FIRST
    return key, per


def suffix_array(tokens: np.ndarray, key: np.ndarray, per: int, depth: int) -> np.ndarray:
    """Starts of all suffixes that begin with a test word, in order of their
    words up to a BREAK, at least ``depth`` words deep."""
    starts = np.flatnonzero(tokens >= FIRST)
    if not len(starts):
        return starts
    order = starts[np.argsort(key[starts], kind="stable")]
    sorted_key = key[order]
    rank = np.zeros(len(tokens) + 1, np.int64)  # 0: a break, or past the end
    group = np.concatenate([[0], np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1])
    rank[order] = np.repeat(group + 1, np.diff(np.append(group, len(order))))
    run = np.zeros(len(tokens) + 1, np.int64)   # words up to the next break
    stops = np.flatnonzero(tokens < FIRST)
    nxt = np.append(stops, len(tokens))[np.searchsorted(stops, np.arange(len(tokens)))]
    run[:-1] = nxt - np.arange(len(tokens))
    h = per
    while h < depth:
        r = rank[order]
        tied = np.zeros(len(order), bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        long = np.zeros(len(tokens) + 1, bool)
        long[r[tied & (run[order] > h)]] = True     # groups with a suffix that goes on
        todo = np.flatnonzero(tied & long[r])
        if not len(todo):
            break
        places = order[todo]
        follow = np.where(run[places] > h, rank[np.minimum(places + h, len(tokens))], 0)
        sub = np.lexsort((follow, r[todo]))
        places, follow, base = places[sub], follow[sub], r[todo][sub]
        order[todo] = places
        new = np.concatenate([[True], (base[1:] != base[:-1]) | (follow[1:] != follow[:-1])])
        first = todo[np.flatnonzero(new)] + 1
        rank[places] = np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(places))))
        h *= 2
    return order


class Shard:
    """Suffix array of a run of documents over one block's words."""

    def __init__(self, documents: list[np.ndarray], block: TestBlock) -> None:
        self.block = block
        sizes = np.fromiter((len(d) + 1 for d in documents), np.int64, len(documents))
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        gap = np.zeros(1, np.int64)
        self.tokens = np.concatenate([x for d in documents for x in (d, gap)] or [gap])
        self.key, self.per = _packed(self.tokens, block.bits)
        self.order = suffix_array(self.tokens, self.key, self.per, block.longest + 1)
        self.test_key, _ = _packed(block.tokens, block.bits)

    def _common(self, suffix: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that test suffixes and training places share, up to ``most``."""
        n = np.zeros(len(suffix), np.int64)
        going = np.arange(len(suffix))
        while len(going):
            a, b = self.block.tokens[suffix[going] + n[going]], self.tokens[np.minimum(place[going] + n[going], len(self.tokens) - 1)]
            same = (a == b) & (n[going] < most[going])
            n[going[same]] += 1
            going = going[same]
        return n

    def _bound(self, suffix: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
        """Binary search: how many suffixes of the array sort before the first
        ``most`` words of each test suffix (``after``: before or start with)."""
        lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(self.order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            s, p, m = suffix[open_], self.order[mid], most[open_]
            a, b = self.test_key[self.block.starts[s]], self.key[p]
            below = b < a
            tie = np.flatnonzero((a == b) | (m < self.per))
            if len(tie):
                n = self._common(self.block.starts[s[tie]], p[tie], m[tie])
                full = n >= m[tie]
                x = self.block.tokens[self.block.starts[s[tie]] + n]
                y = self.tokens[np.minimum(p[tie] + n, len(self.tokens) - 1)]
                below[tie] = np.where(full, after, y < x)
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        return lo

    def search(self) -> np.ndarray:
        """How many suffixes of the array sort before every test suffix."""
        return self._bound(np.arange(len(self.block.starts)), self.block.sizes, after=False)

    def longest_of_documents(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every document: words of its longest match with any test suffix
        (0: none), and the first word of the first such match (-1: none)."""
        n_docs = len(self.base) - 1
        longest, where = np.zeros(n_docs, np.int64), np.full(n_docs, -1, np.int64)
        if not len(self.order) or not len(at):
            return longest, where
        after = np.searchsorted(at[self.block.order], np.arange(len(self.order)), side="right")
        best = np.zeros(len(self.order), np.int64)
        for near in (after - 1, after):
            ok = np.flatnonzero((near >= 0) & (near < len(at)))
            s = self.block.order[near[ok]]
            best[ok] = np.maximum(best[ok], self._common(self.block.starts[s], self.order[ok], self.block.sizes[s]))
        doc = self.document_of(self.order)
        first = np.lexsort((self.order, -best, doc))
        first = first[np.concatenate([[True], doc[first][1:] != doc[first][:-1]])]
        longest[doc[first]], where[doc[first]] = best[first], self.order[first] - self.base[doc[first]]
        return longest, where

    def longest_matches(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every test suffix: words of its longest match and a place of it
        (-1: none)."""
        every = np.arange(len(self.block.starts))
        if not len(self.order) or not len(every):
            return np.zeros(len(every), np.int64), np.full(len(every), -1, np.int64)
        best, place = np.zeros(len(every), np.int64), np.full(len(every), -1, np.int64)
        for near in (at - 1, at):
            ok = np.flatnonzero((near >= 0) & (near < len(self.order)))
            p = self.order[near[ok]]
            n = self._common(self.block.starts[ok], p, self.block.sizes[ok])
            better = n > best[ok]
            best[ok[better]], place[ok[better]] = n[better], p[better]
        return best, place

    def window_places(self, longest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(test suffix, all places) of every window that occurs."""
        found = np.flatnonzero((self.block.windows > 0) & (longest >= self.block.windows))
        if len(found):
            left = self._bound(found, self.block.windows[found], after=False)
            right = self._bound(found, self.block.windows[found], after=True)
            for s, a, b in zip(found, left, right):
                yield int(s), self.order[a:b]

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, side="right") - 1


SPANS = "array<struct<start:int,end:int>>"
STATE = f"_n_words long, _spans {SPANS}, _items array<string>, _longest int, _longest_at int"


def _search(held, first: bool, text: str, longest_too: bool):
    """Adds a block's matches to each document's state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: TestBlock = held.value
        get = block.vocabulary.get
        for b in chunks(batches, text, SHARD_BYTES, SHARD_ROWS):
            docs, n_words = [], []
            for t in pylist(b, text):
                w = alnum_words(t)
                n_words.append(len(w))
                docs.append(np.fromiter((get(x, BREAK) for x in w), np.int64, len(w)))
            shard = Shard(docs, block)
            at = shard.search()
            longest, _ = shard.longest_matches(at)
            spans: dict[int, list] = defaultdict(list)
            items: dict[int, set] = defaultdict(set)
            for s, places in shard.window_places(longest):
                owner = shard.document_of(places)
                for d, p in zip(owner.tolist(), (places - shard.base[owner]).tolist()):
                    spans[d].append((p, p + int(block.windows[s])))
                    items[d].update(block.items[s])
            most, most_at = shard.longest_of_documents(at) if longest_too else ([0] * b.num_rows, [None] * b.num_rows)
            before = [[], [], [0] * b.num_rows, [None] * b.num_rows] if first else [pylist(b, c) for c in ("_spans", "_items", "_longest", "_longest_at")]
            out = {"_n_words": n_words, "_spans": [], "_items": [], "_longest": [], "_longest_at": []}
            for i in range(b.num_rows):
                own = spans.get(i, [])
                names = {"" if x is None else str(x) for x in items.get(i, ())}
                if not first:
                    own = own + [(x["start"], x["end"]) for x in before[0][i]]
                    names |= set(before[1][i])
                out["_spans"].append([{"start": x, "end": y} for x, y in merge_spans(own)])
                out["_items"].append(sorted(names))
                best = max(int(most[i]), before[2][i])
                out["_longest"].append(best)
                out["_longest_at"].append(min((p for n, p in ((most[i], most_at[i]), (before[2][i], before[3][i])) if best and n == best), default=None))
            kept = [f for f in b.schema if f.name not in out]
            types = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), *(pa.array(v, t) for v, t in zip(out.values(), types))],
                                             names=[*(f.name for f in kept), *out])
    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that neither meet nor touch, covering the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match_tests(docs: DataFrame, tests: DataFrame, text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS,
                longest: bool = True) -> DataFrame:
    """``docs`` (all columns) with ``_n_words``, ``_spans`` (hit words as
    half-open ranges, merged), ``_items`` (ids as strings of items with an
    occurring window; "" stands for a null id), ``_longest``: the words of the
    document's longest verbatim match with an item, however short, and
    ``_longest_at``: the word it starts at (null without one). Without
    ``longest`` these two are left 0 and null."""
    spark = docs.sparkSession
    state, plain = docs, T.StructType(list(docs.schema))
    added = T.StructType.fromDDL(STATE)
    for i, block in enumerate(read_blocks(tests, window, block_words)):
        state = (store(state, "decontamination-block") if i else state).mapInArrow(
            _search(spark.sparkContext.broadcast(block), i == 0, text, longest), T.StructType([*plain, *added]))
    return state


def contamination_report(docs: DataFrame, tests: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and
    contaminated, and the hit spans, the longest match's words and its first
    word (longest_match, longest_at)."""
    m = match_tests(docs.select("doc_id", "text"), tests, window=window, block_words=block_words)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    named = F.filter("_items", lambda x: x != "")
    return m.select("doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
                    F.col("_spans").alias("spans"), F.col("_longest").alias("longest_match"), F.col("_longest_at").alias("longest_at"))


def drop_contaminated(docs: DataFrame, tests: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents in which a test window occurs."""
    moved, back = aside(docs, " ".join(T.StructType.fromDDL(STATE).names))
    clean = match_tests(moved, tests, window=window, longest=False).where(F.size("_spans") == 0)
    return back(clean.select(*[F.col(f"`{c}`") for c in moved.columns]))
