"""Best-fit packing: best-two-fit over length counts.

Documents become token pieces of at most ``capacity`` tokens; only a longer
document is cut, into full pieces and a shorter last one. Pieces of equal
length are interchangeable, so the bins are planned over the counts of the
lengths, at most ``capacity`` numbers whatever the corpus size: a bin is
filled greedily, each time with the longest piece that fits the gap; then its
smallest piece is replaced by two unpacked ones that fill the expanded gap
more tightly, as long as that helps. The bin so found is used as often as the
counts allow before the next one is planned. So all documents are packed
together, not per partition, and the driver sees counts only.

Pieces then take their places by rank: the pieces of each length are numbered
0, 1, 2, ... across the cluster, and the plan says which bin and offset the
k-th piece of a length has.

Every document gives at least one piece: null and empty texts are the single
closing id. Repeated rows are packed each. An empty table gives no pieces.
Special-token strings in a text become their ids, as the tokenizer does by
default.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ROW_ID, dense_positions, pylist, with_row_id

CACHE = 150_000  # words, and chunks, whose ids a task remembers, twice
_tokenizers: dict[str, ChunkTokenizer] = {}

# The tokenizer's word pattern, as it reads plain text.
PLAIN_TEXT = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r a-zß-öø-ÿ0-9]+")


class _Memory:
    """A bounded dict of two generations: what is used stays."""

    def __init__(self, make) -> None:
        self.make, self.young, self.old = make, {}, {}

    def __getitem__(self, key: str) -> bytes:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found


class ChunkTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    No token spans white space, so a text's ids are those of its words one
    after the other, and words that come again are looked up. Text of ASCII
    and Latin-1 letters is split by the tokenizer's own word pattern; any
    other chunk between spaces goes through its normalizer, splitter and
    model, and one that may hold a special token is encoded whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.chunks = _Memory(self._word), _Memory(self._chunk)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the splitter's spelling of the letters beyond ASCII
        self.spelling = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def _ids(self, spelled: str) -> bytes:
        return np.array([x.id for x in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return self._ids(word if word.isascii() else word.translate(self.spelling))

    def _chunk(self, chunk: str) -> bytes:
        t = self.tokenizer
        if any(x in chunk for x in self.special):
            return np.array(t.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self._ids(word) for word, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(chunk)))

    def _plain(self, text: str) -> bytes:
        words, get = self.words, self.words.young.get
        return b"".join([get(w) or words[w] for w in PLAIN_WORD.findall(text.lower())])

    def encode(self, text: str) -> bytes:
        special = any(x in text for x in self.special)
        if not special and PLAIN_TEXT.fullmatch(text):
            return self._plain(text)
        return b"".join([self._plain(c) if PLAIN_TEXT.fullmatch(c) and not (special and any(x in c for x in self.special))
                         else self.chunks[c] if len(c) <= 64 else self._chunk(c) for c in text.split(" ")])


def tokenizer(path: str) -> ChunkTokenizer:
    """One per Python worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, path: str, capacity: int, closing_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids
    followed by ``closing_id``."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(pylist(b, "doc_id"), pylist(b, "text")):
                ids = t.encode(text or "") + closing
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    for col, x in zip(out, (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Bin:
    lengths: list[int]   # of its pieces, in order of their places
    times: int           # bins of this kind


class _Lengths:
    """Counts of the unpacked lengths, with the lengths present in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {x: n for x, n in counts.items() if n > 0}
        self.present = sorted(self.counts)

    def take(self, x: int, n: int = 1) -> None:
        self.counts[x] -= n
        if not self.counts[x]:
            del self.counts[x]
            self.present.pop(bisect.bisect_left(self.present, x))

    def give(self, x: int) -> None:
        if x not in self.counts:
            bisect.insort(self.present, x)
        self.counts[x] = self.counts.get(x, 0) + 1

    def longest_up_to(self, most: int) -> int | None:
        i = bisect.bisect_right(self.present, most)
        return self.present[i - 1] if i else None

    def best_two(self, gap: int) -> tuple[int, int] | None:
        """Two unpacked pieces with the largest sum up to ``gap``; of equal
        sums the pair with the longest piece."""
        best, i, j = None, 0, bisect.bisect_right(self.present, gap) - 1
        while i <= j:
            a, b = self.present[i], self.present[j]
            if a + b > gap:
                j -= 1
                continue
            if (i < j or self.counts[a] > 1) and (best is None or a + b > sum(best)):
                best = (b, a)
                if a + b == gap:
                    break
            i += 1
        return best


def plan_bins(counts: dict[int, int], capacity: int) -> list[Bin]:
    """Bins that hold every counted length (1 to ``capacity``) once."""
    left, bins = _Lengths(counts), []
    while left.present:
        own, gap = [], capacity
        while (x := left.longest_up_to(gap)) is not None:
            own.append(x)
            left.take(x)
            gap -= x
        while gap and len(own) > 1 and (two := left.best_two(gap + own[-1])) and sum(two) > own[-1]:
            gap += own[-1] - sum(two)
            left.give(own.pop())
            for x in two:
                left.take(x)
            own = sorted([*own, *two], reverse=True)
        used = {x: own.count(x) for x in own}
        more = min(left.counts.get(x, 0) // n for x, n in used.items())
        for x, n in used.items():
            if more:
                left.take(x, n * more)
        bins.append(Bin(own, 1 + more))
    return bins


def _places(bins: list[Bin]) -> dict[str, np.ndarray]:
    """Per (length, first rank): first bin number and offset. A piece's row is
    the last one of its length whose first rank is not above its own rank."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for b in bins:
        at = 0
        for x in b.lengths:
            rows.append((x, taken.get(x, 0), first, at))
            taken[x] = taken.get(x, 0) + b.times
            at += x
        first += b.times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 45) | table[:, 1], "rank": table[:, 1], "bin": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, path: str, capacity: int = 2048, closing_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = with_row_id(token_pieces(docs, path, capacity, closing_id).withColumn("_len", F.col("length").cast("int")), "pieces")
    counts = {r["_len"]: r["n"] for r in pieces.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    held = spark.sparkContext.broadcast(_places(plan_bins(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            row = np.searchsorted(t["key"], (length << 45) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                              pa.array(t["bin"][row] + rank - t["rank"][row]), pa.array(t["offset"][row])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    ranked = dense_positions(pieces, "_len", counts, "_rank").select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
