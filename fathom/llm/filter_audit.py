"""Filter interaction audit by a table-driven byte transducer.

One pass over the UTF-8 bytes of every whole text: a class table names each
byte's class, a transition table the state after it (inside or outside a
word), an output table what the step emits (word start, word end, capital,
symbol, code point). Numpy looks the tables up for a whole block of texts at
once, which is possible because the state after a byte depends on its class
alone. The emitted word spans go into an open-addressing hash table whose
every match is verified byte by byte, so distinct words are exact.

From the counts follow the failures of the filters, and from the sets of
failed filters what every order of the filters keeps, removes and masks.

Defined cases: null text is empty text; null part is the empty string. Copies
are texts with one SHA-256 digest; a document fails as a copy if a smaller id
has its text, so of rows that repeat an id none fails for the other, and rows
with a null id neither fail nor make others fail. A document with several
labels has quality or is toxic if any label says so. An empty table has no
parts and gives an empty result. Only the named columns of the input are
read, so further columns of any name don't matter.

Memory: texts are taken in blocks of ``BLOCK`` bytes; a longer text is cut at
white space and its different words are held. Rows with a digest are counted
per (digest, id) first, so a text that a third of all rows share is spread.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 17

# Byte classes.
SPACE, CAPITAL, SYMBOL, CONTINUATION, OTHER, END = range(6)
OUTSIDE, INSIDE = 0, 1
# What a step emits.
STARTS, STOPS, IS_CAPITAL, IS_SYMBOL, IS_POINT = 1, 2, 4, 8, 16


def _class_table() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[[0x20, *range(0x09, 0x0E)]] = SPACE
    t[ord("A"):ord("Z") + 1] = CAPITAL
    t[[ord(c) for c in "#$%&*|"]] = SYMBOL
    t[0x80:0xC0] = CONTINUATION
    return t


def _output_table() -> np.ndarray:
    """[state, class]; END closes a text and is no character of it."""
    t = np.zeros((2, 6), np.uint8)
    for c in (CAPITAL, SYMBOL, CONTINUATION, OTHER):
        t[OUTSIDE, c] |= STARTS
    t[INSIDE, [SPACE, END]] |= STOPS
    t[:, CAPITAL] |= IS_CAPITAL
    t[:, SYMBOL] |= IS_SYMBOL
    t[:, [SPACE, CAPITAL, SYMBOL, OTHER]] |= IS_POINT
    return t


CLASS, OUTPUT = _class_table(), _output_table()
NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE, OUTSIDE], np.uint8)
ANY_SPACE = re.compile(rb"[\x20\x09-\x0D]")
POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, np.uint64))


def transduce(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text its (words, capitals, symbols, code points), and per word its
    start, its end (byte places in ``data``) and its text's number. Text i is
    ``data[bounds[i]:bounds[i + 1]]``."""
    cls = np.insert(CLASS[data], bounds[1:], END)
    state = np.empty(len(cls), np.uint8)
    state[0], state[1:] = OUTSIDE, NEXT[cls[:-1]]
    out = OUTPUT[state, cls]
    firsts = bounds[:-1] + np.arange(len(bounds) - 1)   # places with one END per text before
    counts = np.stack([np.add.reduceat((out & bit) != 0, firsts, dtype=np.int64)
                       for bit in (STARTS, IS_CAPITAL, IS_SYMBOL, IS_POINT)], axis=1)
    starts, ends = np.flatnonzero(out & STARTS), np.flatnonzero(out & STOPS)
    owner = np.repeat(np.arange(len(bounds) - 1), counts[:, 0])
    return counts, starts - owner, ends - owner, owner


def _bytes_of(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all bytes of the spans, and where each span begins in them."""
    at = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(at - starts, lengths), at


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Numbers of one span of each group of equal spans of one owner.

    All spans probe their slot at once; a free slot takes one of them, and
    those whose owner and bytes equal the slot's holder are done. The rest go
    on to the next slot. Equal spans probe the same slots, so they meet."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    lengths = ends - starts
    places, at = _bytes_of(starts, lengths)
    inner = (np.arange(len(places)) - np.repeat(at, lengths)) & (len(POWERS) - 1)
    key = np.add.reduceat((data[places].astype(np.uint64) + np.uint64(1)) * POWERS[inner], at)
    key = (key ^ (owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
    bits = max(4, (2 * n).bit_length())
    slot, table, todo = (key >> np.uint64(64 - bits)).astype(np.int64), np.full(1 << bits, -1, np.int64), np.arange(n)
    while len(todo):
        at_slot = slot[todo]
        free = table[at_slot] < 0
        table[at_slot[free]] = todo[free]
        held = table[at_slot]
        same = (key[held] == key[todo]) & (owner[held] == owner[todo]) & (lengths[held] == lengths[todo])
        check = np.flatnonzero(same & (held != todo))
        if len(check):
            mine, at = _bytes_of(starts[todo[check]], lengths[todo[check]])
            theirs, _ = _bytes_of(starts[held[check]], lengths[held[check]])
            same[check] = np.logical_and.reduceat(data[mine] == data[theirs], at)
        todo = todo[~same]
        slot[todo] = (slot[todo] + 1) & (len(table) - 1)
    return table[table >= 0]


def block_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of (words, capitals, symbols, code points, distinct words)."""
    counts, starts, ends, owner = transduce(data, bounds)
    different = np.bincount(owner[distinct_spans(data, starts, ends, owner)], minlength=len(counts))
    return np.column_stack([counts, different])


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space; a piece above ``BLOCK`` is one word."""
    at = 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(bytes([c]), at, at + BLOCK) for c in b" \t\n\v\f\r") + 1
        if cut <= 0:
            m = ANY_SPACE.search(text, at + BLOCK)
            cut = m.start() if m else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def long_counts(text: bytes) -> np.ndarray:
    """The row of ``block_counts`` of one text longer than a block."""
    total, seen = np.zeros(4, np.int64), set()
    for piece in _pieces(text):
        if len(piece) > BLOCK:
            seen.add(piece)
            total[0] += 1
            for i in range(0, len(piece), BLOCK):
                total[1:] += transduce(np.frombuffer(piece[i:i + BLOCK], np.uint8), np.array([0, len(piece[i:i + BLOCK])]))[0][0, 1:]
        elif piece:
            data = np.frombuffer(piece, np.uint8)
            counts, starts, ends, owner = transduce(data, np.array([0, len(piece)]))
            total += counts[0]
            seen.update(piece[starts[i]:ends[i]] for i in distinct_spans(data, starts, ends, owner))
    return np.array([*total, len(seen)])


COUNTED = "n_words long, n_capitals long, n_symbols long, n_points long, n_distinct long, digest binary"


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_id", "_part", *(x.split()[0] for x in COUNTED.split(", "))]
    for b in batches:
        if not b.num_rows:
            continue
        texts = b.column(2).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        rows, at = [], 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            part = data[offsets[at]:offsets[end]]
            rows.append(block_counts(part, offsets[at:end + 1] - offsets[at]) if len(part) <= BLOCK else long_counts(part.tobytes())[None])
            at = end
        digests = [hashlib.sha256(data[s:e]).digest() for s, e in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c) for c in np.concatenate(rows).T), pa.array(digests, pa.binary())], names=names)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per row: _id, _part and the transducer's counts with the text's digest."""
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("_part"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    return own.mapInArrow(_count_batches, f"_id {own.schema['_id'].dataType.simpleString()}, _part string, {COUNTED}")


COPY = "E"


def filters() -> dict[str, Column]:
    """Failure conditions over the counts; ``COPY`` is the copies' letter."""
    return {"A": F.col("n_words") < 100, "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
            "C": 100 * F.col("n_capitals") > 10 * F.col("n_points"), "D": F.col("n_symbols") > 0}


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents by (part, set of failed filters as letters): n, and how many
    of them have quality (good) or are toxic."""
    marks = labels.select(F.col(f"`{id_col}`").alias("_of"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where("_of IS NOT NULL")
    marks = marks.groupBy("_of").agg(F.max("q").alias("q"), F.max("t").alias("t")).withColumn("_of_salt", F.lit(0).cast("long"))
    # null ids never match; a number of the text's digest deals them out
    counted = text_counts(docs, id_col, text, part).withColumn("_salt", F.when(F.col("_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    alone = F.concat(*[F.when(cond, F.lit(letter)).otherwise(F.lit("")) for letter, cond in filters().items()])
    known = (counted.join(marks, (F.col("_id") == F.col("_of")) & (F.col("_salt") == F.col("_of_salt")), "left")
             .select("_id", "_part", "digest", alone.alias("own"), F.coalesce("q", F.lit(False)).alias("q"), F.coalesce("t", F.lit(False)).alias("t")))
    kind = ["digest", "_part", "own", "q", "t"]
    per_id = known.groupBy(*kind, "_id").agg(F.count(F.lit(1)).alias("n"))
    has_id = F.col("_id").isNotNull()
    groups = per_id.groupBy(*kind).agg(
        F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("free"),
        F.min(F.when(has_id, F.struct("_id", "n"))).alias("low"))
    first = F.min("low._id").over(Window.partitionBy("digest"))
    kept = F.when(F.col("low._id") == F.col("first"), F.col("low.n")).otherwise(F.lit(0))
    sides = F.array(F.struct(F.col("own").alias("fails"), (F.col("free") + kept).alias("n")),
                    F.struct(F.concat("own", F.lit(COPY)).alias("fails"), (F.col("n") - kept).alias("n")))
    cells = groups.withColumn("first", first).select("_part", "q", "t", F.inline(sides)).where("n > 0")
    return cells.groupBy(F.col("_part").alias("part"), "fails").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("q"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("toxic"))


def order_report(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of ``letters`` and step, from the cells
    (part, fails, n, good, toxic) of ``failure_cells``."""
    orders = ["".join(p) for p in permutations(letters)]
    steps = (cells.withColumn("filter_order", F.explode(F.lit(orders)))
             .withColumn("step", F.explode(F.lit(list(range(1, len(letters) + 1)))))
             .withColumns({"_this": F.expr("substring(filter_order, step, 1)"), "_before": F.expr("substring(filter_order, 1, step - 1)")})
             .withColumns({"_here": F.expr("contains(fails, _this)"), "_gone": F.expr("length(translate(_before, fails, '')) < step - 1")}))
    here, gone = F.col("_here"), F.col("_gone")

    def total(cond: Column, value: Column | None = None) -> Column:
        return F.sum(F.when(cond, F.col("n") if value is None else value).otherwise(0)).cast("long")
    share = F.expr(f"n * ({math.factorial(len(letters))} div greatest(length(fails), 1))")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~here & ~gone).alias("kept"), total(here & ~gone).alias("removed"), total(here & gone).alias("redundant"),
        total(here & (F.length("fails") == 1)).alias("unique_fails"), total(here & ~gone, F.col("good")).alias("good_lost"),
        total(here & ~gone, F.col("toxic")).alias("toxic_lost"), total(here, share).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What every order of the five filters keeps, removes and masks per part."""
    return order_report(failure_cells(docs, labels, id_col, text, part), "".join(filters()) + COPY)
