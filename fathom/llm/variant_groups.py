"""Spelling variant grouping by a dictionary of trie node pairs.

The words of the vocabulary are put in a forward trie, and reversed in a
second one, and the nodes of both are numbered. A word cut at a place is then
a pair of integers: the node of what is before the cut and the node, in the
reversed trie, of what is behind it. Leaving out the character behind the cut
gives the pair of a skipped position. Two words differ by a replaced character
exactly if they have a skip pair in common, and a word is another one with a
character left out exactly if its plain pair is one of the other's skip pairs.
Joining on the integer pairs gives all exact neighbours, and no others.

A pair belongs to few words: its plain form to one, its skip form to as many
as there are letters. Each pair of neighbours meets in one place only: at the
replaced position, or at the first of a run of equal characters one of which
is left out.

Numbering: the words are sorted in ranges, and a range numbers its nodes from
the common prefix with the word before. A prefix whose words lie in several
ranges extends past a cut between ranges; it is named by the first such cut
and its length, which all ranges know. Nodes that only one word passes through
can't be shared and are left out.

Defined cases: null text has no words; a null id is an empty one in the
character deletion; repeated rows count each. Ties of the form go to the word
first in code-point order. An empty table gives an empty table. Only the named
columns are read. A text is split whole, and a very long word costs as many
pairs as it has characters.

Driver: holds the cuts only, at most ``MAX_RANGES`` words, from a sample of
``SAMPLE_PER_RANGE`` words per range, which moves the cuts and nothing else.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import chunks, pylist, store

RANGE_WORDS, MAX_RANGES, SAMPLE_PER_RANGE = 4_000, 20_000, 20
# Letters of a run: A-Z, a-z and U+00C0 to U+00FF, after lower-casing A-Z.
LEAST_POINTS, LEAST_COUNT, FORM_RATIO = 7, 2, 10
DELETE_ONE_IN = 31
# A task's counts go on when it holds this many words, or characters.
HELD_WORDS, HELD_CHARS = 1 << 18, 1 << 25
PLAIN, SKIP, FIRST_SKIP = 0, 1, 2
LOW = 1 << 40


def runs_of(text: str, least: int) -> list[str]:
    """Maximal runs of at least ``least`` letters, A-Z lower-cased."""
    return re.findall("[a-zÀ-ÿ]{%d,}" % least, text.encode().lower().decode())


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_points: int = LEAST_POINTS,
                delete_one_in: int = DELETE_ONE_IN) -> DataFrame:
    """word, n over all texts, after the deletion of one character of the runs
    whose crc32 with the document's id is a multiple of ``delete_one_in``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        chars = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in chunks(batches, "_text", 16 << 20, 4096):
            for i, t in zip(pylist(b, "_id"), pylist(b, "_text")):
                seed = zlib.crc32(f"{i}:".encode())
                for run, n in Counter(runs_of(t, least_points)).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % delete_one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= least_points:
                        chars += 0 if run in held else len(run)
                        held[run] += n
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield out()
                    held.clear()
                    chars = 0
        if held:
            yield out()
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_id"), F.col(f"`{text}`").alias("_text"))
    return own.where("_text IS NOT NULL").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


class Numbering:
    """Trie nodes along words that come in order, range after range."""

    def __init__(self, cuts: list[str]) -> None:
        self.cuts, self.range, self.prev, self.path, self.next = cuts, -1, "", [], 0

    def _name(self, prefix: str) -> int:
        j = bisect.bisect_right(self.cuts, prefix)      # the first cut above the prefix
        if j < len(self.cuts) and self.cuts[j].startswith(prefix):
            return -1 - (j << 32 | len(prefix))
        self.next += 1
        return self.range * LOW + self.next - 1

    def nodes(self, rng: int, word: str, following: str | None) -> list[int]:
        """Nodes of the prefixes of ``word`` from the empty one to the longest
        that another word may share. ``following``: the next in the range."""
        if rng != self.range:
            self.range, self.prev, self.path, self.next = rng, "", [], 0
        same = common(self.prev, word)
        shared = max(same, common(word, following) if following is not None else 0,
                     common(word, self.cuts[rng]) if rng < len(self.cuts) else 0,
                     common(word, self.cuts[rng - 1]) if rng else 0)
        path = self.path[:same + 1]
        path.extend(self._name(word[:i]) for i in range(len(path), shared + 1))
        self.prev, self.path = word, path
        return path


def _with_next(batches: Iterator[pa.RecordBatch], rng: str, key: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with the key after each row in its range, or None."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ranges, keys = pylist(b, rng), pylist(b, key)
        if last:
            yield last[0], [*last[1], keys[0] if ranges[0] == last[2] else None]
        last = b, [keys[i + 1] if ranges[i] == ranges[i + 1] else None for i in range(len(keys) - 1)], ranges[-1]
    if last:
        yield last[0], [*last[1], None]


def _cuts(words: DataFrame, column: str, n: int) -> list[str]:
    ranges = _ranges(n)
    share = min(1.0, ranges * SAMPLE_PER_RANGE / max(n, 1))
    keys = sorted(r[0] for r in words.select(column).sample(share, seed=11).toLocalIterator())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _in_order(words: DataFrame, key: str, cuts: list[str], ranges: int) -> DataFrame:
    """``words`` with _range added, sorted by ``key`` in their ranges."""
    held = words.sparkSession.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([bisect.bisect_right(held.value, x) for x in pylist(b, key)], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, "_range"])
    placed = words.mapInArrow(place, T.StructType([*words.schema, T.StructField("_range", T.IntegerType())]))
    return placed.repartition(ranges, "_range").sortWithinPartitions("_range", key)


def _ranges(n: int) -> int:
    return max(1, min(MAX_RANGES, -(-n // RANGE_WORDS)))


def number_words(words: DataFrame) -> DataFrame:
    """(word, n) stored as (_id, word, n, _rev, _nodes): ids in word order and
    the forward trie's nodes."""
    n = words.count()
    cuts = _cuts(words, "word", n)
    held = words.sparkSession.sparkContext.broadcast(cuts)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, at = Numbering(held.value), 0
        for b, following in _with_next(batches, "_range", "word"):
            ids, nodes = [], []
            for rng, word, after in zip(pylist(b, "_range"), pylist(b, "word"), following):
                at = at + 1 if rng == trie.range else 0
                nodes.append(trie.nodes(rng, word, after))
                ids.append(rng * LOW + at)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(b.column(b.schema.get_field_index(c)) for c in ("word", "n", "_rev")),
                                              pa.array(nodes, pa.list_(pa.int64()))], names=["_id", "word", "n", "_rev", "_nodes"])
    ordered = _in_order(words.withColumn("_rev", F.reverse("word")), "word", cuts, _ranges(n))
    return store(ordered.mapInArrow(number, "_id long, word string, n long, _rev string, _nodes array<long>"), "trie-words")


def node_pairs(numbered: DataFrame) -> DataFrame:
    """_before, _behind, _id, n, _kind: plain and skip pairs of every word."""
    n = numbered.count()
    cuts = _cuts(numbered, "_rev", n)
    held = numbered.sparkSession.sparkContext.broadcast(cuts)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Numbering(held.value)
        for b, following in _with_next(batches, "_range", "_rev"):
            before, behind, ids, counts, kinds = [], [], [], [], []
            for rng, rev, after, own, n, ahead in zip(pylist(b, "_range"), pylist(b, "_rev"), following, pylist(b, "_id"), pylist(b, "n"), pylist(b, "_nodes")):
                tail, size = trie.nodes(rng, rev, after), len(rev)
                # cut behind i characters: ahead has the nodes up to len(ahead) - 1 characters, tail likewise
                for left_out in (0, 1):
                    low, high = max(0, size - left_out - len(tail) + 1), min(size - left_out, len(ahead) - 1)
                    if low > high:
                        continue
                    before += ahead[low:high + 1]
                    behind += tail[size - left_out - high:size - left_out - low + 1][::-1]
                    kinds += [FIRST_SKIP if i == 0 or rev[size - 1 - i] != rev[size - i] else SKIP for i in range(low, high + 1)] if left_out else [PLAIN] * (high - low + 1)
                    ids += [own] * (high - low + 1)
                    counts += [n] * (high - low + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (before, behind, ids, counts)] + [pa.array(kinds, pa.int8())],
                                             names=["_before", "_behind", "_id", "n", "_kind"])
    ordered = _in_order(numbered.select("_id", "n", "_rev", "_nodes"), "_rev", cuts, _ranges(n))
    return ordered.mapInArrow(pairs, "_before long, _behind long, _id long, n long, _kind byte")


def neighbours(pairs: DataFrame) -> DataFrame:
    """Per word with neighbours: _id, n_near and the best one (n, -_id)."""
    pair = Window.partitionBy("_before", "_behind")
    order = pair.orderBy((F.col("_kind") == PLAIN), F.desc("n"), "_id")
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me, skip, first = F.struct("n", (-F.col("_id")).alias("o")), F.col("_kind") != PLAIN, F.col("_kind") == FIRST_SKIP
    met = pairs.select(
        "*", F.row_number().over(order).alias("_rank"), F.count(F.lit(1)).over(pair).alias("_all"), F.sum(skip.cast("int")).over(pair).alias("_skips"),
        F.sum(first.cast("int")).over(pair).alias("_firsts"), F.max(F.when(~skip, me)).over(pair).alias("_plain"),
        F.first(me).over(everyone).alias("_best"), F.nth_value(me, 2).over(everyone).alias("_second"),
        F.max(F.when(first, me)).over(pair).alias("_longer")).where("_all > 1")
    # a skip meets the other skips and, at the first of a run, the plain pair; a plain pair meets the first skips
    shorter = F.when(first, F.col("_plain"))
    other = F.when(F.col("_skips") > 1, F.when(F.col("_rank") == 1, F.col("_second")).otherwise(F.col("_best")))
    seen = met.select("_id", F.when(skip, F.col("_skips") - 1 + shorter.isNotNull().cast("int")).otherwise(F.col("_firsts")).alias("k"),
                      F.when(skip, F.greatest(other, shorter)).otherwise(F.col("_longer")).alias("best")).where("k > 0")
    return seen.groupBy("_id").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_points: int = LEAST_POINTS,
                   least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, delete_one_in: int = DELETE_ONE_IN) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    words = store(word_counts(docs, id_col, text, least_points, delete_one_in).where(F.col("n") >= least_count), "words")
    return group_words(words, least_count, ratio)


def group_words(words: DataFrame, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """The same for given words (distinct) with their counts n."""
    numbered = number_words(words)
    near = store(neighbours(node_pairs(numbered)), "near-words")
    own = numbered.select("_id", "word", "n")
    found = own.select("_id", "n").join(near, "_id").where(F.col("best.n") >= ratio * F.col("n"))
    root = store(found.select("_id", (-F.col("best.o")).alias("_form"), F.col("best.n").alias("form_n")), "forms")
    # a form has at least ratio times the n of its word, so chains are short
    most = numbered.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(max(most / least_count, 1), ratio)) + 1
    root = root.withColumn("_root", F.col("_form"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        further = root.select(F.col("_id").alias("_at"), F.col("_root").alias("_on"))
        root = store(root.join(further, F.col("_root") == F.col("_at"), "left").withColumn("_root", F.coalesce("_on", "_root")).drop("_at", "_on"), "roots")
    named = (root.join(own.select(F.col("_id").alias("_form"), F.col("word").alias("form")), "_form")
             .join(own.select(F.col("_id").alias("_root"), F.col("word").alias("root")), "_root").select("_id", "form", "root", "form_n"))
    return (own.join(near.select("_id", "n_near"), "_id", "left").join(named, "_id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
