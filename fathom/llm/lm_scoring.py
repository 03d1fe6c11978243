"""LM scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, the nodes of a tree with 255 inner nodes.
Every node keeps, for every context of up to ``depth`` bytes before it, how
often it went left and right. At each depth the Krichevsky-Trofimov estimate of
a context is mixed with its longer contexts,

    Pw(s) = 1/2 Pe(s) + 1/2 * product of Pw over the contexts one byte longer,

and a decision's probability mixes the KT estimates of all depths, 0 to
``depth``, with the weights that the training counts give: beta(s) =
1/2 Pe(s) / Pw(s) for stopping at s. KT estimates do not depend on the order of
the decisions, so counting byte grams (a context and its next byte) over the
whole training set, in parallel, gives the same weights as reading it in
sequence.

Only nodes that a text visits are held. The grams of all documents are counted,
those that the training set lacks with a count of zero, which changes no weight;
so every gram to be scored has its own row. Rows meet by the last three context
bytes: each bucket weights its contexts from the longest down, only the sums of
contexts of two bytes (at most 2^16 * 255 nodes, at any corpus size) meet on the
driver, and the mixture goes back from the empty context to the longest. The
result is a stored table of grams and their log probabilities. Broadcast are
the most frequent grams (at most ``HEAD_GRAMS``, 16 bytes each) and the nodes
of two-byte contexts; the other grams of each document are counted and joined
with the table. No gram left to the join can be hot: it has less than
2 / ``HEAD_GRAMS`` of all places, or there would be no room for it to miss.

The code length per byte is ``bits_per_byte``: -log2 of the text's probability
over its bytes (null where it has none).

A text is its UTF-8 bytes with A-Z lower-cased, closed by the byte 0xFF
(never part of UTF-8) and preceded by ``depth`` of them as first context. So
null and empty texts have the probability of an immediate end.

Beside it stands the base model: token counts (runs without ASCII white
space, then one end token) with add-one smoothing. The most frequent tokens,
at most ``HEAD_TOKENS``, are broadcast; the rest of each document's tokens are
joined with their counts, so no vocabulary size is too large and no hot token
is shuffled.

Rows that repeat are learned from and scored each. Equal counts are on the same
side of both heads, which changes no score. Sums over rows are taken in
decimals, so scores do not depend on partitions. A null id counts as not
held out. With no training rows every byte has probability 1/256 and every
token an add-one probability of 1; no rows give no rows. Every text is read
whole, a very long one in pieces. Only ``doc_id`` and the text are read, so
other columns of any name do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ROW_ID, chunks, pylist, store, with_row_id

DEPTH = 5
HEAD_TOKENS = 1 << 18
HEAD_GRAMS = 1 << 20
EDGE = b"\xff"
END_TOKEN = b""     # no word is empty
CHUNK = 1 << 20     # bytes of whole texts taken at once
PIECE = 1 << 21     # bytes of one longer text taken at once
SLICE = 1 << 16     # grams weighted at once


def text_bytes(text: str | None) -> bytes:
    return text.encode().lower() if text else b""


def text_grams(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of its text, gram) of every byte and end. A gram is a number: the
    byte before in the highest place, the one before that in the next, and so
    on, the byte itself in the lowest."""
    data = np.frombuffer(b"".join(EDGE * depth + t + EDGE for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes + depth) - sizes - depth
    scored = np.ones(len(data), bool)
    scored[(starts[:, None] + np.arange(depth)).ravel()] = False
    of = np.repeat(np.arange(len(texts)), sizes)
    done = 0
    for at in range(depth, len(data), PIECE):
        own = data[at - depth:at + PIECE]
        places = np.zeros((len(own) - depth, 8), np.uint8)
        for back in range(depth + 1):
            places[:, depth + 1 - back if back else 0] = own[depth - back:len(own) - back]
        grams = places.view("<i8").ravel()[scored[at:at + PIECE]]
        yield of[done:done + len(grams)], grams
        done += len(grams)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series at x + 8."""
    x = np.asarray(x, np.float64)
    y = x + 8
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for i in range(8):
        out = out - np.log(x + i)
    return out


def log_kt(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """ln of the KT block probability of so many decisions."""
    g = lambda n: log_gamma(n + 0.5) - 0.5 * math.log(math.pi)
    return np.where((left + right) > 0, g(left) + g(right) - log_gamma(left + right + 1.0), 0.0)


def _stop_weight(own: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """1/2 Pe / (1/2 Pe + 1/2 product of the longer contexts' Pw)."""
    return 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))


def _kt(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (right + 0.5) / (left + right + 1)


def one_shorter(key: np.ndarray) -> np.ndarray:
    """Keys of nodes without the context byte farthest back."""
    return (key >> 16 << 8) | (key & 255)


class Nodes:
    """The visited nodes of all contexts of one length, by key (context bytes,
    last first, then the node): decisions to the left and right, ln Pe, the sum
    of ln Pw of the contexts one byte longer (None at the full depth), and for
    each node of those its place here."""

    def __init__(self, key: np.ndarray, left: np.ndarray, right: np.ndarray, longer: np.ndarray | None):
        self.key, self.left, self.right = key, left, right
        own = log_kt(left, right)
        self.weighted = own if longer is None else np.logaddexp(own, longer) - math.log(2)
        self.stop = np.ones(len(key)) if longer is None else _stop_weight(own, longer)
        self.longer, self.of_longer = longer, None

    @classmethod
    def of_grams(cls, grams: np.ndarray, n: np.ndarray) -> tuple[Nodes, np.ndarray, np.ndarray]:
        """The nodes of full depth, and per level and gram its node and turn."""
        byte, level = grams & 255, np.arange(8)[:, None]
        turn = (byte >> (7 - level)) & 1
        key, at = np.unique((grams >> 8 << 8) | (1 << level) | (byte >> (8 - level)), return_inverse=True)
        at = at.reshape(8, -1)
        left, right = (np.bincount(at.ravel(), (n * (turn == side)).ravel(), len(key)) for side in (0, 1))
        return cls(key, left, right, None), at, turn

    def shorter(self) -> Nodes:
        """The nodes of the contexts one byte shorter."""
        key, at = np.unique(one_shorter(self.key), return_inverse=True)
        out = Nodes(key, *(np.bincount(at, x, len(key)) for x in (self.left, self.right, self.weighted)))
        out.of_longer = at
        return out

    def mixed(self, before: np.ndarray | float, rest: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """Probability of right as mixed down to here, and the weight left for
        longer contexts, from both of the shorter contexts."""
        kt = (self.right + 0.5) / (self.left + self.right + 1)
        return before + rest * self.stop * kt, rest * (1 - self.stop)


def slices(grams: np.ndarray, depth: int) -> Iterator[slice]:
    """Cuts of sorted grams, about ``SLICE`` each, never within a context of
    three bytes (at five bytes of context that has at most 2^24 grams)."""
    starts = np.flatnonzero(np.diff(grams >> (8 * (depth - 2)), prepend=-1))
    at = 0
    while at < len(grams):
        later = starts[np.searchsorted(starts, at + SLICE):]
        to = int(later[0]) if len(later) else len(grams)
        yield slice(at, to)
        at = to


def _weigh(grams: np.ndarray, n: np.ndarray, depth: int) -> tuple[list[Nodes], np.ndarray, np.ndarray]:
    """Nodes from full depth down to three bytes of context."""
    longest, at, turn = Nodes.of_grams(grams, n)
    levels = [longest]
    while len(levels) < depth - 2:
        levels.append(levels[-1].shorter())
    return levels, at, turn


def fit_grams(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Stored (gram, m, log): log10 probability of the last byte of every gram
    after its context. ``grams`` holds every gram to be scored once, with its
    count ``n`` in the training set, 0 included, and ``m`` in all documents."""
    spark = grams.sparkSession
    buckets = -(-grams.count() // SLICE) or 1
    cut = grams.groupBy(F.pmod(F.xxhash64(F.shiftright("gram", 8 * (depth - 2))), F.lit(buckets)).alias("bucket"))

    def parts(t: pa.Table):
        t = t.sort_by("gram")
        key, n, m = (t.column(c).to_numpy() for c in ("gram", "n", "m"))
        for s in slices(key, depth):
            yield key[s], m[s], *_weigh(key[s], n[s].astype(np.float64), depth)

    def sums(t: pa.Table) -> pa.Table:
        tops = [levels[-1].shorter() for _, _, levels, _, _ in parts(t)]    # a weighted node of three bytes has one parent
        return pa.table({"key": np.concatenate([x.key for x in tops]), "lefts": np.concatenate([x.left for x in tops]).astype(np.int64),
                         "rights": np.concatenate([x.right for x in tops]).astype(np.int64), "longer": np.concatenate([x.longer for x in tops])})

    # at most 2^16 * 255 rows
    top = (cut.applyInArrow(sums, "key long, lefts long, rights long, longer double").groupBy("key")
           .agg(F.sum("lefts").alias("lefts"), F.sum("rights").alias("rights"), F.sum(F.col("longer").cast("decimal(28,9)")).cast("double").alias("longer"))
           .toArrow().sort_by("key"))
    two = Nodes(top.column("key").to_numpy(), *(top.column(c).to_numpy().astype(np.float64) for c in ("lefts", "rights", "longer")))
    one = two.shorter()
    none = one.shorter()
    mix = none.mixed(0.0, 1.0)
    for shorter, nodes in ((none, one), (one, two)):
        mix = nodes.mixed(*(x[shorter.of_longer] for x in mix))
    held = spark.sparkContext.broadcast((two.key, *mix))

    def predict(t: pa.Table) -> pa.Table:
        out = []
        for key, m, levels, at, turn in parts(t):
            known, *mix = held.value
            parent = np.searchsorted(known, one_shorter(levels[-1].key))
            for nodes in reversed(levels):
                mix = nodes.mixed(*(x[parent] for x in mix))
                parent = nodes.of_longer
            p = mix[0][at]
            out.append((key, m, np.log10(np.where(turn == 1, p, 1 - p)).sum(axis=0)))
        return pa.table(dict(zip(("gram", "m", "log"), map(np.concatenate, zip(*out)))))

    return store(cut.applyInArrow(predict, "gram long, m long, log double"), "gram-logs")


def corpus_counts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Stored (word, gram, n, m) of rows (_text, held_out): token counts of the
    training set (gram null; the empty word is the end token), and gram counts
    (word null) ``n`` of the training set and ``m`` of all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text", 8 * CHUNK, 65536):
            texts = [text_bytes(t) for t in pylist(b, "_text")]
            learn = ~np.array(pylist(b, "held_out"), bool)
            words: Counter = Counter()
            for t, own in zip(texts, learn):
                if own:
                    words.update(t.split())
            if learn.any():
                words[END_TOKEN] += int(learn.sum())
            n = np.fromiter(words.values(), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([pa.array([*words], pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(n), pa.array(n)], names=["word", "gram", "n", "m"])
            for own in (True, False):
                for _, grams in text_grams([t for t, x in zip(texts, learn) if x == own], depth):
                    g, m = np.unique(grams, return_counts=True)
                    m = m.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(g), pa.binary()), pa.array(g), pa.array(m * own), pa.array(m)], names=["word", "gram", "n", "m"])
    return store(rows.select("_text", "held_out").mapInArrow(count, "word binary, gram long, n long, m long")
                 .groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "corpus-counts")


def head_level(words: DataFrame, most: int, by: str = "n") -> int:
    """The least power of two such that at most ``most`` rows have that count
    in ``by`` or more."""
    levels = {r["k"]: r["n"] for r in words.groupBy(F.floor(F.log2(by)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    held, level = 0, max(levels, default=0) + 1
    while level > 0 and held + levels.get(level - 1, 0) <= most:
        level -= 1
        held += levels.get(level, 0)
    return level


def score_documents(docs: DataFrame, held_out: Column, text: str = "text", depth: int = DEPTH, head_tokens: int = HEAD_TOKENS,
                    head_grams: int = HEAD_GRAMS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score and bits_per_byte. Learns from the rows where
    ``held_out`` is not true, contexts of up to ``depth`` (3 to 6) bytes."""
    if not 3 <= depth <= 6:
        raise ValueError("depth is 3 to 6: a gram and its node share 64 bits")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = corpus_counts(rows, depth)
    words = counts.where("word is not null").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = 1 << head_level(words, head_tokens)
    head = words.where(F.col("n") >= least).toArrow()      # at most ``head_tokens`` rows
    common = spark.sparkContext.broadcast(dict(zip(head.column("word").to_pylist(), head.column("n").to_pylist())))
    logs = fit_grams(counts.where("gram is not null").select("gram", "n", "m"), depth)
    often = 1 << head_level(logs, head_grams, "m")
    top = logs.where(F.col("m") >= often).select("gram", "log").toArrow().sort_by("gram")     # at most ``head_grams`` rows
    tree = spark.sparkContext.broadcast((top.column("gram").to_numpy(), top.column("log").to_numpy()))

    def tree_scores(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Per text the log probability of its grams in the broadcast, and its
        other grams with their counts."""
        known, log = tree.value
        score, far = np.zeros(len(texts)), []
        for of, g in text_grams(texts, depth):
            own, at = np.unique(g, return_inverse=True)
            place = np.searchsorted(known, own)
            found = np.zeros(len(own), bool)
            inside = place < len(known)
            found[inside] = known[place[inside]] == own[inside]
            value = np.zeros(len(own))
            value[found] = log[place[found]]
            score += np.bincount(of, value[at], len(texts))
            if not found.all():
                out = ~found[at]
                far.append((of[out], g[out]))
        whose, others = (np.concatenate([x[i] for x in far]) if far else np.zeros(0, np.int64) for i in (0, 1))
        order = np.lexsort((others, whose))
        whose, others = whose[order], others[order]
        first = np.flatnonzero(np.append(True, (np.diff(whose) != 0) | (np.diff(others) != 0))[:len(others)])
        n = np.diff(np.append(first, len(others)))
        offsets = pa.array(np.searchsorted(whose[first], np.arange(len(texts) + 1)).astype(np.int32))
        return score, pa.ListArray.from_arrays(offsets, pa.array(others[first])), pa.ListArray.from_arrays(offsets, pa.array(n))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = common.value.get
        for b in chunks(batches, "_text", CHUNK, 4096):
            texts = [text_bytes(t) for t in pylist(b, "_text")]
            out: list[list] = [[] for _ in range(6)]
            for t in texts:
                w = [*t.split(), END_TOKEN]
                c = [get(x, 0) for x in w]
                n = np.array(c, np.float64)
                rare = Counter(x for x, k in zip(w, c) if not k)
                for col, x in zip(out, (len(t), len(w), int(np.count_nonzero(n)), float(np.log10(n + 1).sum()), list(rare), list(rare.values()))):
                    col.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            own, grams, times = tree_scores(texts)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("held_out")), *(pa.array(c, t) for c, t in zip(out, types)), pa.array(own), grams, times],
                                             names=["doc_id", "held_out", "_bytes", "n_tokens", "_known", "_logs", "_rare", "_times", "score", "_grams", "_gram_times"])
    scored = with_row_id(rows.mapInArrow(score, "doc_id long, held_out boolean, _bytes long, n_tokens long, _known long, _logs double, _rare array<binary>, _times array<long>, score double, _grams array<long>, _gram_times array<long>"), "scored")
    exact = lambda x: F.sum(x.cast("decimal(28,12)")).cast("double")  # noqa: E731  (the same in any order)
    rare = scored.select(ROW_ID, F.explode(F.arrays_zip("_rare", "_times")).alias("_r")).select(ROW_ID, F.col("_r._rare").alias("word"), F.col("_r._times").alias("_times"))
    extra = (rare.join(words.where(F.col("n") < least), "word").groupBy(ROW_ID)
             .agg(F.sum("_times").alias("_more"), exact(F.col("_times") * F.log10(F.col("n") + 1)).alias("_more_logs")))
    if often > 1:   # else every gram was broadcast
        grams = scored.select(ROW_ID, F.explode(F.arrays_zip("_grams", "_gram_times")).alias("_g")).select(ROW_ID, F.col("_g._grams").alias("gram"), F.col("_g._gram_times").alias("_times"))
        far = grams.join(logs.where(F.col("m") < often), "gram").groupBy(ROW_ID).agg(exact(F.col("_times") * F.col("log")).alias("_far"))
        scored = scored.join(far, ROW_ID, "left").withColumn("score", F.col("score") + F.coalesce("_far", F.lit(0.0)))
    smooth = math.log10(total["n"] + total["v"] + 1)
    return scored.join(extra, ROW_ID, "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("_logs") + F.coalesce("_more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(smooth)).alias("base_score"), "score",
        F.when(F.col("_bytes") > 0, -F.col("score") / math.log10(2) / F.col("_bytes")).alias("bits_per_byte"))
