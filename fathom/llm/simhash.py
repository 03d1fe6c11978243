"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last
read as a 23-bit word with zeros). The perfect binary Golay code [23, 12]
puts every 23-bit word within 3 bits of exactly one of 4096 codewords. A
segment's keys are the codeword indices of the word and of its 23 one-bit
neighbours: one key if the word is within 2 bits of its codeword, six
otherwise. Two words at most two bits apart always share a key.

Two fingerprints at most two bits apart differ in at most two of three
segments, so some segment is equal (pigeonhole). Each fingerprint therefore
gets keys (equal segment i, Golay key of segment i+1) for the three i: about
16 keys of 30 to 35 bits. Fingerprints that share a key are paired and
verified by their bit distance.

A key with more than ``BUCKET`` fingerprints is not paired. Its fingerprints
are linked through common neighbours instead, exactly: two words are at most
two bits apart if and only if they share a word at most one bit from both.
Every such fingerprint lists its 65 neighbours, each neighbour is a group of
at most 65 fingerprints, and the links are from each group's smallest to the
others. Those links are within 2 bits by construction.

Only distinct fingerprints are paired, so copies never multiply. Components
are found by alternating large-star and small-star joins, each round stored.

Words are runs without ASCII white space, A-Z lower-cased; shingles are
``words`` consecutive words, repeats included, joined by one space. Fewer
words: the whole sequence is one shingle. No words or null text: fingerprint
0, linked like any other. A document's component id is the smallest doc_id in its
component; null doc_ids are passed over, and a component with null ids only
has a null component id. Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ROW_ID, aside, pylist, space_words, store, with_row_id

SEGMENTS = ((0, 23), (23, 23), (46, 18))    # first bit, bits
GENERATOR = 0b101011100011                  # of the cyclic Golay code
BUCKET = 32                                 # most fingerprints of a key that are paired


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the shingles' XXH64 (seed 42) hashes."""
    w = space_words(text)
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = zip(*(w[i:i + n] for i in range(words))) if len(w) >= words else [w]
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, shingles)), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        set_bits += np.unpackbits(h[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * set_bits > n)))


@cache
def _decode_table() -> np.ndarray:
    """Codeword index (0 to 4095) of every 23-bit word."""
    code = np.zeros(4096, np.int64)
    for bit in range(12):
        code ^= np.where((np.arange(4096) >> bit) & 1, GENERATOR << bit, 0)
    errors = [0, *(1 << a for a in range(23)), *(1 << a | 1 << b for a in range(23) for b in range(a)),
              *(1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b))]
    table = np.empty(1 << 23, np.int16)
    for e in errors:
        table[code ^ e] = np.arange(4096)
    return table


def segment_keys(words: np.ndarray) -> list[np.ndarray]:
    """Distinct Golay keys of each 23-bit word."""
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    found = np.sort(_decode_table()[near], axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return [row[mask] for row, mask in zip(found, first)]


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.fromiter((fingerprint(t, words) for t in pylist(b, "_text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f.view(np.int64))], names=["doc_id", ROW_ID, "_fp"])
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        parts = [((f >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
        for i, part in enumerate(parts):
            golay = segment_keys(parts[(i + 1) % 3])
            n = np.fromiter(map(len, golay), np.int64, len(golay))
            key = (np.int64(i) << 40) | (np.repeat(part, n) << 12) | np.concatenate([*golay, np.empty(0, np.int16)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(f.view(np.int64), n))], names=["_key", "_fp"])


def _pairs(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for members in pylist(b, "_members"):
                m = np.array(sorted(members), np.int64)
                i, j = np.triu_indices(len(m), 1)
                near = np.bitwise_count((m[i] ^ m[j]).view(np.uint64)) <= max_bits
                a.append(m[i[near]])
                c.append(m[j[near]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*a, np.empty(0, np.int64)])), pa.array(np.concatenate([*c, np.empty(0, np.int64)]))], names=["u", "v"])
    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (u < v) whose transitive closure is that of all pairs of the
    distinct values in ``_fp`` at most ``max_bits`` (0, 1 or 2) bits apart."""
    if max_bits not in (0, 1, 2):
        raise ValueError("the Golay keys hold for a distance of at most 2")
    keys = store(fps.select("_fp").mapInArrow(_keys, "_key long, _fp long"), "golay-keys")
    sizes = store(keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "key-sizes")
    paired = store(keys.join(sizes.where(F.col("_n") <= bucket), "_key").select("_key", "_fp"), "paired-keys")
    links = (paired.groupBy("_key").agg(F.collect_list("_fp").alias("_members")).select("_members")
             .mapInArrow(_pairs(max_bits), "u long, v long"))
    large = keys.join(sizes.where(F.col("_n") > bucket), "_key").select("_fp").distinct()
    near = large.select("_fp", F.expr("explode(transform(sequence(0, 64), i -> if(i = 64, _fp, _fp ^ shiftleft(1L, i))))").alias("_near"))
    groups = near.groupBy("_near").agg(F.min("_fp").alias("_least"), F.collect_list("_fp").alias("_members")).where(F.size("_members") > 1)
    if max_bits == 2:
        stars = groups.select(F.col("_least").alias("u"), F.explode("_members").alias("v"))
    else:  # one bit apart: the neighbour itself is a fingerprint
        stars = groups.where(F.array_contains("_members", F.col("_near"))).select(F.col("_near").alias("u"), F.explode("_members").alias("v")).where(F.lit(max_bits == 1))
    return links.unionByName(stars.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): every node with a link and the smallest node it reaches.

    Alternates large-star and small-star until the links are stars. Every
    round is stored, so no round's plan grows and a lost executor recomputes
    one round. Groups are reduced to their minimum before the join back, so
    a hub is one row per task."""
    edges = store(links.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u < v").distinct(), "edges")
    seen = _checksum(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        large = store(both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct(), "edges")
        low = store(large.groupBy("v").agg(F.min("u").alias("m")), "small-star")
        edges = store(large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct(), "edges")
        before, seen = seen, _checksum(edges)
        if seen == before:
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    """(rows, sums of two hashes): equal for equal sets of links."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))).first())


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, bucket: int = BUCKET, row_id: str | None = None) -> DataFrame:
    """Per document: doc_id, ``_row_id``, fingerprint (16 hex digits),
    component_id and ``keep``, true for one document of each component (the
    smallest doc_id, of repeated ones the smallest row id).

    ``row_id`` names a column of ``docs`` with a different long in every row
    to take as ``_row_id``; without it rows are numbered."""
    number = F.col(f"`{row_id}`") if row_id else F.monotonically_increasing_id()
    with_fp = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias(ROW_ID), F.col("text").alias("_text")).mapInArrow(
        _fingerprints(words), f"doc_id long, {ROW_ID} long, _fp long"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW_ID))
    fps = store(with_fp.groupBy("_fp").agg(first.alias("_first")), "fingerprint-groups")
    parts = components(fingerprint_links(fps, max_bits, bucket))
    rooted = store(fps.join(parts, fps["_fp"] == parts["node"], "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root")), "fingerprint-roots")
    chosen = store(rooted.groupBy("_root").agg(F.min("_first").alias("_chosen")), "chosen")
    found = rooted.join(chosen, "_root").select("_fp", F.col("_chosen.doc_id").alias("component_id"), F.col(f"_chosen.{ROW_ID}").alias("_kept"))
    return with_fp.join(found, "_fp").select(
        "doc_id", ROW_ID, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id",
        (F.col(ROW_ID) == F.col("_kept")).alias("keep"))


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each near-duplicate component."""
    moved, back = aside(docs, ROW_ID)
    numbered = with_row_id(moved, "near-dedup-input")
    kept = near_duplicates(numbered, words, max_bits, row_id=ROW_ID).where("keep").select(ROW_ID)
    return back(numbered.join(kept, ROW_ID, "left_semi").drop(ROW_ID)).select(*[F.col(f"`{c}`") for c in docs.columns])
