"""Language ID by nearest centroid.

A text's vector holds its hashed byte n-grams (one to three bytes of the
lower-cased text, everything but letters read as one space), weighted
(1 + log tf) * idf and scaled to length one. Each language has a few
centroids, found by spherical k-means on labelled texts. A text gets the
language of the centroid with the highest cosine; it is rejected when that
cosine is under the language's limit for texts of so many different n-grams
or the distance over ``max_distance``, or when it is null or has no letter
(then the prediction is ``und``, with score 0).

The limits come from the labelled sample: its texts, whole and cut to 16, 32,
64, ... letter bytes, are held against centroids of the other half of their
language's texts. By the number of different n-grams, in powers of two, the
limit is a low quantile of these cosines times ``MARGIN``. So short and
repetitive texts, which have few n-grams, need less than long ones.

The score is the cosine, clipped to 0..1. Ties go to the smaller language
name. The whole text is read, whatever its length.

Fitting reads a bounded sample: at most about ``sample_per_language``
different labelled texts a language, chosen by a hash of id and text, so the
model's size and time do not grow with the corpus; prediction covers every
row. The model is broadcast: 64 KB a language. Rows with a null or empty
language or without letters teach nothing. With no labelled rows at all every
prediction is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import chunks, pylist, store
from fathom.operators.joins import broadcast_if_small

DIMS = 1 << 12
UNKNOWN = "und"
SAMPLE_PER_LANGUAGE = 1_500
CENTROIDS = 4
MAX_DISTANCE = 0.9
CUTS = tuple(1 << k for k in range(4, 13))      # letter bytes to which labelled texts are cut for the limits
LEVELS = 13         # of 1, 2, 4, ... DIMS different n-grams
QUANTILE, MARGIN = 0.01, 0.7
PIECE = 1 << 20     # bytes of a text whose n-grams are counted at once
_SPACES = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def letter_bytes(text: str) -> bytes:
    """The lower-cased text, everything but letters read as one space."""
    return b" ".join(text.lower().encode().translate(_SPACES).split())


def ngram_counts(text: str | bytes) -> np.ndarray:
    """Hashed counts of the text's one- to three-byte n-grams; bytes are
    letter bytes already."""
    words = letter_bytes(text) if isinstance(text, str) else text
    b = np.frombuffer(b" " + words + b" ", np.uint8)
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(b), PIECE):
        x = b[at:at + PIECE + 2].astype(np.uint32)      # two more: n-grams across the cut
        one = x[:PIECE]
        h = [one * np.uint32(0x9E3779B1)]
        if len(x) > 1:
            two = (x[:-1][:PIECE] << np.uint32(8)) | x[1:][:PIECE]
            h.append((two + np.uint32(0x10000)) * np.uint32(0x85EBCA6B))
        if len(x) > 2:
            three = (x[:-2][:PIECE] << np.uint32(16)) | (x[1:-1][:PIECE] << np.uint32(8)) | x[2:][:PIECE]
            h.append((three + np.uint32(0x2000000)) * np.uint32(0xC2B2AE35))
        for k in h:
            out += np.bincount(k >> np.uint32(20), minlength=DIMS)
    return out


def vectors(texts: list[str] | list[bytes], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        n = ngram_counts(t)
        at = np.flatnonzero(n)
        out[i, at] = (1 + np.log(n[at])) * idf[at]
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centroids of unit length (fewer if there are fewer points). Starts
    from the mean, then from the points farthest from the centroids so far."""
    def unit(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v, axis=-1, keepdims=True)
        return v / np.where(n > 0, n, 1)

    centres = unit(x.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[np.argmin((x @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.vstack([unit(x[own == i].mean(axis=0, keepdims=True)) if (own == i).any() else centres[i:i + 1] for i in range(len(centres))])
    return centres


def learned_limits(texts: list[bytes], idf: np.ndarray, centroids: int) -> list[float]:
    """The least cosine of a text of each level (the log2 of its different
    n-grams), from the labelled texts of one language. Every text is held
    against centroids of the other half of the texts, so that none is measured
    against itself. A text needs no more than a longer one; a level without
    any longer ones has the limit of the level before it."""
    found: list[list[float]] = [[] for _ in range(LEVELS)]
    for own, others in ((texts[::2], texts[1::2]), (texts[1::2], texts[::2])):
        if not own or not others:
            continue
        centres = spherical_kmeans(vectors(others, idf), centroids)
        cuts = [c for t in own for c in [*(t[:n].strip() for n in CUTS if n < len(t)), t]]
        for at in range(0, len(cuts), 256):
            v = vectors(cuts[at:at + 256], idf)
            for k, c in zip(levels(v), (v @ centres.T).max(axis=1)):
                found[k].append(float(c))
    limits = [MARGIN * float(np.quantile(x, QUANTILE)) if x else math.inf for x in found]
    out = np.minimum.accumulate(limits[::-1])[::-1]
    last = max((x for x in out if x < math.inf), default=0.0)
    return [float(min(x, last)) for x in out]


def levels(v: np.ndarray) -> np.ndarray:
    """The log2 of the different n-grams of each vector, rounded down."""
    return np.log2(np.maximum(1, np.count_nonzero(v, axis=1))).astype(int)


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]        # sorted
    centroids: np.ndarray       # rows, grouped by language
    owner: np.ndarray           # language index of each row
    limits: np.ndarray          # languages x levels: the least cosine
    max_distance: float = MAX_DISTANCE

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        ok = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(ok), 256):
            part = ok[at:at + 256]
            own = vectors([texts[i] for i in part], self.idf)
            cosine = own @ self.centroids.T
            best = np.argmax(cosine, axis=1)        # the first of equal ones: languages are sorted
            least = self.limits[self.owner[best], levels(own)]
            for i, j, c, x in zip(part, best, cosine[np.arange(len(part)), best], least):
                score = float(min(1.0, max(0.0, c)))
                out[i] = (self.languages[self.owner[j]], score, bool(1.0 - score > self.max_distance or score < x))
        return out


def fit(labelled: DataFrame, id_col: str = "doc_id", sample_per_language: int = SAMPLE_PER_LANGUAGE,
        centroids: int = CENTROIDS, max_distance: float = MAX_DISTANCE) -> LanguageModel:
    """A model from ``labelled`` (``id_col``, text, lang)."""
    spark = labelled.sparkSession
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    share = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(float(sample_per_language)) / F.col("_n")).alias("_share"))
    dice = F.pmod(F.xxhash64(F.col("_id").cast("string"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = store(known.select(F.col(id_col).alias("_id"), "text", "lang").join(broadcast_if_small(share), F.col("lang") == F.col("_lang"))
                   .where(dice < F.col("_share")).select("lang", "text").distinct(), "language-sample")

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMS, np.int64)
        for b in batches:
            for t in pylist(b, "text"):
                if has_letter(t):
                    n, df = n + 1, df + (ngram_counts(t) > 0)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "df": pa.array([df.tolist()], pa.list_(pa.int64()))})

    n, df = 0, np.zeros(DIMS, np.int64)
    for r in picked.select("text").mapInArrow(document_counts, "n long, df array<long>").toLocalIterator():
        n, df = n + r["n"], df + np.array(r["df"])
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)
    held = spark.sparkContext.broadcast(idf)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        texts = [letter_bytes(t) for t in sorted(t for t in group["text"] if has_letter(t))]
        rows = spherical_kmeans(vectors(texts, held.value), centroids) if texts else np.zeros((0, DIMS))
        limits = learned_limits(texts, held.value, centroids)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(rows), "centroid": [c.astype(float).tolist() for c in rows], "limits": [limits] * len(rows)})

    found = sorted(((r["lang"], r["centroid"], r["limits"]) for r in picked.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<double>, limits array<double>").collect()), key=lambda r: r[0])
    limits = {lang: x for lang, _, x in found}
    languages = sorted(limits)
    return LanguageModel(idf, languages, np.array([c for _, c, _ in found], np.float32).reshape(-1, DIMS),
                         np.array([languages.index(lang) for lang, _, _ in found], np.int64),
                         np.array([limits[lang] for lang in languages]).reshape(-1, LEVELS), max_distance)


PREDICTED = "lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names in
    the input are replaced."""
    new = T.StructType.fromDDL(PREDICTED)
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new.names])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text, 16 << 20, 2048):
            got = held.value.predict(pylist(b, text))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())],
                names=[*b.schema.names, *new.names])
    return plain.mapInArrow(run, T.StructType([*plain.schema, *new]))


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m
