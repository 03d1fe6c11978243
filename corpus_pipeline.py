"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage reads what its predecessor kept and wrote. Stages return the
columns of ``documents`` (further columns of any name too, unchanged), the
last one the packed pieces.

Nulls: a null text has no language and goes in the first stage; given to a
later stage alone it stays, without lines, with fingerprint zero and without
benchmark words, and packs as the end token. Null ids, langs and sources are
values like any other. Empty tables stay empty. Of repeated rows and ties the
near-dedup stage keeps the one with the smallest id, then the first stored.
Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontamination, language_id, line_dedup, packing, queries, simhash
from fathom.llm.common import aside, new_path
from fathom.session import prepare, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    prepare(spark)
    moved, back = aside(docs, "lang_pred score rejected")
    known = language_id.predict(moved, language_id.fit(docs)).where(~F.col("rejected"))
    return back(known.select(*[F.col(f"`{c}`") for c in moved.columns]))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that more than a twentieth of the
    different texts of their source share."""
    prepare(spark)
    moved, back = aside(docs, "n_lines n_dropped")
    out = line_dedup.drop_boilerplate(moved).withColumn("n_chars", F.length("text").cast("long"))
    return back(out.select(*[F.col(f"`{c}`") for c in moved.columns]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return simhash.keep_one(docs, words=3, max_bits=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    prepare(spark)
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences."""
    prepare(spark)
    return packing.pack(docs, queries.tokenizer_path(), queries.SEQUENCE_TOKENS)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

# Language, fingerprints and bins are not expressible in SQL; tests/llm
# compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared
    checkpoint folder and read again."""
    prepare(spark)
    docs, folder = read_table(spark, sf_dir, "documents"), new_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
