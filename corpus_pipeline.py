"""The corpus pipeline: quality, lines, near duplicates, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshape.llm import bpe, decontaminate, line_dedup, minhash, quality
from docshape.llm.queries import table, vocabulary_path
from docshape.llm.staging import materialize


def _same_row(a: str, b: str, mark):
    """Rows that agree in doc_id (null-safe) and in the mark of their text."""
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (mark == F.col(f"{b}.mark"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably (P >= 0.5) of the best grade stay.

    The model is fitted on rated documents of the input, at most ``quality.SAMPLE``; without any
    ratings everything stays.
    """
    model = quality.train(spark, docs, quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.select(docs, model)


def line_spread_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go, but for their first occurrence; n_chars follows the text.

    A document that loses all its lines so (every line of it stays elsewhere) goes; one that had
    none to begin with stays.
    """
    return line_dedup.without_boilerplate(spark, docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    judged = minhash.near_duplicates(spark, docs, words_per_shingle=5, percent=80)
    gone = materialize(spark, judged.where(~F.col("kept")).select("doc_id", "mark").distinct(), "pipeline-near")
    return docs.alias("d").join(gone.alias("g"), _same_row("d", "g", F.xxhash64("d.text")), "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 13 consecutive words of a benchmark item go, however long they are, and those of
    whose words a twentieth or more is inside items shorter than that."""
    return decontaminate.without_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    found = bpe.round_trip(spark, docs, bpe.read_ranks(vocabulary_path()))
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_spread_dedup", line_spread_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: The classifier is trained and the tokenizer merges by rank: SQL can't express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
