"""Corpus preparation as a chain of stages, each written as Parquet and read again.

language_id    rows whose text has no letter, or whose language is not clear, go
simhash_dedup  of each group of near-duplicates the row with the least doc_id stays; links are SimHash fingerprints within
               3 bits, as in op2 (three words), and texts whose five-word shingles have a Jaccard similarity of 0.8 or more
substring_dedup  words in repeated windows of 35 words are cut out of the texts
decontaminate  rows with a window of 10 words of a benchmark item go
sentencepiece  token ids of the texts, and whether they decode to the text again
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmere.llm import decontaminate, language_id, piece_bpe, shingle_dedup, substring_dedup
from plotmere.llm.shared import workspace

#: Differing bits at which the fingerprints of near-duplicates link.
NEAR_BITS = 3
#: Bytes of rows that go to Python at once: counted in rows, a batch of long texts would be held several times over on both sides.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage in Arrow batches that end with the row that passes BATCH_BYTES; the setting stays, as stages are evaluated when written."""

    @functools.wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_bounded


@bounded
def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows' own labels; keeps the rows whose language is told apart."""
    found = language_id.classify(docs, language_id.tiers(docs))
    return found.filter("not rejected").select(*docs.columns)


@bounded
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By SimHash, and by shingles where near texts lie more bits apart than anchors cover."""
    return shingle_dedup.one_of_each(docs, bits=NEAR_BITS).select(*docs.columns)


@bounded
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    return substring_dedup.strip(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@bounded
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.filter("n_hit = 0").select(*docs.columns)


@bounded
def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_again)."""
    coded = piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), checked=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_again")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_known_language),
    ("simhash_dedup", without_near_duplicates),
    ("substring_dedup", without_repeats),
    ("decontaminate", without_benchmark),
    ("sentencepiece", as_pieces),
]

#: The stages hash, compress and encode with methods that SQL lacks; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
