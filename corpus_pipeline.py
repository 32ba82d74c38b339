"""The corpus pipeline: five stages, each an operator of ``provena.llm`` over the rows
that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import langid, linededup, mixing, pieces, simhash
from provena.tables import cut, spent, spread


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, null texts and those
    under the least score go."""
    return langid.keep_known(docs, langid.fit(docs, F.lit(True)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand earlier in the corpus."""
    return linededup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document."""
    # workers still hold what earlier stages left to them: fewer lattices are remembered
    return pieces.encode(docs, remembered=1_000_000, together=100_000)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Hash-dealt models and lattices have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again,
    and deleted when the next one stands. The last stage's input stays for the lazy result."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            spent(before)
    return docs
