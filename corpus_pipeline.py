"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again.

Quality rules reject documents, one document stays of each group that SimHash and
an exact check find similar, secrets are masked, sources are mixed to their
target weights in whole copies of documents, and texts are encoded and decoded
again by byte-level BPE.

Defined cases, in every stage: null and empty texts are texts without words; an
empty table gives an empty table; columns of any name are kept; repeated rows and
rows of equal or null doc_id are rows of their own, and of equal texts one stays
in near_duplicates. quality_rules rejects texts without words, so the later
stages meet them only where they are called on other tables: near_duplicates
takes them for equal, secret_scan leaves them as they are, mixture drops them
(they weigh nothing), bpe gives them no ids. A long text is one row everywhere
and is held whole by one task at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, common, mixture, quality, secrets, shingles


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor exceed a certified cutoff."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id: SimHash families of five-word shingles, verified at a Jaccard similarity of 0.8."""
    return shingles.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with their secrets masked."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents, so many that the words of each source meet its target."""
    return mixture.taken_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents left."""
    return bpe.round_trip(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", mask_secrets), ("mixture", mix_sources), ("bpe", encode)]

#: No stage but the last few could be written in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir).select(*docs.columns), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
