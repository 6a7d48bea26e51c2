"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secret scan, byte-level BPE.

Each stage takes the documents its predecessor kept and returns documents in
the same columns; the last returns the encoded texts. Rows without a doc_id
pass the near-duplicate and decontamination stages, which name documents by it.
Nulls, empty and very long texts, repeated rows and empty tables are handled as
the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinside.llm import bpe, copies, decontaminate, quality, secrets
from twinside.llm.common import table
from twinside.session import scratch, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return quality.clean_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of exact and near copies.

    Near copies agree to 0.8 in their sets of five-word shingles, which
    ``copies`` compares whole. Of several rows of one id the first by text,
    lang, source and n_chars stays. Only the ids that go outlast the search.
    """
    with scratch(spark):
        found = copies.near_copies(docs)
        gone = settle(found.filter("doc_id <> component_id").select("doc_id"), "gone", lasting=True)
        repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
        repeated = settle(repeated, "repeated", lasting=True)
    rest = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    several = rest.join(repeated, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return rest.join(repeated, "doc_id", "left_anti").unionByName(several)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean_of(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return secrets.redact_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of the ids and of the bytes decoded from them."""
    return bpe.encoded_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]
#: The lexer, fingerprints of XXH64 and BPE merges are beyond SQL; a test holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
