"""The corpus pipeline: each stage's rows, written as Parquet, are the next stage's documents.

toxicity (8), exact dedup (1), SimHash near-dedup (2), benchmark decontamination (9), BPE (3)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampledger.llm.bpe import encoding_digests, tokenizer_path
from ampledger.llm.common import cut, table
from ampledger.llm.decontaminate import drop_contaminated
from ampledger.llm.exact_dedup import drop_exact_duplicates
from ampledger.llm.simhash import drop_near_duplicates
from ampledger.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; those it is fitted on are the ones of ``docs``."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least id stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return encoding_digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Null and empty texts pass like any other; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, f"pipeline-{name}")
    return docs


#: A learnt lexicon, links by Hamming distance, tiling and BPE: SQL cannot express the stages.
ORACLE_SQL = None
