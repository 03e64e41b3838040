"""The corpus pipeline: documents become packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each result as Parquet to the shared folder and reads it
again as the next stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import decontam, langid, line_dedup, packing, simhash, similar
from proofline.llm.common import Scratch, crc_mod, table
from proofline.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, as do those whose best language has a score under 0.3. The network learns from documents' lang."""
    return langid.drop_unidentified(docs, langid.fit(docs, crc_mod(F.col("doc_id"), 4) != 2), min_score=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go if an earlier one is equal or, from five words on, one word's edit away; documents left without any text go."""
    return line_dedup.drop_lines(docs, min_words=5, exact_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose fingerprints link, the one with the smallest doc_id stays; of those left, documents go
    that share 80 percent or more of their five-word shingles with an earlier one."""
    firsts = Scratch(spark, "near_duplicates").keep(simhash.keep_first(docs, width=4, error=4), "firsts")  # read several times
    return similar.keep_unlike(firsts, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if benchmark windows of 13 words cover 5 percent of their words or more."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13, percent=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096."""
    return packing.pack(docs, tokenizer(), end_id=2, size=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Neither the network nor the fingerprints nor the tokenizer can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
