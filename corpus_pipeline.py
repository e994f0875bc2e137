"""A training-corpus pipeline: language ID, near-dedup, mixing, packing.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and all but the
last return the columns of their ``docs``.  :func:`run` writes each stage's rows to the
shared folder before the next one reads them, so a lost executor never costs more than a
stage's own work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crestline.llm._common import stage, table
from crestline.llm.language_id import drop_unidentified
from crestline.llm.mixing import mix_documents
from crestline.llm.packing import best_fit_packing
from crestline.llm.queries import tokenizer_path
from crestline.llm.shingle_dedup import drop_similar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a clear language."""
    return drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates."""
    return drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat the documents of small sources until sources meet their target weights."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut and pack the token ids of all documents into sequences."""
    return best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Trained weights, XXH64 and a tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = apply(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
