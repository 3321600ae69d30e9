"""A corpus from `documents`: language, exact and near duplicates, mixture, packed batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from auditloom.llm.exact_dedup import drop_exact_duplicates
from auditloom.llm.language_id import accepted_documents
from auditloom.llm.minhash import drop_near_duplicates
from auditloom.llm.mixing import mix_documents
from auditloom.llm.packing import pack_by_length
from auditloom.session import settle


def language_id(spark, docs, sf_dir):
    """Documents whose language can be told, by a model that learns from the labelled ones among them."""
    return accepted_documents(docs)


def exact_dedup(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def mix(spark, docs, sf_dir):
    """Documents of all sources by weight, some of them twice."""
    return mix_documents(docs)


def pack(spark, docs, sf_dir):
    """Pieces of the documents in token-budget batches of optimal length buckets."""
    return pack_by_length(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can express neither the language model nor the signatures; the stages are tested one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
