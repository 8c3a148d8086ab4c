"""The corpus pipeline: language ID, exact dedup, near-duplicate join, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but
the last return the columns of ``docs`` unchanged.  ``run`` writes every stage's rows as
Parquet to the shared folder and rereads them as the next stage's documents.

A document goes when: it has no letters (language ID), an equal text stays in its place
(exact dedup), it is not the smallest id of its near-duplicate group, or it holds a benchmark
item.  Empty tables pass through every stage; null texts are rejected by the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teebox.llm import bpe, decontaminate, exact_dedup, langid, ngram_join, queries, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null texts and texts without letters go."""
    model = langid.fit(docs)
    lang, score = _free("_lang_pred", docs), _free("_lang_score", docs)
    named = langid.annotate(docs, model, lang_out=lang, score_out=score)
    return named.filter(F.col(lang) != langid.UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(name: str, docs: DataFrame) -> str:
    """A column name like ``name`` that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents that are left."""
    return bpe.digests(bpe.encode_decode(docs, queries.vocabulary()))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: Language models, R-trees, latent search and BPE are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
