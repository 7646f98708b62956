"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Toxic documents go, then low-quality ones, then all but one of each group of near copies; the rest is packed into
sequences. Every stage works on all rows that the one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import ngram_join, packing, quality, toxicity
from quillstone.llm.queries import VOCABULARY
from quillstone.llm.util import free_names, scratch_table
from quillstone.sources import spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject.

    Null and empty texts have the score of no evidence and stay; repeated rows, and rows of tied scores, fare alike; an
    empty table gives an empty one; without labels none is rejected. Columns may have any names."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = free_names(docs, "toxicity", "toxic", "passages")
    found = toxicity.detect(docs, model, names=names)
    return found.where(found[names[1]] == 0).select(*[f"`{c}`" for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have the score of no evidence; a score of one half exactly is accepted; repeated rows fare alike;
    an empty table gives an empty one; without labels all are accepted. Columns may have any names."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = free_names(docs, "quality", "good")
    scored = quality.score(docs, model, names=names)
    return scored.where(scored[names[1]] == 1).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of least id, null ids last; of repeated rows one stays.

    Rows count by themselves, so a text without a copy stays whatever its id. Texts without words are no copies and stay,
    each of them; an empty table gives an empty one. Columns may have any names."""
    return ngram_join.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences.

    A null or empty text is its end id alone; repeated rows and null ids are packed as rows of their own; which of tied
    lengths goes where is fixed by their order in the partition; an empty table gives no pieces."""
    return packing.pieces(docs, VOCABULARY)


STAGES = [("toxicity", drop_toxic), ("quality classifier", keep_good), ("n-gram Jaccard join", drop_near_copies), ("packing", pack)]

#: Learned stages and tokenising are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch_table(docs, f"pipeline-{k}")
    return docs
