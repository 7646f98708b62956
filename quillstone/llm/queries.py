"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import spread
from . import bpe, covertree, fingerprints, html_extract, licenses, ngram_join, packing, quality, sharding, toxicity
from .util import crc_fold

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; one of fewer partitions than there are slots is spread, as each row takes much computing."""
    return spread(_table(spark, sf_dir, name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_spread(spark, sf_dir, "documents"), VOCABULARY)


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(_spread(spark, sf_dir, "embeddings"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_spread(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_spread(spark, sf_dir, "documents"), VOCABULARY)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_fold("doc_id", quality.FOLDS) == quality.HELD_OUT).alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_spread(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.detect(docs, model)
    held_out = (crc_fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out")
    return found.select("doc_id", held_out, "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_covertree": op2_covertree,
    "op3_html": op3_html,
    "op4_licenses": op4_licenses,
    "op5_fingerprints": op5_fingerprints,
    "op6_bpe": op6_bpe,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_ngram_join": op9_ngram_join,
    "op10_toxicity": op10_toxicity,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op4_licenses": licenses.oracle_sql()}
