"""Corpus pipeline: good documents, without repeated lines, one of each near-duplicate group, personal data masked, packed.

``STAGES`` are ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import line_dedup, packing, pii, quality, simhash_vptree
from edgeloom.session import bound_batches, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of the documents, in batches of bounded size wherever Python reads their texts."""
    bound_batches(spark)
    return docs.select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(_documents(spark, docs), quality.train(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document of smaller id also holds."""
    return line_dedup.drop_repeated_lines(_documents(spark, docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return simhash_vptree.keep_first(_documents(spark, docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the mark of its kind."""
    docs = _documents(spark, docs)
    return pii.mask(docs, pii.train(docs))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token windows."""
    return packing.pack(_documents(spark, docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("line_dedup", drop_repeated_lines), ("near_dedup", keep_one_of_near_copies), ("pii", mask_personal_data),
          ("packing", pack_documents)]
ORACLE_SQL = None           # a trained classifier and a trained tagger have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
