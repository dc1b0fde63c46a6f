"""Corpus pipeline over documents: each stage calls one text operator; its result is written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rainshade.llm import mixing, packing, quality
from rainshade.llm.common import keep_documents, spare_names, stored
from rainshade.llm.exact import exact_duplicates
from rainshade.llm.similar import similar_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade (good and clean) is likelier than not, by a model of the rated documents."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.fit(docs, quality.graded(labels), n_grades=3)
    name = spare_names(docs, "_quality")[0]
    return quality.scored(docs, model, grade=2, name=name).filter(quality.selected(name)).select(*[f"`{c}`" for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return keep_documents(docs, exact_duplicates(docs).filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more over five-word shingles the one with the smallest id stays."""
    found = similar_documents(docs)
    return keep_documents(docs, found.filter("doc_id <=> component_id and version = component_version"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered shares of source, language and topic."""
    name = spare_names(docs, "_mix")[0]
    return mixing.mix(docs, name=name).filter(f"{name}.sampled").select(*[f"`{c}`" for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", near_stage),
          ("mixing sources to target weights", mixing_stage), ("packing", packing_stage)]

# packing works on the ids of a tokenizer and near duplicates on XXH64, which SQL has not; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
