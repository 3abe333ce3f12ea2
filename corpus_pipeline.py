"""Corpus pipeline: quality, toxicity, near duplicates, mixing, packing.

Every stage is a function (spark, docs, sf_dir) of all documents that its predecessor kept.  The two filters
are trained on the labelled rows among their own input; rows held out by crc32 of the id teach neither.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import mixing, nearset, packing, quality, toxicity
from llm.common import shared_folder, split_of, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more.

    Null, empty and blank texts are scored as empty ones; rows with a null doc_id are scored like others and
    teach nothing; repeated rows all stay or all go; texts of any length are scored whole.  Without labels of
    both classes the one class known decides, and without any all stay.  All columns pass, whatever their names
    but ``quality_score_``.  No rows give no rows.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), split_of("doc_id", 4) != 2)
    return quality.with_score(docs, model, "quality_score_").where(F.col("quality_score_") >= quality.THRESHOLD).drop("quality_score_")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3.

    As in the quality stage: null texts count as empty, null ids teach nothing, repeated rows share their fate,
    further columns pass (but ``toxicity_score_``).  Without labels of both classes the one class known decides,
    and without any all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), split_of("doc_id", 4) != 2)
    return toxicity.with_score(docs, model, "toxicity_score_").where(F.col("toxicity_score_") < toxicity.THRESHOLD).drop("toxicity_score_")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id, and one row of each doc_id.

    Null, empty and blank texts are near nothing and stay, one row of each id; those with a null id all stay.  Of
    a group whose ids are all null one row stays.  Further columns pass, whatever their names.
    """
    return nearset.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, up to three times.

    Texts without words, null ones among them, are not taken; a null source is a source of its own.  Rows that
    repeat id, source and text share out what the mix takes of them; ties are settled by a seeded hash.  Further
    columns pass, whatever their names.
    """
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens: the rows of ``packing.pack``.

    A null text is an empty one, which is one end token; repeated rows are packed each.  Only doc_id and text
    are read.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers and the tokenizer can't be written in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
