"""A training corpus from raw documents: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode
from tessera.llm.jaccard import one_of_each
from tessera.llm.mixing import mixed_documents
from tessera.llm.quality import quality_filter
from tessera.llm.storage import kept, new_folder, scratch, shuffles_dropped
from tessera.llm.substrings import substring_dedup


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others stay as they are.

    A null text counts as empty, null metadata is a value of its own; long texts are judged whole; repeated rows share a
    verdict; an empty table stays empty; other columns, whatever their names, are carried.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, a null id last, of repeated rows one.

    A null, empty or blank text is like no other, so it stays; other columns, whatever their names, are carried.
    """
    return one_of_each(docs)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows go; a text that loses none stays as it is, null and empty ones, too.

    Rows are as many as before; n_chars, if it is there, counts what is left; other columns, whatever their names, are carried.
    """
    cut = substring_dedup(docs, as_is=True).select("doc.*", F.col("kept_text").alias("text"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the weights of their sources ask for, at most three times; those without words go.

    A null source is one of its own; rows that agree in id and text share what they are taken; other columns, whatever their names, are carried.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their number, one row for each document of the mix. A null or empty text has none; the ids stand for whole texts; other columns go."""
    import public_tokenizers

    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("decoded")


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", near_duplicates), ("substring dedup", cut_substrings), ("mixing sources", mix), ("byte-level BPE", encode)]

#: No SQL for the classifier and for byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        label = "pipeline-" + name.replace(" ", "-")
        path = new_folder(spark, label)
        with scratch(spark), shuffles_dropped(spark):
            docs = kept(stage(spark, docs, sf_dir), label, path)
    return STAGES[-1][1](spark, docs, sf_dir)
