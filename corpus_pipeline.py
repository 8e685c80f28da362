"""Corpus pipeline: language ID, near-duplicate removal, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinemill.llm.common import scratch_path, table, tokenizer_path
from kinemill.llm.language import UNDETERMINED, identify, train
from kinemill.llm.near import one_of_each
from kinemill.llm.packing import pack_documents
from kinemill.llm.spans import dedup_spans

PREDICTED = "_lang_pred"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (their text is like texts of a learned one); a null lang becomes the predicted one."""
    found = identify(docs, train(docs, bounds=True), docs.columns, reject=True, result_cols=(PREDICTED, "_score"))
    told = found.columns[len(docs.columns)]  # its name, unless docs has a column of it
    return found.where(F.col(told) != UNDETERMINED).withColumn("lang", F.coalesce("lang", told)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the sentences of passages that an earlier document has; n_chars follows the text."""
    return dedup_spans(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("ngram_jaccard", near_duplicates), ("substring_dedup", repeated_passages), ("packing", packing)]

#: Learned weights, MinHash and tokenisation have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
