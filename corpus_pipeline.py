"""A corpus in five stages, each an operator of gleanery.llm over all that its predecessor kept.

Language ID drops documents without a confident language; line dedup cuts boilerplate lines out
of texts; SimHash near-dedup keeps one document of each group; mixing keeps, cuts or repeats
documents as the source targets ask; SentencePiece gives the ids of each text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import language_id, line_dedup, mixing, sentencepiece_wfst, simhash
from gleanery.llm.common import checkpoint_folder, remove_at_exit


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of at least language_id.LEAST_SCORE.

    Null texts, empty ones and those without a letter go; long texts are read whole; rows with one text stay or go
    together, and so do repeated rows; an empty table stays empty; columns of any name are kept as they are.
    """
    return language_id.confident(docs, language_id.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, boilerplate lines cut out of their texts.

    Null texts stay null and empty ones empty; a line on just as many sites as the threshold goes; repeated rows are
    cut alike; an empty table stays empty; columns of any name are kept, and only text and n_chars (its length) change.
    """
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints at two or fewer differing bits, found through the
    pivot tables as op4 does, or else, with five words a shingle, a similarity of 0.8 or more.

    The smallest doc_id stays (null last, ties by a hash of the text); of repeated rows one; all null and empty texts
    are one group; an empty table stays empty; columns of any name are kept as they are.
    """
    return simhash.one_of_each(docs, bits=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated for second epochs, in the order of its slots.

    Texts without words (null, empty) have no tokens to take and go; a source's last text may be cut; the null source is a source, last in
    order; repeated rows are each taken; an empty table stays empty; columns of any name are kept, and only text and n_chars change.
    """
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, a row for each row. Null texts have null ids, empty ones none; an empty table gives an empty result; other columns go."""
    return sentencepiece_wfst.encoded(docs.select("doc_id", "source", "text")).drop("text")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: Language ID, SimHash and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        remove_at_exit(spark, path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
