"""The lexical index: postings, term and corpus statistics, for each document and for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import counting
from gleanery.operators.embedding import NAMES

ALL = "__all__"
VERSION, CHUNK_FORMAT, TOKENIZER, EMBEDDER = 1, 1, "retrieval-tokenizer-v1", NAMES["hash"]


def term_frequencies(ch: DataFrame) -> DataFrame:
    """document_id, chunk_id, ordinal, term, tf."""
    return counting.lexical(ch, ["document_id", "chunk_id", "ordinal"], "text").drop("dl")


def chunk_lengths(ch: DataFrame) -> DataFrame:
    """document_id, chunk_id, ordinal, dl: zero for chunks without a token."""
    return ch.select("document_id", "chunk_id", "ordinal", counting.length(F.col("text")).alias("dl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """scope, term, df, for each document and for all at once."""
    own = tf.groupBy("document_id", "term").agg(F.count("*").alias("df"))
    # Those of all documents are sums of each one's, whose shuffle is used again.
    every = own.groupBy("term").agg(F.sum("df").alias("df")).select(F.lit(ALL).alias("scope"), "term", "df")
    return own.select(F.col("document_id").alias("scope"), "term", "df").unionByName(every)


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """scope, n, avgdl."""
    g = lengths.groupingSets([["document_id"], []], "document_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.grouping("document_id").alias("g"))
    return g.select(F.when(F.col("g") == 1, ALL).otherwise(F.col("document_id")).alias("scope"), "n", F.coalesce("avgdl", F.lit(0.0)).alias("avgdl"))


def inverted(tf: DataFrame) -> DataFrame:
    """document_id, term, postings by ordinal."""
    return tf.groupBy("document_id", "term").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "tf"))).alias("postings"))


def metadata(ch: DataFrame) -> DataFrame:
    return ch.groupBy("document_id").agg(F.count("*").alias("chunk_count")).select(
        "document_id", F.lit(VERSION).alias("version"), "chunk_count", F.lit(CHUNK_FORMAT).alias("chunk_format_version"), F.lit(TOKENIZER).alias("tokenizer"), F.lit(EMBEDDER).alias("embedder_model")
    )


def valid(meta: DataFrame, ch: DataFrame) -> DataFrame:
    """document_id, valid: does the stored index fit the chunks, the tokeniser and the embedder?"""
    now = metadata(ch).select("document_id", F.struct("version", "chunk_count", "chunk_format_version", "tokenizer", "embedder_model").alias("now"))
    held = meta.select("document_id", F.struct("version", "chunk_count", "chunk_format_version", "tokenizer", "embedder_model").alias("held"))
    return now.join(held, "document_id", "left").select("document_id", F.coalesce(F.col("now") == F.col("held"), F.lit(False)).alias("valid"))
