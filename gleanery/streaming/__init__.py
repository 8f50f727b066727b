"""Ingestion as a stream of files: the state of each document, and tables that a repeated batch leaves as they are.

Every table of a library's folder is partitioned by batch. A batch overwrites its own partitions and no others,
so that a batch that runs again after a failure changes nothing. What counts of a document is its newest record; the rows of
other tables count where their batch is that of the newest record and the document is ready.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery import sources
from gleanery.functions import text as T
from gleanery.operators import chunking, corpus, store
from gleanery.operators.corpus import Corpus

# The states a document goes through, and the phases of its ingestion with what they're called.
STATES = ("pending", "processing", "ready", "failed")
PHASES = {
    "queued": "Queued",
    "extracting": "Extracting text",
    "chunking": "Segmenting into chunks",
    "embedding_chunks": "Embedding chunks",
    "summarizing_sections": "Embedding section summaries",
    "indexing": "Building retrieval index",
    "finalizing": "Saving",
}
DOCUMENT = "id string, filename string, content_type string, size_bytes long, num_pages int, status string, created_at timestamp, updated_at timestamp, error string, storage_path string"
POSTINGS = "document_id string, chunk_id string, ordinal int, dl int, term string, tf long, part int, batch long"
TABLES = ("pages", "chunks", "postings", "frequencies", "lengths", "vectors", "sections", "meta")
DELETED = "deleted"


def extracted(files: DataFrame, extract: Callable[[bytes], str]) -> DataFrame:
    """document_id, text (form feeds between pages), error: what the extractor raised for a document, which stops no other."""

    def one(content: bytes) -> tuple[str | None, str | None]:
        try:
            return extract(content), None
        except Exception as e:  # the document's own state tells of it
            return None, str(e) or "Ingestion failed."

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame([(i, *one(c)) for i, c in zip(x["document_id"], x["content"], strict=True)], columns=["document_id", "text", "error"])

    return files.select("document_id", "content").mapInPandas(run, "document_id string, text string, error string")


def _progress(spark: SparkSession, ids: DataFrame, folder: str, batch: int, phase: str, total: int = 0) -> None:
    row = ids.select(F.col("id").alias("document_id"), F.lit(phase).alias("phase"), F.lit(PHASES[phase]).alias("phase_label"), F.lit(list(PHASES).index(phase)).alias("current"), F.lit(total or len(PHASES)).alias("total"), F.current_timestamp().alias("updated_at"))
    sources.write(row, f"{folder}/progress/batch={batch}")


def ingest(documents: DataFrame, raw: DataFrame, folder: str, batch: int) -> DataFrame:
    """Bring documents (as DOCUMENT, pending) with their raw texts (document_id, text, error) into a folder; returns their records.

    Records go from processing to ready, or to failed with what went wrong. An empty text is a document of no pages, and ready.
    """
    spark = documents.sparkSession
    put = lambda df, name: sources.write(df, f"{folder}/{name}/batch={batch}")
    held = lambda name: spark.read.parquet(f"{folder}/{name}/batch={batch}")
    put(documents.withColumns({"status": F.lit("processing"), "error": F.lit(None).cast("string"), "updated_at": F.current_timestamp()}), "documents")
    known = held("documents").select("id")
    _progress(spark, known, folder, batch, "extracting")
    put(raw.withColumn("error", F.when(F.col("text").isNull(), F.coalesce("error", F.lit("Ingestion failed.")))), "raw")
    raw = held("raw")
    put(store.extracted(raw.filter("text is not null").select("document_id", "text")), "pages")
    _progress(spark, known, folder, batch, "chunking")
    put(chunking.chunks(held("pages")).hint("rebalance"), "chunks")
    made = corpus.derived(held("chunks"))
    _progress(spark, known, folder, batch, "embedding_chunks")
    put(made.vectors, "vectors")
    _progress(spark, known, folder, batch, "summarizing_sections")
    put(made.sections, "sections")
    _progress(spark, known, folder, batch, "indexing")
    sources.write(made.postings.repartition(corpus.PARTS, "part"), f"{folder}/postings/batch={batch}", "part")
    # Counts of one document each: those over all are summed when read, and so stay right when documents go.
    postings = spark.read.schema(made.postings.schema).parquet(f"{folder}/postings/batch={batch}")
    put(postings.groupBy("document_id", "term", "part").agg(F.count("*").alias("df")), "frequencies")
    put(held("chunks").select("document_id", F.size(T.lexical_tokens(F.col("text"))).cast("long").alias("dl")).groupBy("document_id").agg(F.count("*").alias("n"), F.sum("dl").alias("total")), "lengths")
    put(made.meta, "meta")
    _progress(spark, known, folder, batch, "finalizing")
    pages = held("pages").groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("pages"))
    failed = raw.filter("error is not null").select(F.col("document_id").alias("id"), F.col("error").alias("why"))
    missing = F.when(F.col("found").isNull(), F.lit("Ingestion failed."))
    d = documents.join(pages, "id", "left").join(failed, "id", "left").join(raw.select(F.col("document_id").alias("id"), F.lit(True).alias("found")).distinct(), "id", "left")
    d = d.withColumn("error", F.coalesce("why", missing))
    d = d.withColumns({"status": F.when(F.col("error").isNull(), "ready").otherwise("failed"), "num_pages": F.when(F.col("error").isNull(), F.coalesce("pages", F.lit(0))), "updated_at": F.current_timestamp()})
    put(sources.written(d.select(*[f.split()[0] for f in DOCUMENT.split(", ")])), "documents")
    sources.remove(spark, f"{folder}/progress/batch={batch}")
    sources.remove(spark, f"{folder}/raw/batch={batch}")
    return held("documents")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The newest record of each document that isn't deleted, and its batch."""
    d = spark.read.schema(f"{DOCUMENT}, batch long").parquet(f"{folder}/documents")
    newest = d.groupBy("id").agg(F.max("batch").alias("batch"))
    return d.join(newest, ["id", "batch"]).filter(F.col("status") != DELETED)


def held(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a table that count: those of ready documents' newest batches."""
    now = records(spark, folder).filter("status = 'ready'").select(F.col("id").alias("document_id"), "batch")
    read = spark.read.schema(POSTINGS) if name == "postings" else spark.read  # none may have been written for lack of a word
    return read.parquet(f"{folder}/{name}").join(now, ["document_id", "batch"], "left_semi").drop("batch")


def library(spark: SparkSession, folder: str) -> Corpus:
    """The corpus of a folder's ready documents, as search wants it."""
    t = {name: held(spark, folder, name) for name in TABLES}
    own = t["frequencies"].select(F.col("document_id").alias("scope"), "term", F.col("df"), "part")
    every = t["frequencies"].groupBy("term", "part").agg(F.sum("df").alias("df")).select(F.lit("__all__").alias("scope"), "term", "df", "part")
    one = t["lengths"].select(F.col("document_id").alias("scope"), "n", (F.col("total") / F.col("n")).alias("avgdl"))
    whole = t["lengths"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total") / F.sum("n"), F.lit(0.0)).alias("avgdl")).select(F.lit("__all__").alias("scope"), "n", "avgdl")
    return Corpus(chunks=t["chunks"], postings=t["postings"], frequencies=own.unionByName(every), stats=one.unionByName(whole), vectors=t["vectors"], sections=t["sections"], meta=t["meta"])


def uploads(files: DataFrame, content_type: str = "application/pdf") -> DataFrame:
    """Records of files (document_id, size_bytes, content), pending. One file read twice in a batch is one document."""
    now = F.current_timestamp()
    d = files.select(
        F.col("document_id").alias("id"), F.element_at(F.split("document_id", "/"), -1).alias("filename"), F.lit(content_type).alias("content_type"), F.col("size_bytes").cast("long").alias("size_bytes"), F.lit(None).cast("int").alias("num_pages"),
        F.lit("pending").alias("status"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("error"), F.col("document_id").alias("storage_path"),
    )
    return d.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("size_bytes"))).filter("at = 1").drop("at")


def watch(spark: SparkSession, glob: str, folder: str, extract: Callable[[bytes], str], checkpoint: str):
    """Start a stream that ingests new files, a batch at a time; a batch that is repeated overwrites itself."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(glob).selectExpr("path as document_id", "length as size_bytes", "content")

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            ingest(uploads(df), extracted(df, extract), folder, number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
