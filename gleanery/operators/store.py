"""Documents as a table: listing, lookup, replacing, deleting, paging and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, EngineConfig
from gleanery.functions import text as T


def validated(uploads: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """uploads(filename, content_type, size_bytes) with status: 202 accepted, 413 too large, 415 not a PDF."""
    kind = F.when(F.coalesce("content_type", F.lit("")) == "", "application/pdf").otherwise(F.col("content_type"))
    pdf = (kind == "application/pdf") | F.lower("filename").endswith(".pdf")
    return uploads.withColumn("status", F.when(~pdf, 415).when(F.col("size_bytes") > config.max_upload_mb * 1024 * 1024, 413).otherwise(202))


def listed(docs: DataFrame) -> DataFrame:
    """Newest first, without what isn't public."""
    return docs.drop("storage_path", "document_map").orderBy(F.desc("created_at"), "id")


def get(docs: DataFrame, id: str) -> DataFrame:
    return docs.filter(F.col("id") == id)


def upserted(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of changes replace those of the same id or are added."""
    return docs.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def deleted(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """A table without the rows of deleted documents; to be applied to pages, chunks and postings too."""
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def paged(ch: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of each document's chunks by ordinal, without embedding, document's own id kept."""
    limit, offset = max(1, min(500, limit)), max(0, offset)
    return ch.filter((F.col("ordinal") >= offset) & (F.col("ordinal") < offset + limit)).drop("embedding", "overlap_prefix_len")


def detail(pages: DataFrame, ch: DataFrame) -> DataFrame:
    """document_id, page_number, preview, char_count, num_chunks."""
    n = ch.groupBy("document_id").agg(F.count("*").alias("num_chunks"))
    return pages.select("document_id", "page_number", F.left("text", F.lit(240)).alias("preview"), F.length("text").alias("char_count")).join(n, "document_id", "left").fillna({"num_chunks": 0})


def extracted(raw: DataFrame) -> DataFrame:
    """raw(document_id, text with form feeds) to pages: normalised, empty ones dropped, then numbered."""
    d = raw.select("document_id", F.posexplode(F.split("text", "\f", -1)).alias("i", "t")).withColumn("text", T.normalize_page(F.col("t"))).filter(T.trim(F.col("text")) != "")
    w = Window.partitionBy("document_id").orderBy("i")
    return d.select("document_id", F.row_number().over(w).alias("page_number"), "text", F.length("text").alias("char_count"))
