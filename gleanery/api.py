"""The library as its users see it: documents in, their state and parts, search and answers.

Each call is one request of the service, with the same defaults, limits and errors; what it returns is a
DataFrame, or a plain value where there is one. Errors carry the service's status.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import sources, streaming
from gleanery.config import DEFAULT, EngineConfig
from gleanery.operators import answering, search, store

VERSION = "0.2.0"


class ApiError(Exception):
    """A refused request: 404 not found, 413 too large, 415 not a PDF."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


class Timer:
    """Milliseconds by phase."""

    def __init__(self) -> None:
        self.began, self.ms = time.perf_counter(), {}

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        yield
        self.ms[name] = round((time.perf_counter() - began) * 1000, 3)

    def total(self, name: str = "total") -> dict[str, float]:
        return self.ms | {name: round((time.perf_counter() - self.began) * 1000, 3)}


class Library:
    def __init__(self, spark: SparkSession, folder: str, extract: Callable[[bytes], str], config: EngineConfig = DEFAULT):
        self.spark, self.folder, self.extract, self.config = spark, folder, extract, config

    def health(self) -> dict[str, str]:
        return {"status": "ok", "version": VERSION}

    def _next(self) -> int:
        """The next batch: batches of a library are written one after another."""
        path = f"{self.folder}/documents"
        return 1 + (self.spark.read.parquet(path).agg(F.max("batch")).first()[0] or 0) if sources.exists(self.spark, path) else 0

    def upload(self, glob: str, content_type: str = "application/pdf") -> DataFrame:
        """Ingest files; refused as a whole if one of them is too large or no PDF."""
        files = sources.uploads(self.spark, glob)
        checked = store.validated(streaming.uploads(files, content_type), self.config).filter("status <> 202").select("status").distinct().collect()
        if any(r["status"] == 415 for r in checked):
            raise ApiError(415, "Only PDF uploads are accepted.")
        if checked:
            raise ApiError(413, f"File exceeds max upload size of {self.config.max_upload_mb} MB.")
        return self._ingest(streaming.uploads(files, content_type), files)

    def _ingest(self, documents: DataFrame, files: DataFrame) -> DataFrame:
        return store.listed(streaming.ingest(documents, streaming.extracted(files, self.extract), self.folder, self._next()))

    def retry(self, id: str) -> DataFrame:
        """Ingest a document again from its stored file."""
        d = self._record(id).drop("batch").withColumns({"status": F.lit("pending"), "error": F.lit(None).cast("string")})
        path = d.first()["storage_path"]
        return self._ingest(d, sources.uploads(self.spark, path).withColumn("document_id", F.lit(id)))

    def delete(self, id: str) -> None:
        """Mark a document deleted; none of its rows counts from then on."""
        gone = self._record(id).drop("batch").withColumn("status", F.lit(streaming.DELETED))
        sources.write(sources.written(gone), f"{self.folder}/documents/batch={self._next()}")

    def documents(self) -> DataFrame:
        return store.listed(streaming.records(self.spark, self.folder)).drop("batch")

    def _record(self, id: str) -> DataFrame:
        d = store.get(streaming.records(self.spark, self.folder), id)
        if d.isEmpty():
            raise ApiError(404, "Document not found.")
        return d

    def document(self, id: str) -> DataFrame:
        """The record with the number of chunks."""
        d = self._record(id).drop("batch", "storage_path")
        return d.withColumn("num_chunks", F.lit(self._table("chunks", id).count()))

    def status(self, id: str) -> dict:
        """status, error and, while it's processed, the progress."""
        r = self._record(id).first()
        path = f"{self.folder}/progress/batch={r['batch']}"
        p = self.spark.read.parquet(path).filter(F.col("document_id") == id).first() if sources.exists(self.spark, path) else None
        return {"id": id, "status": r["status"], "error": r["error"], "progress": p.asDict() if p else None}

    def _table(self, name: str, id: str) -> DataFrame:
        return streaming.held(self.spark, self.folder, name).filter(F.col("document_id") == id)

    def chunks(self, id: str, offset: int = 0, limit: int = 100) -> DataFrame:
        self._record(id)
        return store.paged(self._table("chunks", id), offset, limit)

    def chunk(self, id: str, ordinal: int) -> DataFrame:
        self._record(id)
        return self._found(self._table("chunks", id).filter(F.col("ordinal") == ordinal), "Chunk not found.")

    def page(self, id: str, number: int) -> DataFrame:
        self._record(id)
        return self._found(self._table("pages", id).filter(F.col("page_number") == number), "Page not found.")

    def map(self, id: str) -> DataFrame:
        self._record(id)
        return self._found(self._table("sections", id).drop("embedding"), "Document map not available.")

    def _found(self, df: DataFrame, otherwise: str) -> DataFrame:
        if df.isEmpty():
            raise ApiError(404, otherwise)
        return df

    def _query(self, query: str, document_id: str | None) -> DataFrame:
        return self.spark.createDataFrame([(0, query, document_id)], "query_id int, query string, document_id string")

    def search(self, query: str, mode: str = "hybrid", top_k: int = 20, document_id: str | None = None) -> tuple[DataFrame, dict]:
        """Results with their scores, and facts on the search: chunks searched, hits, routed sections, milliseconds by phase."""
        timer, config, q = Timer(), replace(self.config, top_k=top_k), self._query(query, document_id)
        with timer.phase("load_index"):
            corpus = streaming.library(self.spark, self.folder)
        with timer.phase(f"{mode}_search"):
            hits = sources.written(search.search(q, corpus, mode, config))
        with timer.phase("facts"):
            meta = search.facts(q, corpus, hits, mode, config).first().asDict(True)
        return search.results(hits).drop("query_id").orderBy("rank"), meta | {"timing_ms": timer.total("search_total")}

    def answer(self, query: str, top_k: int = 8, document_id: str | None = None, generate: Callable[[str, str], str] | None = None) -> dict:
        """The answer to one question; without a model the stub answers."""
        timer, config = Timer(), replace(self.config, answer_top_k=top_k)
        corpus = streaming.library(self.spark, self.folder)
        found = answering.answer(self._query(query, document_id), corpus, config, generate).drop("query_id").first().asDict(True)
        return found | {"timing_ms": timer.total()}
