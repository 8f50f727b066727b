"""The searchable corpus: chunks and the retrieval index, derived from pages or read from a folder.

An index is written once, when documents are ingested, or each of its tables when a query first needs it, and search reads
from it what its queries name: each file of document frequencies, and each few thousand chunks' postings, are ordered by PARTS hash values of the term, so that a dozen terms
read the pages of a dozen of them at most; vectors lie, as counts, beside the chunk's place in its document.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import sources
from gleanery.functions import counting
from gleanery.operators import chunking, embedding, index

PARTS = 16


def part_of(term):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Corpus:
    chunks: DataFrame  # as operators.chunking gives them
    postings: DataFrame  # part, term, document_id, chunk_id, ordinal, tf, dl
    frequencies: DataFrame  # part, scope, term, df
    stats: DataFrame  # scope, n, avgdl
    vectors: DataFrame  # chunk_id, document_id, ordinal, embedding
    sections: DataFrame  # the document map with summaries, keywords and summary embeddings
    meta: DataFrame  # what the index was made with

    def stored(self, name: str) -> bool:
        """Is a table there, or is it still to be made from the chunks?"""
        return True

    def of(self, documents: DataFrame, key: str = "document_id") -> Corpus:
        """The corpus as searched for some documents only. Statistics over all documents are made anew."""
        some = documents.select(F.col(key).alias("document_id")).distinct()
        kept = {f.name: getattr(self, f.name) for f in fields(self)}
        kept |= {k: kept[k].join(some, "document_id", "left_semi") for k in ("chunks", "postings", "vectors", "sections", "meta")}
        return Corpus(**kept | {"frequencies": _frequencies(kept["postings"]), "stats": _stats(_lengths(kept["chunks"]))})


def _lengths(ch: DataFrame) -> DataFrame:
    return ch.select("document_id", counting.length(F.col("text")).alias("dl"))


def _stats(lengths: DataFrame) -> DataFrame:
    return index.corpus_stats(lengths)


def _frequencies(postings: DataFrame) -> DataFrame:
    return index.document_frequencies(postings).withColumn("part", part_of("term"))


def _postings(ch: DataFrame) -> DataFrame:
    """Counted within each chunk, so that nothing is shuffled."""
    return counting.lexical(ch, ["document_id", "chunk_id", "ordinal"], "text", PARTS).withColumn("part", part_of("term"))


def _counts(ch: DataFrame) -> DataFrame:
    return embedding.counts(ch, ["chunk_id", "document_id", "ordinal"], "text")


def _vectors(counts: DataFrame) -> DataFrame:
    return embedding.filled(counts, "runs").drop("runs")


def _sections(ch: DataFrame) -> DataFrame:
    d = chunking.enriched(ch).withColumn("section_id", F.concat_ws("#", "document_id", "section_no"))
    return d.join(embedding.dense(d, "section_id", "summary"), "section_id")


def derived(ch: DataFrame) -> Corpus:
    """The corpus of a table of chunks, computed wherever it's used."""
    postings = _postings(ch)
    return Corpus(ch, postings, _frequencies(postings), _stats(_lengths(ch)), _vectors(_counts(ch)), _sections(ch), index.metadata(ch))


class Growing(Corpus):
    """A corpus of pages in a folder, of which each table is written when it's first asked for, made from those that it needs; `held` names those that are written."""

    def __init__(self, pages: DataFrame, folder: str, held: set[str]) -> None:
        self.__dict__.update(_pages=pages, _folder=folder, _held=held)

    def stored(self, name: str) -> bool:
        return name in self._held

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _MADE:
            raise AttributeError(name)
        path = f"{self._folder}/{name}"
        if name not in self._held:
            # Chunks stay as the session compresses them: tasks that read them take so many bytes of a file each.
            sources.write(_MADE[name](self), path, compression=None if name == "chunks" else "zstd")
            self._held.add(name)
        return _opened(self._pages.sparkSession, self._folder, name)


@dataclass(frozen=True)
class Scan:
    """What a set of queries needs to know of all chunks, without an index: the postings of its terms, statistics, and the chunks that its vectors can find."""

    postings: DataFrame  # as a corpus has them, of the terms asked
    frequencies: DataFrame
    stats: DataFrame  # of all chunks
    best: DataFrame  # query_id, chunk_id, document_id, ordinal, score: every query's k best are among them


def scan(ch: DataFrame, terms: list[str], asked: tuple[pa.Array, np.ndarray, list[str | None]], k: int) -> Scan:
    """Read all chunks once for some terms and vectors; see counting.facts. A row for each chunk, without its text, is written."""
    d = sources.written(ch.select("document_id", "ordinal", counting.facts(F.col("text"), F.col("document_id"), terms, asked, k).alias("x")).select("document_id", "ordinal", "x.*"))
    key = [chunking.chunk_id().alias("chunk_id"), "document_id", "ordinal"]
    postings = d.select(*key, "dl", F.inline("held")).withColumn("part", part_of("term"))
    return Scan(postings, _frequencies(postings), _stats(d), d.select(*key, F.inline("best")))


_MADE = {
    "chunks": lambda c: chunking.chunks(c._pages).drop("core"),
    "postings": lambda c: _postings(c.chunks).drop("chunk_id"),
    "frequencies": lambda c: _frequencies(c.postings).sortWithinPartitions("part"),
    "stats": lambda c: _stats(_lengths(c.chunks)),
    "vectors": lambda c: _counts(c.chunks),
    "sections": lambda c: _sections(c.chunks),
    "meta": lambda c: index.metadata(c.chunks),
}


def _opened(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table with what isn't stored because it follows from the rest: the core of a chunk, a posting's chunk, vectors."""
    df = spark.read.parquet(f"{folder}/{name}")
    if name == "chunks":
        return df.select("chunk_id", "document_id", "ordinal", "text", chunking.core_of("text", "overlap_prefix_len").alias("core"), *df.columns[4:])
    if name == "postings":
        return df.withColumn("chunk_id", chunking.chunk_id())
    return _vectors(df) if name == "vectors" else df


def write(pages: DataFrame, folder: str) -> Corpus:
    """Chunk and index pages into a folder, whose tables are replaced, and read it again. Each table is made from what was written before it."""
    made = Growing(pages, folder, set())
    for f in fields(Corpus):
        getattr(made, f.name)
    return read(pages.sparkSession, folder)


def read(spark: SparkSession, folder: str) -> Corpus:
    return Corpus(**{f.name: _opened(spark, folder, f.name) for f in fields(Corpus)})


def current(corpus: Corpus) -> DataFrame:
    """document_id, valid: does the stored index fit the chunks, the tokeniser and the embedder? Search of other documents needs a rebuild."""
    return index.valid(corpus.meta, corpus.chunks)


#: Most terms that are looked for while postings are read; those of larger sets of queries are joined.
NAMED = 10000


def held(terms: DataFrame) -> Column:
    """Which rows of postings or frequencies can be of a table's terms: those of its partitions and, if they are no more than NAMED, of its terms, so that only those rows are shuffled."""
    part = F.col("part").isin(parts(terms))
    some = named(terms)
    return part if some is None else part & F.col("term").isin(some)


def named(terms: DataFrame) -> list[str] | None:
    """The terms of a table, if they are no more than NAMED."""
    some = [r["term"] for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
    return some if len(some) <= NAMED else None


def parts(terms: DataFrame) -> list[int]:
    """The partitions that hold a table's terms: at most PARTS numbers."""
    return sorted(r["part"] for r in terms.select(part_of("term").alias("part")).distinct().collect())
