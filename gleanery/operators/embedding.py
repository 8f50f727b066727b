"""Hashed bag-of-words vectors, sparse and dense, and vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import counting
from gleanery.functions import text as T
from gleanery.functions.plan import pinned

DIMENSIONS = 256
#: Names of the embedders, as the index and answers give them.
NAMES = {"hash": "hash-256"}


def counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, and runs(x, n): bucket and count of each non-zero coordinate, in order, of a text without tokens none."""
    return df.select(*keys, counting.buckets(F.col(text)).alias("runs"))


def _norm(runs: str) -> Column:
    return F.sqrt(F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["n"] * r["n"]))


def buckets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, weight: the non-zero coordinates of the unit vectors."""
    d = pinned(counts(df, [key], text), norm=_norm("runs"))
    return d.select(key, "norm", F.inline("runs").alias("bucket", "n")).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def dense(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, embedding: array of DIMENSIONS doubles, all zero for a text without tokens."""
    return filled(counts(df, [key], text), "runs").select(key, "embedding")


def filled(df: DataFrame, runs: str) -> DataFrame:
    """df with embedding, made of the counts of its buckets."""
    d = pinned(df, _norm=_norm(runs), _m=F.map_from_entries(F.transform(runs, lambda r: F.struct(r["x"], r["n"]))))
    one = lambda i: F.coalesce(F.element_at("_m", i) / F.col("_norm"), F.lit(0.0))
    return d.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), one)).drop("_norm", "_m")


#: Most queries of one pass over the vectors: as unit vectors, their size is bounded by this times the vectors' length.
PASS = 4096


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *ties: str) -> DataFrame:
    """query_id, rank, score (inner product, to twelve digits) and the columns of vectors but `embedding`: the k best of each query, above zero.

    queries(query_id, embedding, only: null or the one document_id searched) is a stated set: PASS of them at a time go
    to all tasks, and one pass over the vectors keeps each task's k best of each query. Only those are shuffled. Empty vectors, and
    those of another length than the query's, find and are found by nothing. Ties go by the named columns.
    """
    out, kept = None, [c for c in vectors.columns if c != "embedding"]
    asked = queries.filter(F.size("embedding") > 0).select("query_id", "embedding", "only")
    slices = max(1, -(-asked.count() // PASS))
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in kept)
    kind = queries.schema["query_id"].dataType.simpleString()
    for i in range(slices):
        some = asked if slices == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        best = vectors.filter(F.size("embedding") > 0).mapInPandas(_scan(some.collect(), k, kept, ties), f"query_id {kind}, {kinds}, score double")
        out = best if out is None else out.unionByName(best)
    return top(out, k, *ties)


def _scan(asked: list, k: int, kept: list[str], ties: tuple[str, ...]):
    by_length: dict[int, list] = {}
    for r in asked:
        by_length.setdefault(len(r["embedding"]), []).append(r)
    groups = {n: ([r["query_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float).T, [r["only"] for r in rows]) for n, rows in by_length.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for x in frames:
            sizes = x["embedding"].map(len)
            for n, (ids, matrix, only) in groups.items():
                rows = x[sizes == n]
                if not len(rows):
                    continue
                scores = np.round(np.array(rows["embedding"].to_list(), dtype=float) @ matrix, 12)
                for j, q in enumerate(ids):
                    good = scores[:, j] > 0 if only[j] is None else (scores[:, j] > 0) & (rows["document_id"] == only[j]).to_numpy()
                    if good.sum() > max(1, k):  # sort no more than the k best and what ties with the last
                        good &= scores[:, j] >= np.partition(scores[good, j], -max(1, k))[-max(1, k)]
                    found = rows.loc[good, kept].assign(score=scores[good, j])
                    both = pd.concat([held[q], found]) if q in held else found
                    held[q] = both.sort_values(["score", *ties], ascending=[False, *[True] * len(ties)], kind="stable")[: max(1, k)]
        for q, rows in held.items():
            yield rows.assign(query_id=q)[["query_id", *kept, "score"]]

    return run


def top(scores: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of each query, ranked from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, k))


def remote(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """Vectors from a service: embed takes up to `batch` texts and returns as many vectors, which are normalised here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            texts, out = x[text].tolist(), []
            for i in range(0, len(texts), batch):
                got = embed(texts[i : i + batch])
                if len(got) != len(texts[i : i + batch]):
                    raise ValueError("the embedding service returned another number of vectors")
                out += got
            yield pd.DataFrame({key: x[key], "embedding": out})

    kind = df.schema[key].dataType.simpleString()
    e = df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")
    return e.select(key, T.l2_normalize(F.col("embedding")).alias("embedding"))
