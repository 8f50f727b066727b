"""Sharding: a keyed Feistel permutation with cycle walking over global row numbers.

Row numbers run from 0 over the rows by (bucket of the hash of doc_id, size and checksum; doc_id, size, checksum),
so that rows which share only a doc_id, or have none, fall into different buckets.
The network permutes the least even-bit domain that holds all rows; a number that leaves the
range walks on until it comes back, so the result is a permutation of the rows themselves.
Position p goes to shard p mod S, slot p div S: counts differ by at most one (law `rows`), and
both directions can be computed without the data.

Null texts have no bytes (size 8, checksum 0); null doc_ids come first in their bucket; rows that agree in all of these columns are
interchangeable, one bucket and each a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for row numbers: their counts, 64 KB, are all that reaches the driver.
BUCKETS = 8192
SHARDS, KEY, ROUNDS = 24, 42, 6


class Permutation:
    """A permutation of range(n), and its inverse."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(xxhash.xxh64_intdigest(f"{key}:{r}")) for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _network(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for key in reversed(self.keys) if inverse else self.keys:
            if inverse:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << half) | right

    def _walk(self, x, inverse: bool) -> np.ndarray:
        out = self._network(np.asarray(x, dtype=np.uint64), inverse)
        while len(outside := np.flatnonzero(out >= np.uint64(self.n))):
            out[outside] = self._network(out[outside], inverse)
        return out.astype(np.int64)

    def forward(self, rows) -> np.ndarray:
        return self._walk(rows, False)

    def backward(self, positions) -> np.ndarray:
        return self._walk(positions, True)

    def place(self, rows, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of each row number."""
        at = self.forward(rows)
        return at % shards, at // shards

    def row(self, shard, slot, shards: int = SHARDS) -> np.ndarray:
        """The row number in a slot of a shard."""
        return self.backward(np.asarray(slot) * shards + np.asarray(shard))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Add _bucket and _rank (from 1) to rows; the first row number of each bucket, and last the count of all."""
    bucket = F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows.select(bucket.alias("b")).groupBy("b").count().collect():
        counts[r["b"]] = r["count"]
    ranked = rows.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return ranked, np.concatenate([[0], np.cumsum(counts)])


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot. Texts themselves aren't moved."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    ranked, starts = numbered(rows, ["doc_id", "size", "text_crc32"])
    permutation = Permutation(int(starts[-1]), key)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            number = starts[x.pop("_bucket").to_numpy()] + x.pop("_rank").to_numpy() - 1
            at, slot = permutation.place(number, shards)
            yield x.assign(row_number=number, shard=at.astype(np.int32), slot=slot)

    return ranked.mapInPandas(place, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under law `rows`), row_number."""
    d = shard(docs)
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
