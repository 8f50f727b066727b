"""Substring dedup by recompression.

A window is WINDOW consecutive words of a document. Words covered by a window that also starts
in a document of smaller doc_id are removed.

Texts are recompressed: runs of one name, then in each round certain neighbouring pairs, get new
names. Names are hashes of what they stand for, so all tasks give equal names without a shared
dictionary, and each name knows on which words it depends (see parsing). Where two windows are
equal, all names that depend on words inside the window are equal too. So a window can repeat
only if all its interior high-level names occur in another document: Spark counts names over
documents, shared ones are sent back to the documents that hold them, and the windows that
survive are verified: their whole word sequences, as 64-bit hashes of 64-bit word names, meet in Spark,
which takes the smallest doc_id of each. Windows without an interior name, as in long runs of
one word, go to verification unpruned. There are about 1 / 8 names to a word.

What meets is then compared as text. Neighbouring windows that meet neighbouring ones make a repeat: a stretch of words here and
where it starts first. The words of both are read again and their SHA-256 compared. If any two differ,
64-bit hashes have collided, and all is done again with others; no word goes for a collision.

Null and empty texts have no words. Rows that repeat a doc_id don't remove each other's words; rows that repeat as a
whole are cut alike. Null doc_ids count as larger than all others, ties of the smallest doc_id are one document. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import discard, materialised, pinned
from gleanery.llm.parsing import BOUNDARY, U, WordNames, concatenated, mix, parse

WINDOW, ROUNDS, CHUNK_WORDS = 50, 7, 200_000
BASE, SEED, TRIES = 0x9E3779B97F4A7C15, 42, 4
LAST = (1 << 63) - 1


def _chunks(batches: Iterator[pa.RecordBatch], words: WordNames) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with about CHUNK_WORDS words, and the word names of their texts."""
    for batch in batches:
        texts, first, held, names = batch.column("text"), 0, 0, []
        for i in range(len(batch)):
            t = texts[i].as_py()
            parts = t.encode("utf-8", "replace").split() if t else []
            names.append(np.fromiter(map(words.__getitem__, parts), dtype=U, count=len(parts)))
            held += len(parts)
            if held >= CHUNK_WORDS or i == len(batch) - 1:
                yield batch.slice(first, i + 1 - first), names
                first, held, names = i + 1, 0, []


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _named(batches: Iterator[pa.RecordBatch], tried: int = 0) -> Iterator[pa.RecordBatch]:
    """Distinct high-level names of each document that has a window."""
    words = WordNames(SEED + tried)
    for rows, names in _chunks(batches, words):
        long = np.flatnonzero([len(x) >= WINDOW for x in names])
        if not len(long):
            continue
        flat, starts = concatenated([names[i] for i in long])
        ids, left, _ = parse(flat, ROUNDS)
        doc = np.searchsorted(starts, np.maximum(left, 1), side="right") - 1
        order = np.lexsort((ids, doc))
        ids, doc = ids[order], doc[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
        keys = _lists(np.bincount(doc[new], minlength=len(long)), ids[new].view(np.int64))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(long)), rows.column("part").take(pa.array(long)), keys], ["doc_id", "part", "keys"])


def _windows(batches: Iterator[pa.RecordBatch], tried: int = 0) -> Iterator[pa.RecordBatch]:
    """Hash, document and first word of each window whose interior names are all shared."""
    words, base = WordNames(SEED + tried), BASE + 8 * tried
    inverse = pow(base, -1, 1 << 64)
    for rows, names in _chunks(batches, words):
        shared = rows.column("shared")
        long = np.flatnonzero([len(x) >= WINDOW for x in names])
        if not len(long):
            continue
        flat, starts = concatenated([names[i] for i in long])
        ids, left, right = parse(flat, ROUNDS)
        doc = np.searchsorted(starts, np.maximum(left, 1), side="right") - 1
        alone = np.ones(len(ids), dtype=bool)
        edges = np.searchsorted(doc, np.arange(len(long) + 1))
        for k, i in enumerate(long):
            s = shared[int(i)]
            if s.is_valid and len(s.values):
                alone[edges[k] : edges[k + 1]] = ~np.isin(ids[edges[k] : edges[k + 1]].view(np.int64), s.values.to_numpy())
        n = len(flat) - WINDOW + 1
        inside = np.concatenate([[0], np.cumsum(flat == BOUNDARY)])
        candidate = inside[WINDOW:] == inside[:-WINDOW]
        # A name that no other document has rules out all windows around what it depends on.
        lo, hi = np.maximum(right[alone] - WINDOW + 1, 0), np.minimum(left[alone], n - 1)
        ok = lo <= hi
        steps = np.bincount(lo[ok], minlength=n + 1) - np.bincount(hi[ok] + 1, minlength=n + 1)
        at = np.flatnonzero(candidate & (np.cumsum(steps[:n]) == 0))
        power = np.full(len(flat), base, dtype=U)
        power[0] = 1
        back = np.full(len(flat), inverse, dtype=U)
        back[0] = 1
        sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(flat * np.multiply.accumulate(power))])
        hashes = mix((sums[at + WINDOW] - sums[at]) * np.multiply.accumulate(back)[at]).view(np.int64)
        of = np.searchsorted(starts, at, side="right") - 1
        take = pa.array(long[of])
        yield pa.RecordBatch.from_arrays([pa.array(hashes), rows.column("doc_id").take(take), rows.column("part").take(take), pa.array((at - starts[of]).astype(np.int32))], ["h", "doc_id", "part", "start"])


def _words(text: pa.Scalar) -> list[bytes]:
    t = text.as_py()
    return t.encode("utf-8", "replace").split() if t else []


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the words of each stretch that is asked for."""
    for batch in batches:
        at, starts, sizes, sums = [], [], [], []
        for i, (t, asked) in enumerate(zip(batch.column("text"), batch.column("asked"), strict=True)):
            parts = _words(t)
            for x in asked.as_py():
                at.append(i)
                starts.append(x["start"])
                sizes.append(x["n"])
                sums.append(hashlib.sha256(b" ".join(parts[x["start"] : x["start"] + x["n"]])).digest())
        take = pa.array(at, pa.int64())
        columns = [batch.column("doc_id").take(take), batch.column("part").take(take), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(sums, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "start", "n", "sum"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_words, n_removed = [], [], []
        for t, repeats in zip(batch.column("text"), batch.column("repeats"), strict=True):
            parts = _words(t)
            n = len(parts)
            if repeats.is_valid and n:
                gone = np.zeros(n + 1, dtype=np.int64)
                for x in repeats.as_py():
                    gone[x["start"]] += 1
                    gone[x["start"] + x["n"]] -= 1
                parts = [parts[i] for i in np.flatnonzero(np.cumsum(gone[:n]) == 0)]
            kept.append(b" ".join(parts).decode())
            n_words.append(n)
            n_removed.append(n - len(parts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.hash("text").alias("part"), "text")


def found(docs: DataFrame, tried: int = 0) -> DataFrame:
    """doc_id, part, repeats: stretches of each document that start in a smaller doc_id too, by equal hashes. part tells rows of one doc_id apart.

    A repeat has its first word here (start), its number of words (n), and where the same stretch is in the
    smallest doc_id that has it (lo, lo_part, lo_start).
    """
    d = _keyed(docs)
    named = materialised(d.mapInArrow(lambda b: _named(b, tried), "doc_id long, part int, keys array<long>"))
    held = named.select("doc_id", "part", F.explode("keys").alias("key"))
    several = held.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key")
    several = materialised(several)  # a table of its own lets the join below split skewed keys
    lists = materialised(held.join(several, "key").groupBy("doc_id", "part").agg(F.collect_set("key").alias("shared")))
    discard(named, several)
    joined = d.join(lists, ["doc_id", "part"], "left")
    windows = materialised(joined.mapInArrow(lambda b: _windows(b, tried), "h long, doc_id long, part int, start int"))
    discard(lists)
    lo = [F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("part", "doc_id").alias("lo_part"), F.min_by("start", "doc_id").alias("lo_start")]
    first = materialised(windows.groupBy("h").agg(*lo).filter("lo < hi").drop("hi"))
    later = windows.join(first, "h").filter("doc_id > lo").select("doc_id", "part", F.struct("start", "lo", "lo_part", "lo_start").alias("x"))
    s = later.groupBy("doc_id", "part").agg(F.array_sort(F.collect_set("x")).alias("s"))
    goes_on = lambda a, b: (b["start"] == a["start"] + 1) & (b["lo"] == a["lo"]) & (b["lo_part"] == a["lo_part"]) & (b["lo_start"] == a["lo_start"] + 1)
    s = pinned(s, heads=F.filter(F.transform("s", lambda x, i: F.when((i == 0) | ~goes_on(F.get("s", i - 1), x), i)), lambda i: i.isNotNull()))
    size = lambda i, t: F.coalesce(F.get("heads", t + 1), F.size("s")) - i + (WINDOW - 1)
    of = lambda i, t: F.struct(F.get("s", i)["start"].alias("start"), size(i, t).alias("n"), *[F.get("s", i)[c].alias(c) for c in ("lo", "lo_part", "lo_start")])
    out = materialised(s.select("doc_id", "part", F.transform("heads", of).alias("repeats")))
    discard(windows, first)
    return out


def verified(docs: DataFrame, repeats: DataFrame) -> bool:
    """Are the words of all repeats those of the stretch that they are said to repeat?"""
    x = repeats.select("doc_id", "part", F.inline("repeats"))
    here, there = x.select("doc_id", "part", "start", "n"), x.select(F.col("lo").alias("doc_id"), F.col("lo_part").alias("part"), F.col("lo_start").alias("start"), "n")
    asked = here.unionByName(there).groupBy("doc_id", "part").agg(F.collect_set(F.struct("start", "n")).alias("asked"))
    rows = _keyed(docs).join(asked, ["doc_id", "part"])
    sums = materialised(rows.mapInArrow(_read, "doc_id long, part int, start int, n int, sum binary").distinct())
    first = sums.withColumnsRenamed({"doc_id": "lo", "part": "lo_part", "start": "lo_start", "sum": "first"})
    compared = x.join(sums, ["doc_id", "part", "start", "n"], "left").join(first, ["lo", "lo_part", "lo_start", "n"], "left")
    same = compared.filter(~F.coalesce(F.col("sum") == F.col("first"), F.lit(False))).isEmpty()
    discard(sums)
    return same


def repeated(docs: DataFrame) -> DataFrame:
    """As found, every repeat verified word by word."""
    for tried in range(TRIES):
        out = found(docs, tried)
        if verified(docs, out):
            return out
        discard(out)
    raise RuntimeError(f"64-bit hashes collided {TRIES} times")


def deduped(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the words that stay, joined by a space), n_words, n_removed."""
    repeats = repeated(docs).withColumnsRenamed({"doc_id": "_d", "part": "_p"})
    d = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.hash("text").alias("part"), "text")
    joined = d.join(repeats, (F.col("_id") == F.col("_d")) & (F.col("part") == F.col("_p")), "left").select("doc_id", "text", "repeats")
    return joined.mapInArrow(_cut, "doc_id long, kept string, n_words long, n_removed long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduped(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
     s AS (SELECT doc_id, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}),
     h AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + {WINDOW - 1}], ' ')) AS h FROM s),
     f AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
     g AS (SELECT h.doc_id, list(h.i) AS starts FROM h JOIN f ON h.h = f.h WHERE h.doc_id > f.lo GROUP BY h.doc_id),
     p AS (SELECT w.doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM w),
     c AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, unnest(starts) AS i FROM g) CROSS JOIN range(0, {WINDOW}) AS r(k)),
     k AS (SELECT p.doc_id, count(*) FILTER (WHERE c.i IS NOT NULL) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL), '') AS kept
           FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
