"""Words of many texts counted at once, as Arrow functions: a text's bytes are looked up in a table, its words told by a dictionary.

Nothing is shuffled. All tokens are of ASCII characters, so that bytes tell them. A null text has no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from gleanery.functions import text as T

#: Texts that are counted at once.
ROWS = 4096
#: And scanned for facts, which take a number for each bucket of each text.
SCANNED = 1024
#: Most words whose buckets a task remembers.
REMEMBERED = 1 << 20


def _table(characters: str) -> np.ndarray:
    """What each byte stands for in a word, lower-cased; zero: it is in none."""
    out = np.zeros(256, np.uint8)
    for c in characters:
        out[ord(c)] = ord(c.lower())
    return out


_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LEXICAL, _KEYWORD = _table(_DIGITS + _LETTERS + "_"), _table(_DIGITS + _LETTERS + "'-")


def _cut(texts: pa.Array, table: np.ndarray, lettered: bool = False, kind: pa.DataType | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each run of a table's characters: its row, and its place among the distinct runs, which are given too. lettered: runs begin with their first letter."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    low = table[data]
    inside = low != 0
    firsts = at[:-1][at[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[firsts] = inside[firsts]
    if lettered:
        # A run's first letter is the first at or after its start; if that lies beyond its end, there is none.
        letters, starts = np.flatnonzero(low >= ord("a")), np.flatnonzero(first)
        ends = starts + np.diff(np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)))
        begin = np.append(letters, len(data))[np.searchsorted(letters, starts)]
        some = begin < ends
        begin, ends = begin[some], ends[some]
        step = np.zeros(len(data) + 1, np.int8)
        step[begin] = 1
        step[ends] -= 1  # a run may begin where another text's ends
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        first = np.zeros(len(data), bool)
        first[begin] = True
    offsets = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int64)
    words = pa.Array.from_buffers(kind or pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
    rows = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(first), at)))
    return rows, words.indices.to_numpy(), words.dictionary.cast(pa.string()) if kind is None else words.dictionary


def _kept(rows: np.ndarray, codes: np.ndarray, words: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Without short words and stopwords."""
    good = pc.and_(pc.greater_equal(pc.binary_length(words), least), pc.invert(pc.is_in(words, pa.array(T.STOPWORDS)))).to_numpy(zero_copy_only=False)[codes]
    return rows[good], codes[good]


def _runs(rows: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, value (under `most`) and number of each value of a row."""
    key, n = np.unique(rows.astype(np.int64) * max(1, most) + values, return_counts=True)
    return key // max(1, most), key % max(1, most), n.astype(np.int64)


def _slices(batch):
    return (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS))


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _lexical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    rows, codes, words = _cut(texts, _LEXICAL)
    return *_kept(rows, codes, words, 2), words


def lexical(df: DataFrame, keys: list[str], text: str, parts: int = 1) -> DataFrame:
    """keys, dl (the text's lexical tokens), term, tf: a row for each distinct lexical token of a text. Of each ROWS texts they go by the remainder of xxhash64(term) by `parts`, for pages of a file that hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                rows, codes, words = _lexical(some.column("_text"))
                dl = np.bincount(rows, minlength=len(some))
                row, code, n = _runs(rows, codes, len(words))
                if parts > 1:
                    of = np.array([xxhash.xxh64_intdigest(w, seed=42) % parts for w in words.to_pylist()], np.int16)[code]
                    order = np.argsort(of, kind="stable")
                    row, code, n = row[order], code[order], n[order]
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(pa.array(row)) for k in keys), pa.array(dl[row], pa.int32()), words.take(pa.array(code)), pa.array(n)], [*keys, "dl", "term", "tf"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.lower(text).alias("_text")).mapInArrow(run, f"{kinds}, dl int, term string, tf bigint")


def length(c: Column) -> Column:
    """How many lexical tokens."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.concat_arrays([pa.array(np.bincount(_lexical(some)[0], minlength=len(some)), pa.int32()) for some in _slices(batch)] or [pa.array([], pa.int32())])

    return F.arrow_udf(run, "int")(F.lower(c))


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        bucket = hashlib.sha256(word.encode()).digest()[3]
        if len(self) < REMEMBERED:
            self[word] = bucket
        return bucket


def buckets(c: Column) -> Column:
    """array<struct<x,n>>: buckets of the hashed words, in order, with the number of their occurrences."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = _Buckets()

        def one(some: pa.Array) -> pa.Array:
            rows, codes, words = _cut(some, _LEXICAL)
            of = np.array([held[w] for w in words.to_pylist()], np.int64)
            row, x, n = _runs(rows, of[codes], 256)
            return _lists(row, len(some), pa.StructArray.from_arrays([pa.array(x, pa.int32()), pa.array(n)], ["x", "n"]))

        for batch in texts:
            made = [one(some) for some in _slices(batch)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.struct([("x", pa.int32()), ("n", pa.int64())])))

    return F.arrow_udf(run, "array<struct<x:int,n:bigint>>")(F.lower(c))


def facts(text: Column, document: Column, terms: list[str], asked: tuple[pa.Array, np.ndarray, list[str | None]], k: int) -> Column:
    """struct<dl, held: array<struct<term,tf>>, best: array<struct<query_id,score>>>: a text's lexical tokens, how often it holds each of some terms, and its inner products with the queries that find it.

    asked: ids of queries, their unit vectors as columns, and the document that each searches (null: all). Those of SCANNED texts that can be among
    a query's k best are given, with all that tie with the last of them.
    """
    ids, matrix, only = asked
    kind = from_arrow_type(ids.type).simpleString()

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        buckets, names = _Buckets(), pa.array(terms, pa.string())

        def one(some: pa.Array, documents: pa.Array) -> pa.Array:
            rows, codes, words = _cut(some, _LEXICAL)
            dl = np.bincount(_kept(rows, codes, words, 2)[0], minlength=len(some))
            term = pc.fill_null(pc.index_in(words, names), -1).to_numpy()[codes]
            row, term, tf = _runs(rows[term >= 0], term[term >= 0], len(terms))
            held = _lists(row, len(some), pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(tf)], ["term", "tf"]))
            good = scores = np.zeros((len(some), 0))
            if len(ids):
                of = np.array([buckets[w] for w in words.to_pylist()], np.int64)
                n = np.bincount(rows * 256 + of[codes], minlength=len(some) * 256).reshape(-1, 256).astype(float)
                norm = np.sqrt((n * n).sum(axis=1, keepdims=True))
                scores = np.round((n / np.where(norm == 0, 1, norm)) @ matrix, 12)
                good = scores > 0
                for j, document in enumerate(only):
                    if document is not None:
                        good[:, j] &= pc.equal(documents, document).to_numpy(zero_copy_only=False)
                    if good[:, j].sum() > k:
                        good[:, j] &= scores[:, j] >= np.partition(scores[good[:, j], j], -k)[-k]
            row, j = np.nonzero(good)
            best = _lists(row, len(some), pa.StructArray.from_arrays([ids.take(pa.array(j)), pa.array(scores[row, j])], ["query_id", "score"]))
            return pa.StructArray.from_arrays([pa.array(dl, pa.int32()), held, best], ["dl", "held", "best"])

        for texts, documents in batches:
            for at in range(0, max(1, len(texts)), SCANNED):
                yield one(texts.slice(at, SCANNED), documents.slice(at, SCANNED))

    return F.arrow_udf(run, f"struct<dl:int,held:array<struct<term:string,tf:bigint>>,best:array<struct<query_id:{kind},score:double>>>")(F.lower(text), document)


def keywords(c: Column, most: int) -> Column:
    """The most frequent keyword tokens, ties by code point; none: an empty array."""

    def one(some: pa.Array) -> pa.Array:
        rows, codes, words = _cut(some, _KEYWORD, lettered=True)
        row, code, n = _runs(*_kept(rows, codes, words, 3), len(words))
        order = pc.array_sort_indices(words).to_numpy()
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        # One number sorts by row, falling count and word: below 2^62 for texts of 64 MB at once.
        size, top = max(1, len(words)), n.max(initial=0) + 1
        key = np.sort((row * top + (top - 1 - n)) * size + place[code])
        row = key // (top * size)
        best = np.arange(len(row)) - np.searchsorted(row, row) < most
        code = order[key % size] if len(key) else code
        return _lists(row[best], len(some), words.take(pa.array(code[best])))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            made = [one(some) for some in _slices(batch)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(c)


def runs_of_words(c: Column, size: int) -> Column:
    """array<bigint>: a hash of each `size` consecutive words, words being what lies between white space of ASCII."""
    table = np.arange(256, dtype=np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[0] = 1  # not white space, and hashes alike with another at worst

    def one(some: pa.Array) -> pa.Array:
        rows, codes, words = _cut(some, table, kind=pa.large_binary())
        each = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words.to_pylist()], np.uint64)[codes]
        n = max(0, len(each) - size + 1)
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
        whole = rows[:n] == rows[size - 1 :] if n else np.zeros(0, bool)
        return _lists(rows[:n][whole], len(some), pa.array(out[whole].view(np.int64)))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            made = [one(some) for some in _slices(batch)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(c)
