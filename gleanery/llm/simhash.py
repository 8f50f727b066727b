"""SimHash near-dedup with pivot distance tables.

A fingerprint is linked to those at most two bits away. Its row in the pivot tables is computed
once: the Hamming distances to REFERENCES pseudo-random fingerprints, and those to the references
0 and 2^i, of which the distance to 2^i is one above or below that to 0 as bit i is 0 or 1, so that
this table's 64 differences are read off the fingerprint. Candidates agree in groups of these differences:
four groups of 16 coordinates, of which fingerprints within two bits share at least two, so they
meet under one of six keys. A key with more than MOST_MEMBERS fingerprints is split by the
coordinates that it doesn't fix, again in four groups of which two must agree, as often as it takes;
when eight coordinates are left, at most 256 fingerprints can share a key. All
that meet are discarded if any of the REFERENCES coordinates differs by more than two (triangle
inequality), and survivors are verified by their exact distance. No link is lost at any step.

Equal fingerprints are one row throughout. Null and empty texts have fingerprint zero, linked like any other. Null doc_ids get a
component, but never name one unless all of it is null. Repeated rows each give a row; ties, as of
fingerprints at exactly two bits, are links; an empty table gives an empty result; extra columns are ignored.

one_of_each links documents by similarity, and, where bits are asked for, by fingerprints and pivot tables as above too.
Similarity: five words a shingle and a Jaccard similarity of 0.8 or
more, whose fingerprints, which count repeats, may be any number of bits apart. Candidates of the latter share one of BANDS
tuples of least hashes (at 0.8, all but 2 in 10,000 pairs share one). All that share one are
compared by their exact sets of shingles, however far apart their fingerprints are; those of a large
group are dealt to parts, and each two parts are counted at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialised
from gleanery.llm.components import components

WORDS, SEED, MOST_BITS = 3, 42, 2
REFERENCES, MOST_MEMBERS, PIECE = 32, 256, 1 << 16
NEAR_WORDS, LEAST_SIMILARITY = 5, 0.8
BANDS, ROWS, BLOCK, SLICE = 16, 4, 1024, 500
#: Most members and, on average, shingles of a part; members from which on a shingle is counted by a matrix product, WIDTH shingles at a time.
PART, VOLUME, DENSE, WIDTH = 1024, 1 << 19, 32, 1024
#: One order of hashes for each least hash: a bijection of 64-bit numbers.
FLIP, ODD = (np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def shingle_hashes(text: str | None, words: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in order, a piece at a time; none without words."""
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    for at in range(0, max(1, len(parts) - words + 1) if parts else 0, PIECE):
        piece = parts[at : at + PIECE + words - 1]
        shingles = map(b" ".join, zip(*[piece[j:] for j in range(words)], strict=False)) if len(parts) >= words else [b" ".join(parts)]
        yield np.array([digest(x, SEED) for x in shingles], dtype="<u8")


def _majority(pieces: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in pieces:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def simhash(text: str | None, words: int = WORDS) -> int:
    """Fingerprint of a text as a signed 64-bit number."""
    return _majority(shingle_hashes(text, words))


def fingerprinted(docs: DataFrame, text: str = "text", out: str = "fp", words: int = WORDS) -> DataFrame:
    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([simhash(t.as_py(), words) for t in batch], pa.int64())

    return docs.withColumn(out, fingerprint(text))


def references() -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(f"reference {i}")) for i in range(REFERENCES)]


def pivoted(fps: DataFrame) -> DataFrame:
    """fp and the table of its distances to the references, eight to a long (t0, t1, ...)."""
    distances = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in references()]
    longs = [reduce(Column.bitwiseOR, [F.shiftleft(d, 7 * j) for j, d in enumerate(distances[at : at + 8])]) for at in range(0, REFERENCES, 8)]
    return fps.select("fp", *[x.alias(f"t{i}") for i, x in enumerate(longs)])


def _near(x: str, y: str) -> Column:
    """Does no coordinate differ by more than MOST_BITS? The first that does decides."""
    one = lambda side, i: F.shiftright(F.col(f"{side}.t{i // 8}"), 7 * (i % 8)).bitwiseAND(F.lit(127))
    return reduce(lambda a, b: a & b, [F.abs(one(x, i) - one(y, i)) <= MOST_BITS for i in range(REFERENCES)])


def candidates(fps: DataFrame) -> DataFrame:
    """From fp: key, fp; those within two bits share a key, and no key has more than 256 fingerprints or MOST_MEMBERS if that is more."""
    rest, key, out = F.col("fp"), F.lit(0).cast("long"), None
    rows = fps.select("fp", key.alias("key"), rest.alias("rest"))
    for width in (16, 8, 4):
        group = lambda i, w=width: F.shiftrightunsigned("rest", w * i).bitwiseAND(F.lit((1 << w) - 1))
        deals = []
        for k, (i, j) in enumerate(combinations(range(4), 2)):
            left, right = [x for x in range(4) if x not in (i, j)]
            deals.append(F.struct(F.xxhash64("key", F.lit(k), group(i), group(j)).alias("key"), F.shiftleft(group(left), width).bitwiseOR(group(right)).alias("rest")))
        dealt = rows.select("fp", F.inline(F.array(*deals)))
        shared = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        met = materialised(dealt.join(shared, "key"))
        few = met.select("key", "fp") if width == 4 else met.filter(F.col("n") <= MOST_MEMBERS).select("key", "fp")
        out = few if out is None else out.unionByName(few)
        rows = met.filter(F.col("n") > MOST_MEMBERS).select("fp", "key", "rest")
        if width == 4 or rows.isEmpty():
            return out


def links(fps: DataFrame) -> DataFrame:
    """From distinct fingerprints (fp): links (a, b), all pairs within two bits."""
    rows = candidates(fps).join(pivoted(fps), "fp")
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _near("x", "y"))
    verified = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MOST_BITS
    return met.filter(verified).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def grouped(fps: DataFrame) -> DataFrame:
    """From doc_id, fp: add component_id, the smallest doc_id that links lead to."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(links(distinct.select("fp")))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return fps.join(named.select("fp", "label").join(least, "label").drop("label"), "fp")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    fps = materialised(fingerprinted(docs.select("doc_id", "text")).select("doc_id", "fp"))
    return grouped(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles of NEAR_WORDS."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, NEAR_WORDS)]))


def sketch(text: str | None) -> tuple[int, list[int], int]:
    """Of a text's set of shingles: size, a key for each band of least hashes, and a hash of the set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    h = shingle_set(text)
    for at in range(0, len(h), BLOCK):
        least = np.minimum(least, ((h[at : at + BLOCK, None] ^ FLIP) * ODD).min(axis=0))
    raw = least.astype("<u8").tobytes()
    keys = [_signed(xxhash.xxh64_intdigest(raw[8 * ROWS * i : 8 * ROWS * (i + 1)], i)) for i in range(BANDS)]
    return len(h), keys, _signed(xxhash.xxh64_intdigest(h.tobytes()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)
    pa.default_memory_pool().release_unused()


def _sketched(docs: DataFrame, bits: bool) -> DataFrame:
    """doc_id, key (a hash of the text), fp (its fingerprint, if asked for), size (of the set of shingles), keys, class: texts of one class have equal sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, keys, classes = zip(*[sketch(t.as_py()) for t in batch.column("text")], strict=True)
            fps = [simhash(t.as_py()) if bits else None for t in batch.column("text")]
            found = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(classes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *found], ["doc_id", "key", "fp", "size", "keys", "class"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, fp long, size long, keys array<long>, class long")


def _sets(texts: DataFrame) -> DataFrame:
    """From class, text: class, all (the set of a text's shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingle_set(t.as_py()).view("<i8") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(found, pa.list_(pa.int64()))], ["class", "all"])

    return texts.mapInArrow(run, "class long, all array<long>")


def _met(classes: DataFrame) -> DataFrame:
    """From class, size, keys: class, key, and in how many parts the key's classes are compared; keys of the same classes are one."""
    dealt = classes.select("class", "size", F.explode("keys").alias("key"))
    marks = [F.bit_xor(F.xxhash64("class", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    shared = dealt.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), *marks).filter("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("volume") / VOLUME, F.lit(1))).cast("int").alias("parts")
    once = shared.groupBy("n", "volume", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", parts)
    return materialised(dealt.drop("size").join(once, "key"))


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Of sorted sets, by number: pairs that connect all of a similarity of LEAST_SIMILARITY or more."""
    sizes = np.array([len(x) for x in sets])
    shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    new = np.concatenate([[True], shingles[1:] != shingles[:-1]])[: len(shingles)]
    held = np.diff(np.append(np.flatnonzero(new), len(shingles)))
    holders = np.repeat(held, held)
    common = np.zeros((len(sets), len(sets)))
    light = (holders > 1) & (holders <= DENSE)
    s, o = shingles[light], owner[light]
    for k in range(1, DENSE):
        same = s[k:] == s[:-k]
        if not same.any():
            break
        np.add.at(common, (o[:-k][same], o[k:][same]), 1)
    heavy = holders > DENSE
    o, column = owner[heavy], np.cumsum(new[heavy]) - 1
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        lo, hi = np.searchsorted(column, [at, at + WIDTH])
        block = np.zeros((len(sets), WIDTH), dtype=np.float32)
        block[o[lo:hi], column[lo:hi] - at] = 1
        common += block @ block.T
    links = np.triu(common >= LEAST_SIMILARITY * (sizes[:, None] + sizes[None, :] - common), 1)
    links |= links.T
    out, left = [], links.any(axis=1)
    while left.any():
        first = int(left.argmax())
        front = np.array([first])
        left[first] = False
        while len(front):
            front = np.flatnonzero(links[front].any(axis=0) & left)
            left[front] = False
            out += [(first, int(i)) for i in front]
    return out


def _compared(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all classes that share a key and are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, held = None, [], []

        def found() -> pa.RecordBatch:
            pairs = alike(held) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[p[end]] for p in pairs], pa.int64()) for end in range(2)], ["a", "b"])

        for batch in batches:
            cells = zip(*[batch.column(c).to_pylist() for c in ("key", "x", "y")], strict=True)
            lists = batch.column("all")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (its, name) in enumerate(zip(cells, batch.column("class").to_pylist(), strict=True)):
                if its != cell:
                    yield found()
                    cell, names, held = its, [], []
                names.append(name)
                held.append(values[ends[i] : ends[i + 1]])
        yield found()

    # Every two parts make a cell, of the classes of both; one or two parts make one cell.
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("part"))
    dealt = met.select("key", "class", "parts", part.alias("part")).withColumn("other", F.explode(F.when(F.col("parts") > 2, others).otherwise(F.array(F.lit(0)))))
    ends = [F.when(F.col("parts") > 2, f("part", "other")).otherwise(0).alias(c) for f, c in ((F.least, "x"), (F.greatest, "y"))]
    cells = dealt.select("key", *ends, "class").join(sets, "class")
    return cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """From fp, class: links (a, b) that connect all classes whose fingerprints links connect."""
    fps = rows.select("fp").distinct()
    named = fps.join(components(links(fps)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("group"))
    held = rows.select("fp", "class").distinct().join(named, "fp").select("group", "class").distinct()
    least = held.groupBy("group").agg(F.min("class").alias("a"))
    return materialised(held.join(least, "group").filter("a < class").select("a", F.col("class").alias("b")).distinct(), narrow=True)


def one_of_each(docs: DataFrame, bits: bool = False) -> DataFrame:
    """docs with one row of each group of near copies left: that of the smallest doc_id (null last), then of the least hash of the text.

    A group is all that links connect: similar sets of shingles and, with `bits`, fingerprints at MOST_BITS or fewer differing bits, found through the pivot tables.

    Rows of equal doc_id and text are copies, of which any one stays. A null text is like an empty
    one, and all of those are copies. Other columns play no part and may have any name.
    """
    rows = materialised(_sketched(docs.select("doc_id", "text"), bits))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("first")
    classes = materialised(rows.groupBy("class").agg(F.max("size").alias("size"), F.first("keys").alias("keys"), first))
    met = _met(classes)
    asked = met.select("class").distinct()
    whose = classes.join(asked, "class").select("class", F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
    texts = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    texts = texts.join(whose, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("class", "text")
    sets = materialised(_sets(texts.dropDuplicates(["class"])))
    found = _compared(met, sets)
    labels = components(found.unionByName(_by_fingerprint(rows)).distinct() if bits else found)
    named = classes.select("class", "first").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    stay = materialised(named.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key")))
    repeated = rows.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("n")).filter("n > 1")
    same = F.col("d.doc_id").eqNullSafe(F.col("s._id")) & (F.xxhash64("d.text") == F.col("s._key"))
    kept = docs.alias("d").join(stay.alias("s"), same, "left_semi")
    once = kept.alias("d").join(repeated.alias("s"), same, "left_anti")
    return once.unionByName(kept.alias("d").join(repeated.alias("s"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
