"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the unit vectors by its own random directions, evens the coordinates out by
their quantiles, shifts and quantises them, and orders all vectors by their position on a Hilbert
curve. Quantiles of the positions cut a curve into cells of some CELL_ROWS vectors, so that cells
grow in number with the table (up to MOST_CELLS, beyond which they grow in size). Vectors are
partitioned by runs of cells; a query is sent to the runs that lie within `reach` cells of its own
on every curve that is used. There it is compared by exact cosine, each run keeps its nearest, and
all lists merge and are ranked again.

Equal vectors are one row: of those only the NEAREST + 1 smallest vec_ids can be among anyone's
nearest, so a vector that a third of all rows have costs as much as any other, and queries of equal
vectors are searched once. Vectors are compared with those of their own dimension; a dimension of
few vectors is one cell, and so exact.

Ranges are fitted on the SAMPLE vectors of least hash. Reach and number of curves are then chosen by the
exact neighbours of TRIALS of them in the whole table: the cheapest that find RECALL of these. So windows
stay as narrow on large tables as the vectors allow; vectors without structure end up with nearly everything in
one wide window. Every row is indexed.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as
queries or candidates; neither do rows without a vec_id. Rows that repeat a vec_id are rows like any other: each is
a query, and a candidate for the others. Ties go to the smaller vec_id. Fewer candidates than asked for are all
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import materialised

NEAREST, EVERY = 5, 50
CURVES, DIMENSIONS, BITS = 6, 6, 10
CELL_ROWS, MOST_CELLS, RUN_ROWS, PART_QUERIES = 256, 1 << 14, 4096, 8192
SAMPLE, TRIALS, RECALL, QUANTILES = 4000, 256, 0.98, 65


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows of x), by Skilling's transform."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """The fitted index of one dimension: a few quantiles, and at most MOST_CELLS cuts a curve."""

    directions: np.ndarray  # curve, dimension of the vectors, dimension of the curve
    quantiles: np.ndarray  # curve, QUANTILES, dimension of the curve
    shift: np.ndarray  # curve, dimension of the curve
    cuts: list[np.ndarray]
    reach: int = 0
    used: int = CURVES

    @property
    def cells(self) -> int:
        return max(len(c) for c in self.cuts) + 1

    @property
    def run(self) -> int:
        """Cells of a run: a quarter of the reach, within bounds, so that a query is sent to some ten runs."""
        return max(1, min(self.reach // 4, RUN_ROWS // CELL_ROWS))

    def keys(self, unit: np.ndarray, c: int) -> np.ndarray:
        x = unit @ self.directions[c]
        even = np.linspace(0, 1, QUANTILES)
        u = np.column_stack([np.interp(x[:, d], self.quantiles[c, :, d], even) for d in range(DIMENSIONS)])
        return hilbert(np.clip((u + self.shift[c]) / 1.2 * (1 << BITS), 0, (1 << BITS) - 1), BITS)

    def cell(self, keys: np.ndarray, c: int) -> np.ndarray:
        return np.searchsorted(self.cuts[c], keys, side="right")


def scaled(rows) -> np.ndarray:
    """Vectors as a matrix, each times a power of two that keeps its squares in range; cosines don't change."""
    m = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def fit(sample: np.ndarray, seed: int = 42) -> Curves:
    """Directions and ranges; the cuts are still to come."""
    rng = np.random.default_rng(seed)
    u = unit(sample)
    directions = rng.standard_normal((CURVES, u.shape[1], DIMENSIONS))
    at = np.einsum("nd,cde->cne", u, directions)
    quantiles = np.quantile(at, np.linspace(0, 1, QUANTILES), axis=1).transpose(1, 0, 2)
    # np.interp needs rising points: equal quantiles are set apart by next to nothing.
    quantiles = quantiles + np.arange(QUANTILES)[None, :, None] * 1e-12
    return Curves(directions, quantiles, rng.uniform(0, 0.2, (CURVES, DIMENSIONS)), [])


def chosen(curves: Curves, trial_keys: np.ndarray, near_keys: np.ndarray) -> tuple[int, int]:
    """The number of curves and the reach that find RECALL of the pairs (rows: pairs, columns: curves) with the least comparisons."""
    if not len(trial_keys):
        return 1, curves.cells
    apart = np.column_stack([np.abs(curves.cell(trial_keys[:, c], c) - curves.cell(near_keys[:, c], c)) for c in range(CURVES)])
    best = (np.inf, 1, curves.cells)
    for used in range(1, CURVES + 1):
        reach = int(np.quantile(apart[:, :used].min(axis=1), RECALL, method="higher"))
        best = min(best, (used * min(2 * reach + 1, curves.cells), used, reach))
    return best[1], best[2]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.filter(F.coalesce(fine, F.lit(False)))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """A row for each distinct vector: cid, h (a hash of the vector), dim, embedding, ids (the k + 1 smallest vec_ids, repeats included) and first."""
    w = Window.partitionBy("h", "embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    ids = F.array_sort(F.collect_list("vec_id"))
    one = few.groupBy("h", "embedding").agg(ids.alias("ids"))
    # The written table keeps the numbers; nothing but its own joins depends on them.
    return materialised(one.select(F.monotonically_increasing_id().alias("cid"), "h", F.size("embedding").alias("dim"), "embedding", "ids", F.col("ids")[0].alias("first")))


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-sims, k - 1)[:k] if len(sims) > k else np.arange(len(sims))


def _fitted(table: DataFrame, rows: int, k: int) -> tuple[Curves, DataFrame]:
    """The index of one dimension, and its vectors with their positions on all curves."""
    spark = table.sparkSession
    limit = min(2**63 - 1, int(-(2**63) + 2 * SAMPLE / rows * 2**64))
    sample = table.filter(F.col("h") <= limit).orderBy("h", "cid").limit(SAMPLE).select("cid", "embedding").collect()
    points = scaled([r["embedding"] for r in sample])
    curves = fit(points)
    shared = spark.sparkContext.broadcast(curves)  # a few quantiles

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                m = scaled(x["embedding"])
                keys = np.column_stack([shared.value.keys(unit(m), c) for c in range(CURVES)])
                yield pd.DataFrame({"cid": x["cid"], "first": x["first"], "keys": list(keys), "vector": [r.tobytes() for r in m]})

    keyed = materialised(table.select("cid", "first", "embedding").mapInPandas(deal, "cid long, first long, keys array<long>, vector binary"))
    cells = min(MOST_CELLS, max(1, rows // CELL_ROWS))
    at = [i / cells for i in range(1, cells)] or [0.5]
    found = keyed.select(F.posexplode("keys").alias("curve", "key")).groupBy("curve").agg(F.percentile_approx("key", at, 20 * cells).alias("cuts")).collect()
    cuts = {r["curve"]: np.array(r["cuts"]) for r in found}
    curves.cuts = [cuts[c] for c in range(CURVES)]
    ids, trials = [r["cid"] for r in sample[:TRIALS]], points[:TRIALS]

    def nearest_of_trials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[float, list[int]]]] = [[] for _ in ids]
        queries = unit(trials)
        for x in batches:
            if not len(x):
                continue
            sims = queries @ unit(np.frombuffer(b"".join(x["vector"])).reshape(len(x), -1)).T
            own, keys = x["cid"].to_numpy(), x["keys"].to_numpy()
            for t, row in enumerate(sims):
                row[own == ids[t]] = -np.inf
                best[t] = sorted(best[t] + [(float(row[j]), keys[j].tolist()) for j in _top(row, k) if row[j] > -np.inf], reverse=True)[:k]
        yield pd.DataFrame([(t, s, keys) for t, b in enumerate(best) for s, keys in b], columns=["trial", "score", "keys"])

    lists = keyed.select("cid", "keys", "vector").mapInPandas(nearest_of_trials, "trial int, score double, keys array<long>")
    near = lists.withColumn("n", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "keys"))).filter(F.col("n") <= k).collect()  # TRIALS x k rows
    trial_keys = np.column_stack([curves.keys(unit(trials), c) for c in range(CURVES)])
    which = np.array([r["trial"] for r in near], dtype=np.int64)
    curves.used, curves.reach = chosen(curves, trial_keys[which], np.array([r["keys"] for r in near], dtype=np.int64).reshape(-1, CURVES))
    return curves, keyed


def _windows(curves: Curves, keyed: DataFrame, asked: DataFrame, n_asked: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and queries, each with the window (a string) in which they meet."""
    shared = keyed.sparkSession.sparkContext.broadcast(curves)  # at most CURVES x MOST_CELLS numbers

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                keys = np.array(x["keys"].to_list())
                for c in range(shared.value.used):
                    yield pd.DataFrame({"cid": x["cid"], "first": x["first"], "vector": x["vector"], "curve": c, "cell": shared.value.cell(keys[:, c], c)})

    run, reach = curves.run, curves.reach
    parts = max(1, -(-int(n_asked * min(1.0, (2 * reach + run) / curves.cells)) // PART_QUERIES))
    schema = "cid long, first long, vector binary, curve int, cell long"
    table = keyed.mapInPandas(deal, schema).withColumn("run", F.floor(F.col("cell") / run))
    # Runs that hold too many vectors, as where many lie close together, are split by hash.
    full = table.groupBy("curve", "run").agg(F.ceil(F.count("*") / RUN_ROWS).alias("blocks")).filter("blocks > 1")
    full = materialised(full)
    window = lambda: F.concat_ws(":", "dim", "curve", "run", "block", "part")
    table = table.join(full, ["curve", "run"], "left").withColumn("block", F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))))
    table = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dim = F.lit(curves.directions.shape[1]).alias("dim")
    sent = keyed.join(asked, "cid", "left_semi").mapInPandas(deal, schema)
    lo, hi = F.greatest(F.col("cell") - reach, F.lit(0)), F.least(F.col("cell") + reach, F.lit(curves.cells - 1))
    sent = sent.withColumn("run", F.explode(F.sequence(F.floor(lo / run), F.floor(hi / run)))).join(full, ["curve", "run"], "left")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(parts)).cast("int"))
    return table.withColumn("dim", dim).select(window().alias("window"), "cid", "first", "vector"), sent.withColumn("dim", dim).select(window().alias("window"), "cid", "vector")


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k nearest found."""
    rows = materialised(usable(vectors).withColumn("h", F.xxhash64("embedding")))
    table = classes(rows, k)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "h", "embedding").agg(F.count("*").alias("n"))
    queries = materialised(queries.join(table.select("cid", "h", "embedding"), ["h", "embedding"]).select(F.col("vec_id").alias("query_id"), "cid", "n"))
    asked = materialised(queries.select("cid").distinct())
    counts = table.groupBy("dim").agg(F.count("*").alias("n"))
    large = {r["dim"]: r["n"] for r in counts.filter(F.col("n") >= 2 * CELL_ROWS).collect()}  # a number a dimension that has so many vectors

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield x.drop(columns="embedding").assign(vector=[scaled([r])[0].tobytes() for r in x["embedding"]])

    small = table.filter(~F.col("dim").isin(list(large))).select(F.concat_ws(":", F.col("dim")).alias("window"), "cid", "first", "embedding")
    small = small.mapInPandas(pack, "window string, cid long, first long, vector binary")
    # New names for its columns, since Spark tells both sides of a cogroup apart by them.
    candidates, sent = small, small.join(asked, "cid", "left_semi").select(*[F.col(c).alias(c) for c in ("window", "cid", "vector")])
    n_asked = asked.count()
    for dim, n in sorted(large.items()):
        curves, keyed = _fitted(table.filter(F.col("dim") == dim), n, k)
        c, s = _windows(curves, keyed, asked, n_asked)
        candidates, sent = candidates.unionByName(c), sent.unionByName(s)

    def compare(x: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        if len(x) and len(queries):
            cv = np.frombuffer(b"".join(x["vector"])).reshape(len(x), -1)
            ids, first, cn = x["cid"].to_numpy(), x["first"].to_numpy(), np.sqrt((cv * cv).sum(axis=1))
            for at in range(0, len(queries), 256):
                part = queries[at : at + 256]
                qv = np.frombuffer(b"".join(part["vector"])).reshape(len(part), -1)
                rough = unit(qv) @ (cv / cn[:, None]).T
                for q, v, sims in zip(part["cid"].to_numpy(), qv, rough, strict=True):
                    cut = np.partition(sims, -k - 1)[-k - 1] if len(sims) > k + 1 else -np.inf
                    few = np.flatnonzero(sims >= cut - 1e-9)
                    # One pair at a time in one order of summation: a pair has one score everywhere.
                    score = (cv[few] * v).sum(axis=1) / (cn[few] * np.sqrt((v * v).sum()))
                    best = np.lexsort((first[few], -score))[: k + 1]
                    out += zip([int(q)] * len(best), ids[few][best].tolist(), first[few][best].tolist(), score[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query", "cid", "first", "score"])

    found = candidates.groupBy("window").cogroup(sent.groupBy("window")).applyInPandas(compare, "query long, cid long, first long, score double").distinct()
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first", "cid")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).join(table.select("cid", "ids"), "cid")
    # At most (k + 1)^2 ids a query vector; of the first k + 1 in order, a query leaves out its own row.
    lists = found.groupBy("query").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id"), (F.col("cid") == F.col("query")).alias("equal"))))).alias("all"))
    lists = lists.select("query", F.slice(F.array_sort("all"), 1, k + 1).alias("all"))
    own = lambda x: x["equal"] & (x["vec_id"] == F.col("query_id"))
    d = queries.join(lists, F.col("cid") == F.col("query"))
    d = d.withColumn("at", F.array_position(F.transform("all", lambda x: own(x).cast("int")), 1))
    d = d.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"), F.slice(F.filter("all", lambda x, i: i + 1 != F.col("at")), 1, k).alias("all"))
    d = d.select("query_id", F.posexplode("all").alias("pos", "x"))
    return d.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.far")).alias("score"))


def digest(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return nearest(vectors)
