"""Line dedup: remove boilerplate, lines that many sites share.

A line is what stands between line feeds; its key is the 64-bit hash of the line without the
spaces around it. Lines of spaces alone have no key. The spread of a line is
its number of distinct sites (null is no site). HyperLogLog sketches of the sites merge by
aggregation; a line whose estimate is near the threshold gets an exact distinct count. A line of
MIN_SITES sites or more stays in the documents with the smallest doc_id that hold it and goes
from all others (null doc_id: the line goes), however short it is.

Null texts stay null with no lines; an empty text has one empty line; repeated rows are treated
alike; lines on exactly MIN_SITES sites go; an empty table gives an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import materialised, packed, pinned, unpacked

MIN_SITES = 10
#: Relative width of the band around the threshold in which distinct sites are counted exactly;
#: over ten standard errors of a sketch with 2^12 registers, and small sketches are exact anyway.
NEAR, LG_K = 0.2, 12


def _key(line: Column) -> Column:
    return F.when(F.trim(line) != "", F.xxhash64(F.trim(line)))


def _keys(text: Column) -> Column:
    """The distinct keys of a text."""
    return F.array_compact(F.array_distinct(F.transform(F.split(text, "\n", -1), _key)))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """key, first: the lines of at least MIN_SITES sites, and the smallest doc_id that holds each."""
    held = docs.select("doc_id", F.col(site).alias("site"), F.explode(_keys(F.col(text))).alias("key"))
    # One site alone can't make a line boilerplate; the sketch is built for the others only.
    several = held.groupBy("key").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("doc_id").alias("first"), F.count("*").alias("n")).filter((F.col("lo") != F.col("hi")) & (F.col("n") >= MIN_SITES))
    several = materialised(several)  # tables of their own let the joins split skewed keys
    spread = held.join(several.select("key", "first"), "key").groupBy("key").agg(F.first("first").alias("first"), F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = materialised(spread)
    sure = spread.filter(F.col("sites") > MIN_SITES * (1 + NEAR)).select("key", "first")
    near = spread.filter((F.col("sites") <= MIN_SITES * (1 + NEAR)) & (F.col("sites") >= MIN_SITES * (1 - NEAR))).select("key", "first")
    pairs = held.join(near, "key").groupBy("key", "first", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("key", "first").agg(F.count("site").alias("sites")).filter(F.col("sites") >= MIN_SITES)
    return sure.unionByName(exact.select("key", "first"))


def removals(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """doc_id, gone: the keys to remove from the documents of that doc_id."""
    held = docs.select("doc_id", F.explode(_keys(F.col(text))).alias("key"))
    hits = held.join(materialised(boilerplate(docs, text, site)), "key").filter(~F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False)))
    return hits.groupBy("doc_id").agg(F.collect_set("key").alias("gone"))


def _cleaned(docs: DataFrame, text: str, site: str) -> DataFrame:
    """row (all columns of docs), cleaned, n_lines and n_removed."""
    gone = removals(docs, text, site).withColumnRenamed("doc_id", "of")
    d = packed(docs, doc_id=F.col("doc_id"), text=F.col(text))
    d = d.join(gone, d["doc_id"].eqNullSafe(gone["of"]), "left")
    lines = F.split("text", "\n", -1)
    d = pinned(d, kept=F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains("gone", _key(x)), F.lit(False)))))
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    whole = F.col("gone").isNull()
    return d.select("row", F.when(whole, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("cleaned"), F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"), F.when(whole, 0).otherwise(n - F.size("kept")).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """docs with the text cleaned and nothing else changed but n_chars, which follows the text."""
    return unpacked(_cleaned(docs, text, site), docs.columns, **{text: F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")})


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the cleaned text (null: empty)."""
    d = _cleaned(docs.select("doc_id", "text", "source"), "text", "source")
    return d.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH l AS (SELECT doc_id, source, trim(x, ' ') AS k FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents)
           WHERE trim(x, ' ') <> ''),
     b AS (SELECT k, min(doc_id) AS first FROM l GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
     u AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents),
     r AS (SELECT doc_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS x FROM u),
     m AS (SELECT r.doc_id, r.i, r.x, (b.k IS NOT NULL AND r.doc_id <> b.first) AS gone FROM r LEFT JOIN b ON trim(r.x, ' ') = b.k),
     a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS t FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n_lines, 0) AS n_lines, coalesce(a.n_removed, 0) AS n_removed, sha256(coalesce(a.t, '')) AS kept_sha256
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""
