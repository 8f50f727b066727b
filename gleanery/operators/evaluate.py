"""Retrieval quality, latency figures, sampling and derived benchmark queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.sources import written


def retrieval(gold: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """recall_at_k, mrr, n over gold(query_id, document_id); a query without hits counts in n."""
    first = hits.filter(F.col("rank") <= k).join(gold, ["query_id", "document_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    d = gold.select("query_id").distinct().join(first, "query_id", "left")
    return d.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("recall_at_k"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def latency(samples: DataFrame, name: str, ms: str) -> DataFrame:
    """Average and floor-index percentiles by name. Equal values are counted before they are ranked; no group is collected into one row."""
    counted = samples.groupBy(name, ms).agg(F.count("*").alias("c"))
    whole = samples.groupBy(name).agg(F.count("*").alias("n"), F.avg(ms).alias("avg_ms")).withColumnRenamed(name, "_name")
    w = Window.partitionBy(name).orderBy(ms).rowsBetween(Window.unboundedPreceding, 0)
    d = counted.withColumn("upto", F.sum("c").over(w)).join(whole, F.col(name).eqNullSafe(F.col("_name")))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p), F.col(ms)))
    return d.groupBy(name).agg(F.first("n").alias("n"), F.first("avg_ms").alias("avg_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))


def faithfulness(results: DataFrame) -> DataFrame:
    """results(faithful or null, insufficient, requery): rate without nulls, and counts."""
    return results.agg(F.avg(F.col("faithful").cast("double")).alias("faithfulness"), F.count_if("insufficient").alias("insufficient_count"), F.count_if("requery").alias("requery_count"), F.count("*").alias("n"))


def lcg_states(seed: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        seed = (1664525 * seed + 1013904223) % 2**32
        out.append(seed)
    return out


def sample(ch: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n chunks by a partial shuffle of their positions; the driver keeps the positions it has moved, at most n."""
    total = ch.count()
    moved: dict[int, int] = {}
    chosen = []
    for i, state in enumerate(lcg_states(seed, min(n, total))):
        j = i + int(state / 2**32 * (total - i))
        a, b = moved.get(i, i), moved.get(j, j)
        moved[i], moved[j] = b, a
        chosen.append(b)
    spark = ch.sparkSession
    picks = spark.createDataFrame(list(enumerate(chosen)), "pick int, position long")
    # Positions: running counts of chunks over ranges of documents, then over the documents of a range; the driver gets one number a range.
    counts = written(ch.groupBy("document_id").agg(F.count("*").alias("c")).repartitionByRange("document_id").withColumn("range", F.spark_partition_id()))
    before, at = [], 0
    for r in sorted(counts.groupBy("range").agg(F.sum("c").alias("c")).collect()):
        before.append((r["range"], at))
        at += r["c"]
    ranges = spark.createDataFrame(before, "range int, before long")
    inner = F.sum("c").over(Window.partitionBy("range").orderBy("document_id")) - F.col("c")
    starts = counts.withColumn("inner", inner).join(ranges, "range").select("document_id", (F.col("before") + F.col("inner")).alias("start"))
    numbered = ch.join(starts, "document_id").withColumn("position", F.col("start") + F.col("ordinal"))
    return numbered.join(picks, "position").select("pick", "chunk_id", "document_id", "ordinal")


def stub_questions(ch: DataFrame) -> DataFrame:
    return ch.select("chunk_id", F.concat(F.lit("What does chunk "), F.col("ordinal"), F.lit(" describe?")).alias("question"), F.left("text", F.lit(200)).alias("gold_answer"))


def default_queries(ch: DataFrame, titles: DataFrame, n: int = 5) -> DataFrame:
    """place, query: the first n distinct of title, summary, keywords and text of the chunks in order, compact, of 8 or more characters.

    Each candidate keeps its first position; only n rows leave the tasks."""
    d = titles.select("document_id", "ordinal", F.posexplode(F.array("section_title", "summary", F.array_join(F.slice("keywords", 1, 5), " "), "text")).alias("k", "raw")).filter("raw is not null")
    d = d.withColumn("query", T.compact(F.col("raw"), 80)).filter(F.length("query") >= 8)
    d = d.groupBy("query").agg(F.min(F.struct("document_id", "ordinal", "k")).alias("at")).orderBy("at").limit(n)
    return d.select(F.row_number().over(Window.orderBy("at")).alias("place"), "query")
