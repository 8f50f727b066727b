"""Relevance scores and greedy diversification (maximal marginal relevance) of a query's hits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.config import DEFAULT, EngineConfig
from gleanery.functions import text as T


def _normal(score: Column) -> Column:
    w = Window.partitionBy("query_id")
    s = F.coalesce(F.when(~F.isnan(score), score), F.lit(0.0))
    most = F.max(s).over(w)
    return F.when(most > 0, s / most).otherwise(0.0)


def relevance(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits with relevance, tokens (distinct) and normal scores."""
    d = hits.join(queries.select("query_id", "query"), "query_id")
    nq, nt = T.normalize_text(T.nfkc(F.col("query"))), T.nfkc(F.concat_ws(" ", F.coalesce("section_title", F.lit("")), "text"))
    d = d.withColumns({"nq": nq, "body": T.normalize_text(nt), "title": T.normalize_text(T.nfkc(F.coalesce("section_title", F.lit(""))))})
    q, title = T.rerank_tokens(F.col("nq")), T.rerank_tokens(F.col("title"))
    d = d.withColumns({"tokens": F.array_distinct(T.rerank_tokens(F.col("body"))), "n_rrf": _normal(F.col("rrf_score")), "n_lex": _normal(F.col("lexical_score")), "n_vec": _normal(F.col("vector_score"))})
    score = 0.6 * F.col("n_rrf") + 0.2 * F.col("n_lex") + 0.2 * F.col("n_vec") + 0.18 * T.exact_phrase(F.col("nq"), F.col("body")) + 0.14 * T.overlap_ratio(q, title) + 0.2 * T.overlap_ratio(q, F.col("tokens"))
    return d.withColumn("relevance", F.round(score, 12)).drop("nq", "body", "title", "query")


def pairwise(scored: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, a, b, similarity of all hits of a query (a before b): at most twice config.candidates hits each."""
    s = scored.select("query_id", "rank", "document_id", "page_start", "page_end", "tokens").filter(F.col("rank") <= 2 * max(config.candidates, config.top_k))
    x, y = s.alias("x"), s.alias("y")
    j = x.join(y, (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.rank") < F.col("y.rank")))
    near = T.page_proximity(F.col("x.document_id") == F.col("y.document_id"), F.col("x.page_start"), F.col("x.page_end"), F.col("y.page_start"), F.col("y.page_end"))
    sim = T.clamp01(T.jaccard(F.col("x.tokens"), F.col("y.tokens")) + 0.35 * near)
    return j.select("x.query_id", F.col("x.rank").alias("a"), F.col("y.rank").alias("b"), sim.alias("similarity"))


def pick(rows: list[dict], k: int, trade: float) -> list[int]:
    """Greedy choice of up to k rows: relevance against the largest similarity to those chosen; ties to the earlier row."""
    trade, left, chosen = max(0.0, min(1.0, trade)), list(range(len(rows))), []
    worst = [0.0] * len(rows)
    while left and len(chosen) < max(1, k):
        best = max(left, key=lambda i: (trade * rows[i]["relevance"] - (1 - trade) * worst[i], -i))
        chosen.append(best)
        left.remove(best)
        for i in left:
            a, b = rows[i], rows[best]
            both = len(a["tokens"] & b["tokens"])
            sim = both / (len(a["tokens"]) + len(b["tokens"]) - both) if a["tokens"] and b["tokens"] else 0.0
            if a["document_id"] == b["document_id"]:
                apart = min(abs(a["page_start"] - b["page_end"]), abs(b["page_start"] - a["page_end"]))
                sim += 0.35 * max(0.0, min(1.0, 1 - apart / 3))
            worst[i] = max(worst[i], min(1.0, max(0.0, sim)))
    return chosen


def diversified(hits: DataFrame, queries: DataFrame, k: int, config: EngineConfig = DEFAULT) -> DataFrame:
    """The chosen hits with rank in the order of choice and their own scores. One group is one query's hits, at most a few dozen; hits are computed once."""
    d, columns = relevance(hits, queries), hits.columns

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        rows = pdf[["relevance", "document_id", "page_start", "page_end"]].to_dict("records")
        for r, tokens in zip(rows, pdf["tokens"], strict=True):
            r["tokens"] = set(tokens)
        order = pick(rows, k, config.mmr_lambda)
        return pdf[columns].iloc[order].assign(rank=range(1, len(order) + 1))

    return d.select(*hits.columns, "relevance", "tokens").groupBy("query_id").applyInPandas(choose, hits.schema)


def adjacent(hits: DataFrame, queries: DataFrame, most: int = 6, ratio: float = 0.7) -> DataFrame:
    """Neighbouring chunks worth showing: of hits at a page edge, or strong and alone."""
    d = hits.join(queries.select("query_id", "query"), "query_id")
    w = Window.partitionBy("query_id")
    q = T.rerank_tokens(T.nfkc(F.col("query")))
    body = T.rerank_tokens(T.nfkc(F.concat_ws(" ", F.coalesce("section_title", F.lit("")), "text")))
    strong = (F.col("rrf_score") >= ratio * F.max("rrf_score").over(w)) | (T.overlap_ratio(q, body) >= 0.5)
    edge = F.col("page_start") != F.col("page_end")
    d = d.withColumns({"reason": F.when(edge, "edge_hit").when(strong, "strong_isolated_hit"), "held": F.collect_set(F.struct("document_id", "ordinal")).over(w)})
    free = lambda o: F.when((o >= 0) & ~F.array_contains("held", F.struct("document_id", o.alias("ordinal"))), o)
    d = d.withColumns({"before": free(F.col("ordinal") - 1), "after": free(F.col("ordinal") + 1)}).filter("reason is not null and (before is not null or after is not null)")
    d = d.withColumn("place", F.row_number().over(w.orderBy("rank"))).filter(F.col("place") <= most)
    return d.select("query_id", "place", "document_id", "chunk_id", "ordinal", "page_start", "page_end", "before", "after", "reason")
