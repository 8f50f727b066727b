"""Queries of search, fusion, reranking and routing over the chunked books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import chunking as C
from gleanery.operators import rerank as R
from gleanery.operators import search as S
from gleanery.operators import views
from gleanery.plans import functions as PF
from gleanery.plans import ingestion as PI
from gleanery.plans import inputs as N

_HITS = ("query_id", "rank", "chunk_id", "document_id", "ordinal", "score")
_EXPANDED = ",\n".join([N.QUERY_ROWS, PF.expansion_ctes("(SELECT query_id, document_id, query AS q FROM queries)", "query_id, document_id"), PF.variants_sql("query_id, document_id", 8, False)])
_TERMS = rf"""vq AS (SELECT query_id, document_id, query AS v, weight FROM variants UNION ALL SELECT query_id, document_id, query, 1.0::DOUBLE FROM queries WHERE query_id NOT IN (SELECT query_id FROM variants)),
 qt0 AS (SELECT query_id, document_id, weight, unnest(list_distinct(list_filter(regexp_extract_all(lower(v), '[0-9A-Za-z_]+'), lambda x: length(x) >= 2 AND x NOT IN {PI._STOP}))) AS term FROM vq),
 qt AS (SELECT query_id, document_id, coalesce(document_id, '__all__') AS scope, term, sum(weight) AS w FROM qt0 GROUP BY ALL)"""
_BM25 = """bm AS (SELECT t.query_id, f.chunk_id, f.document_id, f.ordinal, round(sum(ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * (f.tf * 2.5::DOUBLE) / (f.tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * l.dl / s.avgdl)) * t.w), 12) AS score
   FROM qt t JOIN df d ON d.scope = t.scope AND d.term = t.term JOIN stats s ON s.scope = t.scope JOIN tf f ON f.term = t.term AND (t.document_id IS NULL OR t.document_id = f.document_id) JOIN lens l ON l.chunk_id = f.chunk_id GROUP BY ALL),
 lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, ordinal) AS rank FROM bm WHERE score > 0)"""
_VEC = r"""qb0 AS (SELECT query_id, CAST('0x' || substr(sha256(tok), 7, 2) AS INTEGER) AS bucket, count(*) AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[0-9A-Za-z_]+')) AS tok FROM queries) GROUP BY ALL),
 qb AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS weight FROM qb0),
 vs AS (SELECT q.query_id, h.chunk_id, c.document_id, c.ordinal, round(sum(q.weight * h.weight), 12) AS score FROM qb q JOIN hb h USING (bucket) JOIN chunks c ON c.chunk_id = h.chunk_id JOIN queries x ON x.query_id = q.query_id AND (x.document_id IS NULL OR x.document_id = c.document_id) GROUP BY ALL),
 vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, ordinal) AS rank FROM vs)"""
_FUSE = """fu AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id, v.score AS vector_score, l.score AS lexical_score, v.rank AS vr, l.rank AS lr,
   CASE WHEN v.rank IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE / (60 + v.rank) END + CASE WHEN l.rank IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE / (60 + l.rank) END AS rrf_score
   FROM (SELECT * FROM vec WHERE rank <= 40) v FULL JOIN (SELECT * FROM lex WHERE rank <= 40) l ON v.query_id = l.query_id AND v.chunk_id = l.chunk_id),
 fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, vr NULLS LAST, lr NULLS LAST) AS rank FROM fu)"""
_LEX = ",\n".join([N.UP_TO_CHUNKS, PI.TOKENS, PI.DF, PI.STATS, _EXPANDED, _TERMS, _BM25])
_VECTORS = ",\n".join([N.UP_TO_CHUNKS, PI.HASH])
_ROUTE = PI.MAP + ",\n" + PI.ENRICH + r""",
 sb0 AS (SELECT document_id, section_no, CAST('0x' || substr(sha256(tok), 7, 2) AS INTEGER) AS bucket, count(*) AS n FROM (SELECT document_id, section_no, unnest(regexp_extract_all(lower(summary), '[0-9A-Za-z_]+')) AS tok FROM enr) GROUP BY ALL),
 sb AS (SELECT document_id, section_no, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY document_id, section_no)) AS weight FROM sb0),
 rs AS (SELECT q.query_id, d.document_id, d.section_no, d.chunk_ordinal_start, d.chunk_ordinal_end, coalesce(d.title, '(untitled)') AS title, round(coalesce((SELECT sum(qb.weight * sb.weight) FROM qb JOIN sb USING (bucket) WHERE qb.query_id = q.query_id AND sb.document_id = d.document_id AND sb.section_no = d.section_no), 0.0::DOUBLE), 12) AS score FROM queries q JOIN dmap d ON d.document_id = q.document_id),
 routes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_no) AS rank FROM rs) WHERE rank <= 3)"""


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 7) for c in cols})


def _ch(f):
    """A query over the stated queries and the corpus, whose index is read."""
    return lambda spark, d: f(N.queries(spark), N.corpus(spark, d))


def _routes(q, c):
    return S.routed(q, c, 3)


def _mode(mode):
    return _ch(lambda q, c: _round(S.results(S.search(q, c, mode)), "score_hybrid", "score_vector", "score_lexical"))


def _ready(spark, d):
    """Chunks of the documents whose status is ready; every document's is, but book1's."""
    c = N.corpus(spark, d)
    status = c.meta.select("document_id", F.when(F.col("document_id") == "book1", "failed").otherwise("ready").alias("status"))
    return c.of(status.filter("status = 'ready'")).chunks.select("chunk_id")


_RANKED = "query_id, rank, chunk_id, document_id, ordinal, round(score, 7) AS score"
_SOURCE = "fused f JOIN chunks c ON c.chunk_id = f.chunk_id"

HYBRID = ",\n".join([_LEX, PI.HASH, _VEC, _FUSE])
_HELD = {"hybrid": "fused", "lexical": "(SELECT query_id, chunk_id, rank, score AS rrf_score, score AS lexical_score, CAST(NULL AS DOUBLE) AS vector_score FROM lex WHERE rank <= 40)"}


def relevance_sql(mode: str) -> str:
    """rel: the candidates of a mode with relevance (to twelve digits) and distinct tokens."""
    body, bare = "(coalesce(c.section_title, '') || ' ' || c.text)", f"regexp_replace(regexp_replace({PF._NORMAL('q.query')}, '^\"', ''), '\"$', '')"
    tokens = lambda x: f"list_distinct(list_filter(regexp_extract_all({PF._NORMAL(x)}, '[{chr(92)}p{{L}}{chr(92)}p{{N}}][{chr(92)}p{{L}}{chr(92)}p{{N}}_{chr(39)}{chr(39)}-]*'), lambda x: length(x) >= 2 AND x NOT IN {PI._STOP}))"
    share = lambda n: f"CASE WHEN least(len(qs), len({n})) > 0 THEN len(list_intersect(qs, {n})) / least(len(qs), len({n}))::DOUBLE ELSE 0 END"
    scaled = lambda x: f"coalesce({x} / nullif(max({x}) OVER w, 0), 0)"
    return f"""rel0 AS (SELECT f.query_id, f.rank, f.chunk_id, c.document_id, c.ordinal, c.page_start, c.page_end, c.section_title, c.text, f.rrf_score, f.vector_score, f.lexical_score,
   {scaled("rrf_score")} AS n_rrf, {scaled("lexical_score")} AS n_lex, {scaled("vector_score")} AS n_vec,
   CASE WHEN length({bare}) >= 4 AND contains({PF._NORMAL(body)}, {bare}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS phrase, {tokens("q.query")} AS qs, {tokens("coalesce(c.section_title, '')")} AS ts, {tokens(body)} AS bs
   FROM {_HELD[mode]} f JOIN chunks c ON c.chunk_id = f.chunk_id JOIN queries q ON q.query_id = f.query_id WINDOW w AS (PARTITION BY f.query_id)),
 rel AS MATERIALIZED (SELECT *, round(0.6::DOUBLE * n_rrf + 0.2::DOUBLE * n_lex + 0.2::DOUBLE * n_vec + 0.18::DOUBLE * phrase + 0.14::DOUBLE * {share("ts")} + 0.2::DOUBLE * {share("bs")}, 12) AS relevance FROM rel0)"""


#: alike: similarity of every two candidates of a query, by rank; a candidate is like itself.
SIMILAR = """al0 AS (SELECT x.query_id, x.rank AS a, y.rank AS b, len(x.bs) AS nx, len(y.bs) AS ny, len(list_intersect(x.bs, y.bs)) AS n, CASE WHEN x.document_id = y.document_id THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - least(abs(x.page_start - y.page_end), abs(y.page_start - x.page_end)) / 3.0::DOUBLE)) ELSE 0.0::DOUBLE END AS near FROM rel x JOIN rel y ON x.query_id = y.query_id),
 alike AS MATERIALIZED (SELECT query_id, a, b, least(1.0::DOUBLE, CASE WHEN nx > 0 AND ny > 0 THEN n / (nx + ny - n)::DOUBLE ELSE 0.0::DOUBLE END + 0.35::DOUBLE * near) AS similarity FROM al0)"""


def mmr_sql(k: int) -> str:
    """found: the choice of up to k candidates by relevance against the largest similarity to those chosen, as a recursion over the chosen list."""
    return f"""pos AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM rel),
 mat0 AS (SELECT s.query_id, x.i, list(s.similarity ORDER BY y.i) AS row FROM alike s JOIN pos x ON x.query_id = s.query_id AND x.rank = s.a JOIN pos y ON y.query_id = s.query_id AND y.rank = s.b GROUP BY s.query_id, x.i),
 mat AS MATERIALIZED (SELECT query_id, list(row ORDER BY i) AS m FROM mat0 GROUP BY query_id),
 rels AS MATERIALIZED (SELECT query_id, list(relevance ORDER BY i) AS r, count(*) AS n FROM pos GROUP BY query_id),
 mmr AS (SELECT query_id, CAST([] AS BIGINT[]) AS chosen FROM rels
   UNION ALL SELECT query_id, list_append(chosen, CAST(list_position(v, list_max(v)) AS BIGINT)) FROM (SELECT mmr.query_id, chosen, list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -1e9::DOUBLE ELSE 0.72::DOUBLE * r[i] - (1 - 0.72::DOUBLE) * coalesce(list_max(list_transform(chosen, lambda j: m[i][j])), 0.0::DOUBLE) END) AS v
     FROM mmr JOIN rels ON rels.query_id = mmr.query_id JOIN mat ON mat.query_id = mmr.query_id WHERE len(chosen) < least(n, {k}))),
 chosen AS (SELECT query_id, generate_subscripts(c, 1) AS place, unnest(c) AS i FROM (SELECT query_id, arg_max(chosen, len(chosen)) AS c FROM mmr GROUP BY query_id)),
 found AS (SELECT p.* EXCLUDE (rank, i), CAST(place AS INTEGER) AS rank FROM chosen c JOIN pos p ON p.query_id = c.query_id AND p.i = c.i)"""


RESULTS = "SELECT query_id, rank, chunk_id, document_id, ordinal, page_start, page_end, section_title, text, round(rrf_score, 7) AS score_hybrid, round(vector_score, 7) AS score_vector, round(lexical_score, 7) AS score_lexical FROM found"
_ADJACENT = """SELECT query_id, place, document_id, chunk_id, ordinal, page_start, page_end, before, after, reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (
   SELECT r.*, CASE WHEN page_start <> page_end THEN 'edge_hit' WHEN rrf_score >= 0.7::DOUBLE * max(rrf_score) OVER (PARTITION BY query_id) OR CASE WHEN least(len(qs), len(bs)) > 0 THEN len(list_intersect(qs, bs)) / least(len(qs), len(bs))::DOUBLE ELSE 0 END >= 0.5 THEN 'strong_isolated_hit' END AS reason,
     CASE WHEN ordinal > 0 AND NOT EXISTS (SELECT 1 FROM rel x WHERE x.query_id = r.query_id AND x.document_id = r.document_id AND x.ordinal = r.ordinal - 1) THEN ordinal - 1 END AS before,
     CASE WHEN NOT EXISTS (SELECT 1 FROM rel x WHERE x.query_id = r.query_id AND x.document_id = r.document_id AND x.ordinal = r.ordinal + 1) THEN ordinal + 1 END AS after FROM rel r)
   WHERE reason IS NOT NULL AND (before IS NOT NULL OR after IS NOT NULL)) WHERE place <= 6"""

QUERIES = {
    "query_terms": (lambda spark, d: _round(S.query_terms(N.queries(spark)).drop("document_id"), "w"), N.with_sql(",\n".join([_EXPANDED, _TERMS]), "SELECT query_id, scope, term, round(w, 7) AS w FROM qt")),
    "bm25_scores": (_ch(lambda q, c: _round(S.bm25_scores(q, c), "score")), N.with_sql(_LEX, "SELECT query_id, chunk_id, document_id, ordinal, round(score, 7) AS score FROM bm WHERE score > 0")),
    "lexical_search": (_ch(lambda q, c: _round(S.lexical(q, c, 20), "score").select(*_HITS)), N.with_sql(_LEX, f"SELECT {_RANKED} FROM lex WHERE rank <= 20")),
    "vector_search": (_ch(lambda q, c: _round(S.vector(q, c, 20), "score").select(*_HITS)), N.with_sql(",\n".join([_VECTORS, N.QUERY_ROWS, _VEC]), f"SELECT {_RANKED} FROM vec WHERE rank <= 20")),
    "search_vector": (_ch(lambda q, c: _round(S.search(q, c, "vector"), "rrf_score").select("query_id", "rank", "chunk_id", "rrf_score", "page_start", "page_end", "section_title")), N.with_sql(",\n".join([_VECTORS, N.QUERY_ROWS, _VEC]), "SELECT query_id, rank, chunk_id, round(score, 7) AS rrf_score, page_start, page_end, section_title FROM vec JOIN chunks c USING (chunk_id) WHERE rank <= 20")),
    "rrf_fuse": (_ch(lambda q, c: _round(S.fused(S.vector(q, c, 40), S.lexical(q, c, 40)), "rrf_score").select("query_id", "chunk_id", "rrf_score", "rank")), N.with_sql(",\n".join([_LEX, PI.HASH, _VEC, _FUSE]), "SELECT query_id, chunk_id, round(rrf_score, 7) AS rrf_score, rank FROM fused")),
    "hybrid_candidates": (_ch(lambda q, c: _round(S.candidates(q, c, "hybrid"), "rrf_score", "vector_score", "lexical_score").select("query_id", "rank", "chunk_id", "vector_score", "lexical_score", "rrf_score", "page_start")), N.with_sql(",\n".join([_LEX, PI.HASH, _VEC, _FUSE]), f"SELECT query_id, rank, f.chunk_id, round(vector_score, 7) AS vector_score, round(lexical_score, 7) AS lexical_score, round(rrf_score, 7) AS rrf_score, page_start FROM {_SOURCE}")),
    "section_routing": (_ch(lambda q, c: _round(_routes(q, c), "score")), N.with_sql(",\n".join([_VECTORS, N.QUERY_ROWS, _VEC, _ROUTE]), "SELECT query_id, document_id, section_no, chunk_ordinal_start, chunk_ordinal_end, title, round(score, 7) AS score, rank FROM routes")),
    "section_routing_filter": (_ch(lambda q, c: S.candidates(q, c, "hybrid", routes=_routes(q, c)).select("query_id", "rank", "chunk_id")), N.with_sql(",\n".join([_LEX, PI.HASH, _VEC, _FUSE, _ROUTE]), f"SELECT query_id, rank, f.chunk_id FROM {_SOURCE} WHERE f.query_id NOT IN (SELECT query_id FROM routes) OR EXISTS (SELECT 1 FROM routes r WHERE r.query_id = f.query_id AND r.document_id = c.document_id AND c.ordinal BETWEEN r.chunk_ordinal_start AND r.chunk_ordinal_end)")),
    "ready_chunks": (_ready, N.with_sql(N.UP_TO_CHUNKS, "SELECT chunk_id FROM chunks WHERE document_id <> 'book1'")),
    "rerank_relevance": (_ch(lambda q, c: _round(R.relevance(S.candidates(q, c, "hybrid"), q), "relevance").select("query_id", "rank", "chunk_id", "relevance")), N.with_sql(",\n".join([HYBRID, relevance_sql("hybrid")]), "SELECT query_id, rank, chunk_id, round(relevance, 7) AS relevance FROM rel")),
    "pairwise_similarity": (_ch(lambda q, c: _round(R.pairwise(R.relevance(S.candidates(q, c, "lexical"), q)), "similarity")), N.with_sql(",\n".join([_LEX, relevance_sql("lexical"), SIMILAR]), "SELECT query_id, a, b, round(similarity, 7) AS similarity FROM alike WHERE a < b")),
    "search_lexical": (_mode("lexical"), N.with_sql(",\n".join([_LEX, relevance_sql("lexical"), SIMILAR, mmr_sql(20)]), RESULTS)),
    "search_hybrid": (_mode("hybrid"), N.with_sql(",\n".join([HYBRID, relevance_sql("hybrid"), SIMILAR, mmr_sql(20)]), RESULTS)),
    "mmr_rerank": (_ch(lambda q, c: R.diversified(S.candidates(q, c, "hybrid"), q, 8).select("query_id", "rank", "chunk_id")), N.with_sql(",\n".join([HYBRID, relevance_sql("hybrid"), SIMILAR, mmr_sql(8)]), "SELECT query_id, rank, chunk_id FROM found")),
    "adjacent_expansion": (_ch(lambda q, c: R.adjacent(S.candidates(q, c, "hybrid"), q)), N.with_sql(",\n".join([HYBRID, relevance_sql("hybrid")]), _ADJACENT)),
    "search_meta": (_ch(lambda q, c: S.facts(q, c, S.candidates(q, c, "vector"), "vector").drop("routed_sections")), N.with_sql(",\n".join([_VECTORS, N.QUERY_ROWS, _VEC]), """SELECT q.query_id, 'vector' AS mode, 20 AS requested_top_k, CASE WHEN trim(q.query) = '' THEN 0 ELSE (SELECT count(*) FROM chunks c WHERE q.document_id IS NULL OR c.document_id = q.document_id) END AS chunk_count,
      (SELECT count(*) FROM vec v WHERE v.query_id = q.query_id AND v.rank <= 20) AS hit_count FROM queries q""")),
    "result_intel": (_ch(lambda q, c: views.result_facts(S.candidates(q, c, "vector"))), N.with_sql(",\n".join([_VECTORS, N.QUERY_ROWS, _VEC]), """SELECT query_id, CASE WHEN len(p) <= 6 THEN array_to_string(p, ', ') ELSE array_to_string(p[1:3], ', ') || ' ... ' || array_to_string(p[-2:], ', ') END AS pages, o0 || '-' || o1 AS chunks, printf('%.3f-%.3f', s0, s1) AS scores, CASE WHEN len(t) = 0 THEN 'untitled' WHEN len(t) > 3 THEN len(t) || ' sections' ELSE array_to_string(t, ', ') END AS sections
      FROM (SELECT query_id, list_sort(list_distinct(flatten(list(generate_series(page_start, page_end))))) AS p, min(c.ordinal) AS o0, max(c.ordinal) AS o1, min(score) AS s0, max(score) AS s1, coalesce(list_sort(list_distinct(list(section_title) FILTER (WHERE trim(section_title) <> ''))), []) AS t FROM vec JOIN chunks c USING (chunk_id) WHERE rank <= 20 GROUP BY query_id)""")),
    "collapse_sections": (_ch(lambda q, c: views.collapsed(C.document_map(c.chunks))), N.with_sql(N.UP_TO_CHUNKS + ",\n" + PI.MAP, rf"""SELECT document_id, key, arg_min(label, section_no) AS label, min(chunk_ordinal_start) AS chunk_ordinal_start, min(page_start) AS page_start, max(page_end) AS page_end, CAST(sum(chunk_count) AS BIGINT) AS chunk_count FROM (SELECT *, CASE WHEN k <> '' THEN k ELSE '__untitled_' || (section_no - 1) END AS key, CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) ELSE 'Section ' || section_no END AS label FROM (SELECT *, regexp_replace({PF._NORMAL("coalesce(title, '')")}, '[\s.·•:;,–—-]+$', '') AS k FROM dmap)) GROUP BY document_id, key""")),
}
SOURCES = {"lexical": _LEX, "hash": PI.HASH, "vector": _VEC, "fused": _FUSE}
