"""Queries of the ingestion operators: pages, sections, chunks, maps, vectors, index."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import chunking as C
from gleanery.operators import corpus
from gleanery.operators import embedding as E
from gleanery.operators import index as I
from gleanery.operators import store
from gleanery.plans import inputs as N
from gleanery.sources import remove_at_exit, scratch

_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
_CH = N.UP_TO_CHUNKS
_upto = lambda *ctes: ",\n".join(ctes)
_TOKENS = rf"""tok AS (SELECT document_id, chunk_id, ordinal, list_filter(regexp_extract_all(lower(text), '[0-9A-Za-z_]+'), lambda x: length(x) >= 2 AND x NOT IN {_STOP}) AS ts FROM chunks),
 tf AS (SELECT document_id, chunk_id, ordinal, term, count(*) AS tf FROM (SELECT document_id, chunk_id, ordinal, unnest(ts) AS term FROM tok) GROUP BY ALL),
 lens AS (SELECT document_id, chunk_id, ordinal, len(ts) AS dl FROM tok)"""
_DF = "df AS (SELECT coalesce(document_id, '__all__') AS scope, term, count(*) AS df FROM tf GROUP BY GROUPING SETS ((document_id, term), (term)))"
_STATS = "stats AS (SELECT coalesce(document_id, '__all__') AS scope, count(*) AS n, avg(dl) AS avgdl FROM lens GROUP BY GROUPING SETS ((document_id), ()))"
_KEYWORDS = rf"""k0 AS (SELECT chunk_id, lower(unnest(regexp_extract_all(core, '[A-Za-z][A-Za-z0-9''-]*'))) AS token FROM chunks),
 k1 AS (SELECT chunk_id, token, count(*) AS n FROM k0 WHERE length(token) >= 3 AND token NOT IN {_STOP} GROUP BY ALL),
 k2 AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, token) AS rank FROM k1),
 keywords AS (SELECT chunk_id, list(token ORDER BY rank) AS ks FROM k2 WHERE rank <= 8 GROUP BY chunk_id)"""


def summary_sql(x: str, most: int = 200) -> str:
    parts = f"list_transform(list_slice(string_split(regexp_replace({N.trim_sql(x)}, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(31) || '\\2', 'g'), chr(31)), 1, 2), lambda p: {N.trim_sql('p')})"
    return N.trim_sql(f"left(CASE WHEN len({parts}) > 1 AND length(({parts})[1] || ' ' || ({parts})[2]) <= {most} THEN ({parts})[1] || ' ' || ({parts})[2] ELSE ({parts})[1] END, {most})")


_MAP = """m0 AS (SELECT *, CASE WHEN lag(ordinal) OVER w IS NULL OR section_title IS DISTINCT FROM lag(section_title) OVER w THEN 1 ELSE 0 END AS new FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
 m1 AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY ordinal) AS section_no FROM m0),
 dmap AS (SELECT document_id, section_no, any_value(section_title) AS title, min(ordinal) AS chunk_ordinal_start, max(ordinal) AS chunk_ordinal_end, min(page_start) AS page_start, max(page_end) AS page_end, count(*) AS chunk_count FROM m1 GROUP BY document_id, section_no)"""
_ENRICH = _KEYWORDS + f""",
 sums AS (SELECT document_id, ordinal, chunk_id, {summary_sql("core")} AS summary FROM chunks),
 e0 AS (SELECT d.document_id, d.section_no, s.ordinal, s.summary, k.ks FROM dmap d JOIN sums s ON s.document_id = d.document_id AND s.ordinal BETWEEN d.chunk_ordinal_start AND d.chunk_ordinal_end LEFT JOIN keywords k ON k.chunk_id = s.chunk_id),
 e1 AS (SELECT document_id, section_no, coalesce(string_agg(summary, ' ' ORDER BY ordinal) FILTER (WHERE summary <> ''), '') AS joined, flatten(list(coalesce(ks, []) ORDER BY ordinal)) AS ks FROM e0 GROUP BY ALL),
 enr AS (SELECT document_id, section_no, {summary_sql("joined", 600)} AS summary, list_slice(list_filter(ks, lambda x, i: list_position(ks, x) = i), 1, 10) AS keywords FROM e1)"""
_HASH = r"""hb0 AS (SELECT chunk_id, CAST('0x' || substr(sha256(tok), 7, 2) AS INTEGER) AS bucket, count(*) AS n FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_]+')) AS tok FROM chunks) GROUP BY ALL),
 hb AS (SELECT chunk_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS weight FROM hb0)"""


def _pages(f):
    return lambda spark, d: f(N.pages(spark, d))


def _chunks(f):
    return lambda spark, d: f(N.chunks(spark, d))


def _stored(f):
    """A query over the stored chunks."""
    return lambda spark, d: f(N.corpus(spark, d).chunks)


def _written(spark, d):
    """Rows of each table of an index that is built and written now."""
    folder = scratch(spark)
    remove_at_exit(spark, folder)
    made, out = corpus.write(N.pages(spark, d), folder), None
    for f in fields(corpus.Corpus):
        one = getattr(made, f.name).agg(F.lit(f.name).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def _sections(f):
    return lambda spark, d: f(C.sections(N.pages(spark, d)))


QUERIES = {
    "page_offsets": (_pages(lambda p: C.page_offsets(p)), N.with_sql(_upto(N.PAGES, N.OFFSETS), "SELECT document_id, page_number, page_index, char_offset FROM offs")),
    "heading_lines": (_pages(lambda p: C.lines(p).filter("rule is not null").select("document_id", "line_no", "line", "rule")), N.with_sql(_upto(N.PAGES, N.LINES), "SELECT document_id, line_no, line, rule FROM lines WHERE rule IS NOT NULL")),
    "sections_detect": (_pages(lambda p: C.sections(p).drop("body")), N.with_sql(_upto(N.PAGES, N.LINES, N.SECTIONS), "SELECT document_id, section_idx, title, char_start, char_end FROM sections")),
    "paragraphs": (_sections(lambda s: C.paragraphs(s).select("document_id", "section_idx", "para_no", "para_start", F.length("para").alias("n"))), N.with_sql(_upto(N.PAGES, N.LINES, N.SECTIONS, N.PARAGRAPHS), "SELECT document_id, section_idx, para_no, para_start, length(para) AS n FROM paragraphs")),
    "units": (_sections(C.units), N.with_sql(_upto(N.PAGES, N.LINES, N.SECTIONS, N.PARAGRAPHS, N.UNITS), "SELECT document_id, section_idx, s AS unit_start, e AS unit_end FROM units")),
    "pack_units": (_sections(lambda s: C.spans(s).select("document_id", "section_idx", F.explode("spans").alias("x")).select("document_id", "section_idx", "x.s", "x.e")), N.with_sql(_upto(N.PAGES, N.LINES, N.SECTIONS, N.PARAGRAPHS, N.UNITS, N.SPANS), "SELECT document_id, section_idx, s, e FROM spans")),
    "chunk_pages": (_chunks(lambda c: c.select("chunk_id", "char_start", "char_end", "page_start", "page_end")), N.with_sql(_CH, "SELECT chunk_id, char_start, char_end, page_start, page_end FROM chunks")),
    "chunk_overlap": (_chunks(lambda c: c.select("chunk_id", "overlap_prefix_len", F.md5("text").alias("h"))), N.with_sql(_CH, "SELECT chunk_id, overlap_prefix_len, md5(text) AS h FROM chunks")),
    "chunks": (_chunks(lambda c: c.drop("core", "section_idx")), N.with_sql(_CH, "SELECT chunk_id, document_id, ordinal, text, page_start, page_end, char_start, char_end, section_title, overlap_prefix_len FROM chunks")),
    "document_map": (_stored(C.document_map), N.with_sql(_CH + ",\n" + _MAP, "SELECT * FROM dmap")),
    "chunk_summary": (_stored(C.summaries), N.with_sql(_CH, f"SELECT chunk_id, document_id, ordinal, {summary_sql('core')} AS summary FROM chunks")),
    "chunk_keywords": (_stored(lambda c: C.keywords(c).select("chunk_id", F.array_join("keywords", " ").alias("keywords"))), N.with_sql(_CH + ",\n" + _KEYWORDS, "SELECT chunk_id, array_to_string(ks, ' ') AS keywords FROM keywords")),
    "section_enrich": (_stored(lambda c: C.enriched(c).select("document_id", "section_no", "summary", F.array_join("keywords", " ").alias("keywords"))), N.with_sql(_CH + ",\n" + _MAP + ",\n" + _ENRICH, "SELECT document_id, section_no, summary, array_to_string(keywords, ' ') AS keywords FROM enr")),
    "hash_embed": (_stored(lambda c: E.buckets(c, "chunk_id", "text").withColumn("weight", F.round("weight", 9))), N.with_sql(_CH + ",\n" + _HASH, "SELECT chunk_id, bucket, round(weight, 9) AS weight FROM hb")),
    "hash_embed_dense": (_stored(lambda c: E.dense(c, "chunk_id", "text").select("chunk_id", F.size("embedding").alias("n"), F.round(T.dot(F.col("embedding"), F.col("embedding")), 9).alias("norm"))), N.with_sql(_CH, "SELECT chunk_id, 256 AS n, CASE WHEN regexp_matches(lower(text), '[0-9A-Za-z_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM chunks")),
    "term_frequencies": (_stored(I.term_frequencies), N.with_sql(_CH + ",\n" + _TOKENS, "SELECT document_id, chunk_id, ordinal, term, tf FROM tf")),
    "document_frequencies": (_stored(lambda c: I.document_frequencies(I.term_frequencies(c))), N.with_sql(_CH + ",\n" + _TOKENS + ",\n" + _DF, "SELECT scope, term, df FROM df")),
    "corpus_stats": (_stored(lambda c: I.corpus_stats(I.chunk_lengths(c)).withColumn("avgdl", F.round("avgdl", 9))), N.with_sql(_CH + ",\n" + _TOKENS + ",\n" + _STATS, "SELECT scope, n, round(avgdl, 9) AS avgdl FROM stats")),
    "inverted_index": (_stored(lambda c: I.inverted(I.term_frequencies(c.repartition("document_id"))).select("document_id", "term", F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x["ordinal"], x["tf"])), ",").alias("postings"))), N.with_sql(_CH + ",\n" + _TOKENS, "SELECT document_id, term, string_agg(ordinal || ':' || tf, ',' ORDER BY ordinal) AS postings FROM tf GROUP BY document_id, term")),
    "build_index": (_stored(I.metadata), N.with_sql(_CH, "SELECT document_id, 1 AS version, count(*) AS chunk_count, 1 AS chunk_format_version, 'retrieval-tokenizer-v1' AS tokenizer, 'hash-256' AS embedder_model FROM chunks GROUP BY document_id")),
    "index_validate": (_stored(lambda c: I.valid(I.metadata(c.filter("document_id <> 'book1' or ordinal > 0")), c)), N.with_sql(_CH, "SELECT document_id, document_id <> 'book1' AS valid FROM chunks GROUP BY document_id")),
    "scan_chunks_all": (_stored(lambda c: c.select("chunk_id", "document_id", "ordinal")), N.with_sql(_CH, "SELECT chunk_id, document_id, ordinal FROM chunks")),
    "scan_chunks_doc": (lambda s, d: N.corpus(s, d).chunks.filter("document_id = 'book1'").select("chunk_id", "ordinal"), N.with_sql(_CH, "SELECT chunk_id, ordinal FROM chunks WHERE document_id = 'book1'")),
    "chunks_page": (_stored(lambda c: store.paged(c, 10, 5).select("chunk_id", "ordinal", "section_title")), N.with_sql(_CH, "SELECT chunk_id, ordinal, section_title FROM chunks WHERE ordinal >= 10 AND ordinal < 15")),
    "get_chunk": (_stored(lambda c: c.filter("document_id = 'book0' and ordinal = 3").select("chunk_id", "text")), N.with_sql(_CH, "SELECT chunk_id, text FROM chunks WHERE document_id = 'book0' AND ordinal = 3")),
    "get_page": (_pages(lambda p: p.filter("document_id = 'book0' and page_number = 3")), N.with_sql(N.PAGES, "SELECT document_id, page_number, text FROM pages WHERE document_id = 'book0' AND page_number = 3")),
    "document_detail": (lambda s, d: store.detail(N.pages(s, d), N.corpus(s, d).chunks), N.with_sql(_CH, "SELECT p.document_id, page_number, left(text, 240) AS preview, length(text) AS char_count, coalesce(n, 0) AS num_chunks FROM pages p LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) c ON p.document_id = c.document_id")),
    "write_index": (
        _written,
        N.with_sql(_upto(_CH, _TOKENS, _DF, _STATS, _MAP), "SELECT 'chunks' AS name, count(*) AS rows FROM chunks UNION ALL SELECT 'postings', count(*) FROM tf UNION ALL SELECT 'frequencies', count(*) FROM df UNION ALL SELECT 'stats', count(*) FROM stats UNION ALL SELECT 'vectors', count(*) FROM chunks UNION ALL SELECT 'sections', count(*) FROM dmap UNION ALL SELECT 'meta', count(DISTINCT document_id) FROM chunks"),
    ),
    "extract_pages": (
        _pages(lambda p: store.extracted(p.select(F.concat_ws("-", "document_id", "page_number").alias("document_id"), F.concat(F.lit("\f \r\n"), F.replace("text", F.lit("\n"), F.lit(" \r\n\f")), F.lit("\f")).alias("text")))),
        N.with_sql(N.PAGES, rf"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) AS page_number, t AS text, length(t) AS char_count FROM (SELECT document_id, generate_subscripts(xs, 1) AS i, regexp_replace(regexp_replace(regexp_replace(replace(replace(unnest(xs), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\n+$', '') AS t
          FROM (SELECT document_id || '-' || page_number AS document_id, string_split(chr(12) || ' ' || chr(13) || chr(10) || replace(text, chr(10), ' ' || chr(13) || chr(10) || chr(12)) || chr(12), chr(12)) AS xs FROM pages)) WHERE {N.trim_sql("t")} <> ''"""),
    ),
}
TOKENS, DF, STATS, HASH, MAP, ENRICH = _TOKENS, _DF, _STATS, _HASH, _MAP, _ENRICH
