"""Queries of packing, answering, evaluation and the document table."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.config import DEFAULT
from gleanery.functions import counting
from gleanery.functions import text as T
from gleanery.operators import answering as A
from gleanery.operators import chunking as C
from gleanery.operators import evaluate as V
from gleanery.operators import packing as P
from gleanery.operators import search as S
from gleanery.operators import store
from gleanery.plans import functions as PF
from gleanery.plans import ingestion as PI
from gleanery.plans import inputs as N
from gleanery.plans import retrieval as PR
from gleanery.sources import remove_at_exit, report, scratch, table, written
from gleanery.streaming import ingest, uploads

_FUSED = ",\n".join([PR.SOURCES[k] for k in ("lexical", "hash", "vector", "fused")])
_ANSWERING = replace(DEFAULT, top_k=DEFAULT.answer_top_k)


def _found(spark, d):
    """Stated queries and the hits from which they are answered, written once."""
    q = N.queries(spark)
    return q, written(S.search(q, N.corpus(spark, d), "hybrid", _ANSWERING))


def _packed(spark, d):
    q, hits = _found(spark, d)
    return P.packed(hits, q).drop("rank")


def _pack_summary(spark, d):
    q, hits = _found(spark, d)
    return P.summary(P.packed(hits, q), hits)


def _given(spark, d):
    """Hits taken as passages as they are, with no fold between: queries, passages, hits."""
    q, hits = _found(spark, d)
    return q, hits.filter("rank <= 3").select("query_id", F.col("rank").alias("evidence_idx"), "chunk_id", "text"), hits


def _anchors(spark, d):
    q, p, hits = _given(spark, d)
    return P.summary(p, hits).select("query_id", "raw_context_chars", "context_chars", "anchor_text")


def _prompts(spark, d):
    q, p, hits = _given(spark, d)
    return A.prompt(q, p, P.summary(p, hits), N.corpus(spark, d).chunks)


_HITS = ",\n".join([PR.HYBRID, PR.relevance_sql("hybrid"), PR.SIMILAR, PR.mmr_sql(8)])
_NOTE = f"""given AS (SELECT * FROM found WHERE rank <= 3),
 firsts AS (SELECT query_id, rank, {PF._boundary_sql(f"{PF._SENTENCES('text')}[1]", 150)} AS s FROM given),
 notes AS (SELECT query_id, sum(length(text)) AS used, count(*) AS n FROM given GROUP BY query_id),
 labels AS (SELECT query_id, 'Evidence anchors: ' || string_agg('[E' || rank || '] ' || s, ' | ' ORDER BY rank) AS t FROM firsts GROUP BY query_id),
 anchors AS (SELECT r.query_id, r.raw, n.used, CASE WHEN n >= 2 AND least(650, greatest(0, 6000 - used)) >= 180 THEN {PF._boundary_sql("t", "CAST(least(650, 6000 - used) AS INTEGER)")} END AS anchor_text FROM (SELECT query_id, sum(length(text)) AS raw FROM found GROUP BY query_id) r JOIN notes n ON n.query_id = r.query_id JOIN labels l ON l.query_id = r.query_id)"""


def _meta(spark, d):
    """Document rows as the table of documents holds them."""
    x = table(spark, d, "documents")
    return x.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("f"), "doc_id", F.lit(".pdf")).alias("filename"), F.col("n_chars").alias("size_bytes"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("ready").alias("status"), F.timestamp_seconds(F.col("doc_id") * 37 % 5000 + 1700000000).alias("created_at"), F.lit("x").alias("storage_path"))


_META = "meta AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'f' || doc_id || '.pdf' AS filename, n_chars AS size_bytes, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS status, CAST(doc_id * 37 % 5000 + 1700000000 AS BIGINT) AS created FROM documents)"


def _meta_columns(df):
    return df.select("id", "filename", "size_bytes", "status", F.unix_timestamp("created_at").alias("created"))


def _answers(spark, d):
    return PF._cited(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "answer", (F.col("turn") / 10.0).alias("confidence"))


_ANSWERS = f"answers AS (SELECT conv_id * 1000 + turn AS query_id, {PF._NORMAL_CITED} AS answer, turn / 10.0::DOUBLE AS confidence FROM conversations)"
_CLAIMS = rf"""s AS (SELECT query_id, generate_subscripts(xs, 1) - 1 AS sentence_no, unnest(xs) AS sentence FROM (SELECT query_id, {PF._ANSWER("answer")} AS xs FROM answers)),
 claims AS (SELECT *, regexp_matches(sentence, '\[E[0-9]+\]') AS cited FROM s),
 numbered AS (SELECT *, CASE WHEN cited THEN sum(CAST(cited AS INTEGER)) OVER (PARTITION BY query_id ORDER BY sentence_no) END AS claim_no FROM claims)"""


def _verdicts(spark, d):
    return A.claims(_answers(spark, d)).filter("claim_no is not null").select("query_id", "claim_no", F.when((F.col("query_id") + F.col("claim_no")) % 3 == 0, "no").otherwise("YES").alias("verdict"))


#: Words of the run by which a passage is found.
RUN = 8


def _gold(spark, d):
    """Benchmark passages as queries; gold: the books that hold them."""
    b = table(spark, d, "benchmark").select((F.col("item_id") + 1000).cast("int").alias("query_id"), "text")
    docs = table(spark, d, "documents").select("doc_id", "text")
    # Passages are found by a run of words inside them, whole in any text that holds the passage; shorter ones are sought in all texts.
    words = T.matches(F.col("text"), r"\S+")
    runs = counting.runs_of_words(F.col("text"), RUN)
    s = docs.select("doc_id", F.explode(runs).alias("k"))
    q = b.withColumn("w", words).filter(F.size("w") > 0)
    met = s.join(q.filter(F.size("w") >= RUN + 2).select("query_id", F.get(runs, F.lit(1)).alias("k")), "k").select("query_id", "doc_id").distinct()
    long = met.join(b, "query_id").join(docs.withColumnRenamed("text", "t"), "doc_id")
    short = q.filter(F.size("w") < RUN + 2).select("query_id", "text").join(docs.withColumnRenamed("text", "t"), F.contains("t", "text"))
    held = long.filter(F.contains("t", "text")).select("query_id", "doc_id").unionByName(short.select("query_id", "doc_id"))
    hit = written(held.select("query_id", F.concat(F.lit("book"), F.floor(F.col("doc_id") / 50)).alias("document_id")).distinct())
    queries = b.join(hit.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.array_join(F.slice(T.matches(F.col("text"), r"\S+"), 3, 8), " ").alias("query"), F.lit(None).cast("string").alias("document_id"))
    return written(queries), hit


def _eval(mode, given=None):
    def run(spark, d):
        q, gold = given or _gold(spark, d)
        hits = S.search(q, N.corpus(spark, d), mode, replace(DEFAULT, top_k=5))
        return V.retrieval(gold, hits, 5).select(F.lit(mode).alias("mode"), F.round("recall_at_k", 7).alias("recall_at_k"), F.round("mrr", 7).alias("mrr"), "n")

    return run


_GOLD = r"""gold AS (SELECT DISTINCT CAST(b.item_id + 1000 AS INTEGER) AS query_id, 'book' || (d.doc_id // 50) AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(regexp_extract_all(b.text, '\S+')) > 0),
 queries AS (SELECT CAST(item_id + 1000 AS INTEGER) AS query_id, array_to_string(regexp_extract_all(text, '\S+')[3:10], ' ') AS query, CAST(NULL AS VARCHAR) AS document_id FROM benchmark WHERE CAST(item_id + 1000 AS INTEGER) IN (SELECT query_id FROM gold))"""


def _eval_sql(mode):
    """Recall and reciprocal rank of one mode over the benchmark's passages."""
    if mode == "vector":
        ctes = [N.UP_TO_CHUNKS, PI.HASH, N.QUERY_ROWS, PR.SOURCES["vector"], "found AS (SELECT * FROM vec WHERE rank <= 5)"]
    else:
        ctes = [PR.HYBRID if mode == "hybrid" else PR.SOURCES["lexical"], PR.relevance_sql(mode), PR.SIMILAR, PR.mmr_sql(5)]
    ctes = ",\n".join(ctes).replace(N.QUERY_ROWS, _GOLD)
    return N.with_sql(ctes, f"""SELECT '{mode}' AS mode, round(avg(CASE WHEN r IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 7) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / r, 0.0::DOUBLE)), 7) AS mrr, count(*) AS n
      FROM queries q LEFT JOIN (SELECT f.query_id, min(f.rank) AS r FROM found f JOIN gold g ON g.query_id = f.query_id AND g.document_id = f.document_id GROUP BY f.query_id) x ON x.query_id = q.query_id""")


_GATE = "SELECT q.query_id, count(f.chunk_id) AS passages, round(coalesce(max(rrf_score), 0), 7) AS max_score, coalesce(bool_or(vector_score > 0 AND lexical_score > 0), false) AS dual_signal, count(f.chunk_id) = 0 OR (max(rrf_score) < 0.005 AND NOT coalesce(bool_or(vector_score > 0 AND lexical_score > 0), false)) AS insufficient FROM queries q LEFT JOIN fused f ON f.query_id = q.query_id GROUP BY q.query_id"

def _ingested(spark, d):
    """Records of all books after their ingestion, of which book2's text can't be extracted."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\f")
    books = N.pages(spark, d).groupBy("document_id").agg(text.alias("text"))
    bad = F.col("document_id") == "book2"
    raw = books.select("document_id", F.when(~bad, F.col("text")).alias("text"), F.when(bad, "no text in it").alias("error"))
    pending = uploads(books.select("document_id", F.octet_length("text").alias("size_bytes")))
    folder = scratch(spark)
    remove_at_exit(spark, folder)
    return ingest(pending, raw, folder, 0).select("id", "status", "error", "num_pages")


def _answered(spark, d):
    a = A.answer(N.queries(spark), N.corpus(spark, d))
    return a.select("query_id", "answer", F.array_join("citations", ",").alias("citations"), "insufficient", F.round("confidence", 7).alias("confidence"), F.round("answer_score", 7).alias("answer_score"), F.size("evidence").alias("passages"), "retrieval_meta.context_chars", "retrieval_meta.hit_count", "retrieval_meta.chunk_count", "reflection.enabled")


def _compared(spark, d):
    """Every mode, with the same queries and gold."""
    given = _gold(spark, d)
    return reduce(DataFrame.unionByName, [_eval(mode, given)(spark, d) for mode in ("lexical", "vector", "hybrid")])


def _reported(spark, d):
    """The report as its reader finds it in the file."""
    path = scratch(spark)
    remove_at_exit(spark, path)
    report(_eval("hybrid")(spark, d), path)
    return spark.read.schema("mode string, recall_at_k double, mrr double, n long").json(path)


QUERIES = {
    "passages_from_hits": (lambda s, d: S.candidates(N.queries(s), N.corpus(s, d), "vector").select("query_id", "rank", "chunk_id", F.round("rrf_score", 7).alias("score"), "page_start", "page_end", "text"), N.with_sql(",\n".join([N.UP_TO_CHUNKS, PI.HASH, N.QUERY_ROWS, PR.SOURCES["vector"]]), "SELECT query_id, rank, chunk_id, round(score, 7) AS score, page_start, page_end, text FROM vec JOIN chunks c USING (chunk_id) WHERE rank <= 20")),
    "pack_evidence": (_packed, None),
    "pack_summary": (_pack_summary, None),
    "evidence_anchor": (_anchors, N.with_sql(",\n".join([_HITS, _NOTE]), "SELECT query_id, CAST(raw AS BIGINT) AS raw_context_chars, CAST(used + coalesce(length(anchor_text), 0) AS BIGINT) AS context_chars, anchor_text FROM anchors")),
    "sentence_rank": (PF._scored, PF.QUERIES["sentence_score"][1]),
    "build_prompt": (_prompts, N.with_sql(",\n".join([_HITS, _NOTE]), f"""SELECT q.query_id, '{A.SYSTEM}' AS system, 'QUESTION: ' || q.query || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) || e.t || CASE WHEN a.anchor_text IS NULL THEN '' ELSE chr(10) || chr(10) || a.anchor_text END || chr(10) || chr(10) || 'Write a concise answer with citations.' AS prompt
      FROM queries q JOIN (SELECT query_id, string_agg('[E' || rank || '] (chunk=' || chunk_id || ' doc=' || document_id || ' pages=' || page_start || '-' || page_end || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS t FROM given GROUP BY query_id) e ON e.query_id = q.query_id LEFT JOIN anchors a ON a.query_id = q.query_id""")),
    "evidence_gate": (lambda s, d: A.gate(S.candidates(N.queries(s), N.corpus(s, d), "hybrid"), N.queries(s)).withColumn("max_score", F.round("max_score", 7)), N.with_sql(_FUSED, _GATE)),
    "llm_stub_answer": (lambda s, d: table(s, d, "documents").select("doc_id", A.stub_answer(F.col("text")).alias("v")), "SELECT doc_id, 'Based on the evidence: ' || left(text, 120) || '. [E1]' AS v FROM documents"),
    "insufficient_reply": (lambda s, d: table(s, d, "documents").select("doc_id", A.stub_answer(F.when(F.col("doc_id") % 2 == 0, F.col("text"))).alias("raw")).select("doc_id", F.when(F.col("raw") == A.MARKER, A.REFUSAL).otherwise(F.col("raw")).alias("v")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Based on the evidence: ' || left(text, 120) || '. [E1]' ELSE 'Insufficient evidence to answer.' END AS v FROM documents"),
    "parse_citations": (lambda s, d: A.citations(_answers(s, d), _answers(s, d).select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("evidence_idx")).withColumn("chunk_id", F.concat(F.lit("c"), "evidence_idx"))), rf"""WITH {_ANSWERS}, x AS (SELECT query_id, list_transform(regexp_extract_all(answer, '\[E([0-9]+)\]', 1), lambda v: CAST(v AS INTEGER)) AS xs FROM answers), u AS (SELECT query_id, list_filter(xs, lambda v, i: list_position(xs, v) = i) AS us FROM x), p AS (SELECT query_id, generate_subscripts(us, 1) - 1 AS pos, unnest(us) AS evidence_idx FROM u) SELECT query_id, pos, evidence_idx, 'c' || evidence_idx AS chunk_id FROM p WHERE evidence_idx BETWEEN 1 AND 3"""),
    "reflection_claims": (lambda s, d: A.claims(_answers(s, d)), f"WITH {_ANSWERS}, {_CLAIMS} SELECT query_id, sentence_no, sentence, cited, claim_no FROM numbered"),
    "reflection_filter": (lambda s, d: A.reflected(_answers(s, d), _verdicts(s, d)), rf"""WITH {_ANSWERS}, {_CLAIMS}, g AS (SELECT *, cited AND (query_id + claim_no) % 3 = 0 AS gone FROM numbered),
      a AS (SELECT query_id, coalesce(string_agg(sentence, ' ' ORDER BY sentence_no) FILTER (WHERE NOT coalesce(gone, false)), '') AS answer, count(*) AS sentences_total, count(*) FILTER (WHERE gone) AS sentences_dropped, count(*) FILTER (WHERE cited) AS cited FROM g GROUP BY query_id)
      SELECT a.query_id, a.answer, sentences_total, sentences_dropped, coalesce((cited - sentences_dropped) / nullif(cited, 0)::DOUBLE < 0.5, false) AND confidence < 0.4 AS requery FROM a JOIN answers USING (query_id)"""),
    "answer_stub": (_answered, None),
    "eval_retrieval": (_compared, " UNION ALL ".join(f"(SELECT * FROM ({_eval_sql(m)}))" for m in ("lexical", "vector", "hybrid"))),
    "eval_answer": (lambda s, d: V.faithfulness(table(s, d, "labels").select(F.when(F.col("doc_id") % 5 > 0, F.col("quality") == 1).alias("faithful"), (F.col("toxic") == 1).alias("insufficient"), (F.col("doc_id") % 2 == 0).alias("requery"))).withColumn("faithfulness", F.round("faithfulness", 7)), "SELECT round(avg(CASE WHEN doc_id % 5 > 0 THEN CAST(quality = 1 AS INTEGER) END), 7) AS faithfulness, count(*) FILTER (WHERE toxic = 1) AS insufficient_count, count(*) FILTER (WHERE doc_id % 2 = 0) AS requery_count, count(*) AS n FROM labels"),
    "eval_report": (_reported, f"SELECT mode, recall_at_k, mrr, n FROM ({_eval_sql('hybrid')})"),
    "sample_chunks": (lambda s, d: V.sample(N.corpus(s, d).chunks, 20), None),
    "stub_questions": (lambda s, d: V.stub_questions(N.corpus(s, d).chunks), N.with_sql(N.UP_TO_CHUNKS, "SELECT chunk_id, 'What does chunk ' || ordinal || ' describe?' AS question, left(text, 200) AS gold_answer FROM chunks")),
    "default_queries": (lambda s, d: (lambda ch: V.default_queries(ch, C.described(ch)))(N.corpus(s, d).chunks), N.with_sql(N.UP_TO_CHUNKS + ",\n" + PI._KEYWORDS, rf"""SELECT row_number() OVER (ORDER BY document_id, ordinal, k) AS place, query FROM (
      SELECT query, p.document_id AS document_id, p.ordinal AS ordinal, p.k AS k FROM (SELECT query, min(struct_pack(document_id := document_id, ordinal := ordinal, k := k)) AS p FROM (
        SELECT document_id, ordinal, k, CASE WHEN length({PF._COLLAPSED("raw")}) <= 80 THEN {PF._COLLAPSED("raw")} ELSE left({PF._COLLAPSED("raw")}, 79) || '...' END AS query FROM (
          SELECT c.document_id, c.ordinal, unnest([0, 1, 2, 3]) AS k, unnest([c.section_title, {PI.summary_sql("c.core")}, array_to_string(w.ks[1:5], ' '), c.text]) AS raw FROM chunks c LEFT JOIN keywords w ON w.chunk_id = c.chunk_id) WHERE raw IS NOT NULL)
      WHERE length(query) >= 8 GROUP BY query)) ORDER BY place LIMIT 5""")),
    "list_documents": (lambda s, d: _meta_columns(store.listed(_meta(s, d))), f"WITH {_META} SELECT * FROM meta"),
    "get_document": (lambda s, d: _meta_columns(store.get(_meta(s, d), "7")), f"WITH {_META} SELECT * FROM meta WHERE id = '7'"),
    "upsert_documents": (lambda s, d: _meta_columns(store.upserted(_meta(s, d), _meta(s, d).filter("size_bytes > 2000").withColumn("status", F.lit("pending")))), f"WITH {_META} SELECT id, filename, size_bytes, CASE WHEN size_bytes > 2000 THEN 'pending' ELSE status END AS status, created FROM meta"),
    "delete_document": (lambda s, d: store.deleted(N.corpus(s, d).chunks, s.createDataFrame([("book1",)], "id string"), "document_id").select("chunk_id"), N.with_sql(N.UP_TO_CHUNKS, "SELECT chunk_id FROM chunks WHERE document_id <> 'book1'")),
    "ingest_status": (_ingested, N.with_sql(N.PAGES, rf"SELECT document_id AS id, CASE WHEN document_id = 'book2' THEN 'failed' ELSE 'ready' END AS status, CASE WHEN document_id = 'book2' THEN 'no text in it' END AS error, CASE WHEN document_id <> 'book2' THEN CAST(count(*) FILTER (WHERE {N.trim_sql('text')} <> '') AS INTEGER) END AS num_pages FROM pages GROUP BY document_id")),
}
