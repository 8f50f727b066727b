"""Answers from packed evidence: gate, stub model, citations, confidence and reflection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery import sources
from gleanery.config import DEFAULT, EngineConfig
from gleanery.functions import text as T
from gleanery.operators import embedding, packing, search
from gleanery.operators.corpus import Corpus

LEAST_SCORE, TOP_SCORE = 0.005, 1.0 / 61
# The marker of a refusal, its canonical answer, and the stub's opening.
MARKER, REFUSAL, STUB = "INSUFFICIENT_EVIDENCE", "Insufficient evidence to answer.", "Based on the evidence: "
# What a model is told.
SYSTEM = "Answer only using the evidence. Cite support as [E#] using ASCII square brackets only — do not use 【E#†...】 or any other annotation format. If evidence is insufficient, reply INSUFFICIENT_EVIDENCE."
ASKED, GIVEN, WANTED = "QUESTION: ", "\n\nEVIDENCE:\n", "\n\nWrite a concise answer with citations."
VERIFY = 'For each numbered claim below, reply with only "Claim N: YES" or "Claim N: NO" — one per line — indicating whether the evidence supports the claim.'
STRATEGY = "query_focused_sentence_windows_with_dedup"


def gate(hits: DataFrame, queries: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """query_id, passages, max_score, dual_signal, insufficient. passages: those packed, or else all hits."""
    g = hits.groupBy("query_id").agg(F.count("*").alias("passages"), F.max("rrf_score").alias("max_score"), F.bool_or(F.coalesce((F.col("vector_score") > 0) & (F.col("lexical_score") > 0), F.lit(False))).alias("dual_signal"))
    if packed is not None:
        g = g.drop("passages").join(packed.groupBy("query_id").agg(F.count("*").alias("passages")), "query_id", "left")
    d = queries.select("query_id").join(g, "query_id", "left").fillna({"passages": 0, "max_score": 0.0, "dual_signal": False})
    return d.withColumn("insufficient", (F.col("passages") == 0) | ((F.col("max_score") < LEAST_SCORE) & ~F.col("dual_signal")))


def stub_answer(first_text: Column) -> Column:
    return F.when(first_text.isNull(), MARKER).otherwise(F.concat(F.lit(STUB), F.left(first_text, F.lit(120)), F.lit(". [E1]")))


def evidence(p: DataFrame, ch: DataFrame) -> DataFrame:
    """query_id, evidence: the passages with their labels, a blank line between them."""
    d = p.join(ch.select("chunk_id", "document_id", "page_start", "page_end"), "chunk_id")
    one = F.concat(F.lit("[E"), F.col("evidence_idx"), F.lit("] (chunk="), F.col("chunk_id"), F.lit(" doc="), F.col("document_id"), F.lit(" pages="), F.col("page_start"), F.lit("-"), F.col("page_end"), F.lit(")\n"), F.col("text"))
    d = d.withColumn("one", one).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("evidence_idx", "one"))).alias("x"))
    return d.select("query_id", F.array_join(F.transform("x", lambda x: x["one"]), "\n\n").alias("evidence"))


def message(question: Column, evidence: Column, anchor: Column) -> Column:
    """What a model is asked: question, evidence, anchors if there are any, and what is wanted."""
    anchors = F.when(anchor.isNotNull(), F.concat(F.lit("\n\n"), anchor)).otherwise("")
    return F.concat(F.lit(ASKED), question, F.lit(GIVEN), F.coalesce(evidence, F.lit("")), anchors, F.lit(WANTED))


def prompt(queries: DataFrame, p: DataFrame, summary: DataFrame, ch: DataFrame) -> DataFrame:
    """query_id, system, prompt of each query with a packed passage."""
    d = queries.select("query_id", "query").join(evidence(p, ch), "query_id").join(summary.select("query_id", "anchor_text"), "query_id", "left")
    return d.select("query_id", F.lit(SYSTEM).alias("system"), message(F.col("query"), F.col("evidence"), F.col("anchor_text")).alias("prompt"))


def citations(answers: DataFrame, p: DataFrame) -> DataFrame:
    """query_id, place, evidence_idx, chunk_id: the passages an answer cites, in order of first mention."""
    d = answers.select("query_id", F.posexplode(F.array_distinct(T.citation_numbers(F.col("answer")))).alias("pos", "evidence_idx"))
    return d.join(p.select("query_id", "evidence_idx", "chunk_id"), ["query_id", "evidence_idx"])


def claims(answers: DataFrame) -> DataFrame:
    """query_id, sentence_no, sentence, cited, claim_no (of cited sentences, from 1)."""
    s = T.answer_sentences(F.col("answer"))
    d = answers.select("query_id", F.posexplode(s).alias("sentence_no", "sentence"))
    d = d.withColumn("cited", F.size(T.citation_numbers(F.col("sentence"))) > 0)
    w = Window.partitionBy("query_id").orderBy("sentence_no")
    return d.withColumn("claim_no", F.when(F.col("cited"), F.sum(F.col("cited").cast("int")).over(w)))


def reflected(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query_id, answer without the rejected sentences, counts, requery. verdicts(query_id, claim_no, verdict); none counts as YES."""
    c = claims(answers).join(verdicts, ["query_id", "claim_no"], "left").withColumn("gone", F.col("cited") & (F.upper(F.coalesce("verdict", F.lit("YES"))) == "NO"))
    g = c.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("sentence_no", "sentence")))), lambda x: x["sentence"]), " ").alias("answer"),
        F.count("*").alias("sentences_total"),
        F.count_if("gone").alias("sentences_dropped"),
        F.count_if("cited").alias("cited"),
    )
    share = (F.col("cited") - F.col("sentences_dropped")) / F.when(F.col("cited") > 0, F.col("cited"))
    d = g.join(answers.select("query_id", "confidence"), "query_id")
    return d.select("query_id", "answer", "sentences_total", "sentences_dropped", (F.coalesce(share < 0.5, F.lit(False)) & (F.col("confidence") < 0.4)).alias("requery"))


def verification(answers: DataFrame, p: DataFrame) -> DataFrame:
    """query_id, prompt: the numbered claims of an answer, each with the passages that it cites. Answers without a citation have none."""
    c = claims(answers).filter("cited").select("query_id", "claim_no", "sentence", F.posexplode_outer(T.citation_numbers(F.col("sentence"))).alias("pos", "evidence_idx"))
    c = c.join(p.select("query_id", "evidence_idx", "text"), ["query_id", "evidence_idx"], "left")
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))), lambda x: x["text"]), " ")
    c = c.groupBy("query_id", "claim_no", "sentence").agg(held.alias("held"))
    line = F.concat(F.lit("Claim "), "claim_no", F.lit(': "'), "sentence", F.lit('" Evidence: '), "held")
    g = c.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("lines"))
    return g.select("query_id", message(F.concat(F.lit(VERIFY + "\n\n"), "lines"), F.lit(""), F.lit(None).cast("string")).alias("prompt"))


def verdicts(replies: DataFrame) -> DataFrame:
    """query_id, claim_no, verdict from replies(query_id, raw_answer); of several lines on one claim the last counts."""
    found = F.regexp_extract_all("raw_answer", F.lit(r"(?i)(Claim\s+[0-9]+\s*:\s*(?:YES|NO))"), F.lit(1))
    d = replies.select("query_id", F.posexplode(found).alias("at", "line"))
    d = d.select("query_id", "at", F.regexp_extract("line", r"([0-9]+)", 1).cast("long").alias("claim_no"), F.upper(F.regexp_extract("line", r"([A-Za-z]+)\z", 1)).alias("verdict"))
    return d.groupBy("query_id", "claim_no").agg(F.max_by("verdict", "at").alias("verdict"))


def remote_answers(prompts: DataFrame, generate: Callable[[str, str], str]) -> DataFrame:
    """query_id, raw_answer from a model service: generate takes the system's instruction and a prompt."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"query_id": x["query_id"], "raw_answer": [generate(SYSTEM, t) for t in x["prompt"]]})

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {prompts.schema['query_id'].dataType.simpleString()}, raw_answer string")


def answer(queries: DataFrame, corpus: Corpus, config: EngineConfig = DEFAULT, generate: Callable[[str, str], str] | None = None) -> DataFrame:
    """A row for each query: answer, raw_answer, citations (chunks, in order of first mention), evidence (all packed passages), insufficient, confidence, answer_score, retrieval_meta and reflection.

    Without `generate` the stub model answers, and answers aren't reflected on. Hits, passages and a model's replies are written once, so no
    service is asked twice.
    """
    config = replace(config, top_k=config.answer_top_k)
    hits = sources.written(search.search(queries, corpus, "hybrid", config))
    p = sources.written(packing.packed(hits, queries, config.context_chars))
    about, searched = packing.summary(p, hits, config.context_chars), search.facts(queries, corpus, hits, "hybrid", config)
    g = gate(hits, queries, p)
    if generate is None:
        raw = p.filter("evidence_idx = 1").select("query_id", stub_answer(F.col("text")).alias("raw_answer"))
    else:
        ready = g.filter("not insufficient").select("query_id")
        raw = sources.written(remote_answers(prompt(queries, p, about, corpus.chunks).join(ready, "query_id", "left_semi"), generate))
    d = g.join(raw.select("query_id", T.normalize_citations(F.col("raw_answer")).alias("raw")), "query_id", "left")
    d = d.withColumn("refused", F.col("insufficient") | (F.coalesce("raw", F.lit(MARKER)) == MARKER))
    place = hits.select("query_id", "chunk_id", "document_id", "ordinal", "page_start", "page_end", "section_title", "rrf_score")
    whole = p.join(place, ["query_id", "chunk_id"])
    shown = F.struct("evidence_idx", "chunk_id", "document_id", "ordinal", "page_start", "page_end", "section_title", "text", F.col("rrf_score").alias("score"))
    whole = whole.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("evidence"), F.max("rrf_score").alias("best"))
    d = d.join(whole, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(whole.schema["evidence"].dataType)))
    cited = F.filter(F.array_distinct(T.citation_numbers(F.col("raw"))), lambda x: (x >= 1) & (x <= F.size("evidence")))
    d = d.withColumn("cites", F.when(F.col("refused"), F.expr("cast(array() as array<int>)")).otherwise(cited))
    conf = T.confidence(F.col("best"), F.size("cites"), F.size("evidence"))
    d = d.withColumn("confidence", F.when(F.col("refused"), 0.0).otherwise(conf))
    d = d.withColumn("answer_score", F.when(F.col("refused"), 0.0).otherwise(T.answer_score(F.col("confidence"), F.size("cites"))))
    d = d.withColumn("raw_answer", F.when(F.col("refused"), REFUSAL).otherwise(F.col("raw")))
    active = generate is not None and config.reflection
    if active:
        d = sources.written(d)
        given = d.filter("not refused").select("query_id", F.col("raw_answer").alias("answer"), "confidence")
        replies = sources.written(remote_answers(verification(given, p), generate))
        r = reflected(given, verdicts(replies)).withColumnRenamed("answer", "clean").join(replies.select("query_id", F.lit(1).alias("calls")), "query_id", "left")
        # An answer without a citation stays as it is.
        d = d.join(r, "query_id", "left").withColumn("answer", F.when(F.col("calls") == 1, F.col("clean")).otherwise(F.col("raw_answer")))
    else:
        d = d.withColumns({"answer": F.col("raw_answer"), "sentences_total": F.lit(0), "sentences_dropped": F.lit(0), "calls": F.lit(0), "requery": F.lit(False)})
    zero = lambda c, t="long": F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c)
    scoring = F.struct("confidence", "answer_score", F.size("cites").alias("citation_count"), F.lit(TOP_SCORE).alias("rrf_top_score"))
    meta = F.struct(
        zero("hit_count"), zero("chunk_count"), zero("packed_passages"), zero("context_chars"), zero("raw_context_chars"), zero("deduplicated_chars"), F.lit(config.context_chars).alias("max_context_chars"), F.lit(STRATEGY).alias("strategy"),
        F.coalesce(F.length("anchor_text"), F.lit(0)).alias("anchor_chars"), "max_score", F.lit(config.alpha).alias("alpha"), F.lit(config.top_k).alias("top_k"), "mode", F.lit(config.llm_model if generate else embedding.NAMES[config.embedder]).alias("model"), scoring.alias("scoring"),
    )
    reflection = F.struct((F.lit(active) & ~F.col("refused")).alias("enabled"), zero("sentences_total"), zero("sentences_dropped"), zero("calls"), F.coalesce("requery", F.lit(False)).alias("requery"))
    d = d.join(about, "query_id", "left").join(searched, "query_id", "left").join(queries.select("query_id", "query"), "query_id")
    chunks = F.transform("cites", lambda i: F.get("evidence", i - 1)["chunk_id"])
    return d.select("query_id", "query", "answer", "raw_answer", "cites", chunks.alias("citations"), "evidence", F.col("refused").alias("insufficient"), "confidence", "answer_score", meta.alias("retrieval_meta"), reflection.alias("reflection"))
