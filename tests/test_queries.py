import re

import pytest
import regex
from pyspark.sql import functions as F

from gleanery import registry
from gleanery.functions import text as T
from gleanery.operators import packing
from gleanery.plans import answers
from tests.conftest import same

NAMES = ["chunks", "document_map", "section_enrich", "hash_embed", "corpus_stats", "inverted_index", "expand_query", "bm25_scores", "vector_search", "hybrid_candidates", "section_routing_filter", "rerank_relevance", "evidence_gate", "reflection_filter", "parse_citations", "collapse_sections", "vector_search_table", "tok_rerank", "search_lexical", "search_hybrid", "mmr_rerank", "adjacent_expansion", "pairwise_similarity", "evidence_anchor", "build_prompt", "eval_report", "default_queries", "ingest_status", "search_meta", "tok_packing"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_those_of_the_sql(spark, sf, name):
    assert same(spark, sf, registry.queries()[name], registry.oracle_sql()[name])


def test_search_reads_the_index_and_no_document(spark, sf):
    plan = registry.queries()["search_hybrid"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and plan.count("Relation [") <= 8


class Model:
    """Packing as its description says, one passage after another, on plain lists."""

    stop = set(T.STOPWORDS) | set(T.MORE_STOPWORDS)

    def __init__(self, query: str):
        self.phrase, self.terms, self.seen = self.normal(query), self.tokens(query), []

    normal = staticmethod(lambda x: " ".join(x.lower().split()))

    def tokens(self, x: str) -> set[str]:
        return {t for t in regex.findall(r"[\p{L}\p{N}][\p{L}\p{N}'-]*", x.lower()) if len(t) >= 2 and t not in self.stop}

    def sentences(self, x: str) -> list[str]:
        return [" ".join(s.split()) for s in re.findall(r"[^.!?\n]+(?:[.!?]+|\Z)|[^\n]+", x) if s.strip()]

    def score(self, s: str) -> float:
        return sum(1.4 if len(t) >= 6 else 1.0 for t in self.tokens(s) & self.terms) + 4 * (self.phrase != "" and self.phrase in self.normal(s))

    def old(self, s: str) -> bool:
        n = self.normal(s)
        return len(n) >= 24 and any(n == x or (len(x) >= 80 and x in n) or (len(n) >= 80 and n in x) for x in self.seen)

    def cut(self, x: str, most: int) -> str:
        if len(x) <= most:
            return x
        x = x[:most]
        stop = max(x.rfind(m) for m in (". ", "? ", "! "))
        word = x.rfind(" ")
        return (x[: stop + 1] if stop > most * 0.45 else x[:word] if word > most * 0.5 else x).rstrip()

    def passage(self, text: str, left: int) -> str:
        parts = self.sentences(text)
        scores = [self.score(s) for s in parts]
        order = sorted(range(len(parts)), key=lambda i: (-scores[i], i))
        best = [i for i in order if scores[i] > 0][:3] or order[:1]
        some = [parts[i] for i in sorted({j for i in best for j in (i - 1, i, i + 1) if 0 <= j < len(parts)}) if not self.old(parts[i])]
        for chosen, most in ((some, 950), ([s for s in parts if not self.old(s)], 220)):
            out = []
            for s in chosen:
                out.append(s)
                if len(" ".join(out)) >= most:
                    break
            if out:
                break
        got = self.cut(self.cut(" ".join(out), 950), left)
        self.seen += [n for s in self.sentences(got) if len(n := self.normal(s)) >= 24]
        return got


def test_packed_evidence_equals_the_model(spark, sf):
    q, hits = answers._found(spark, sf)
    got = {(r["query_id"], r["evidence_idx"]): (r["chunk_id"], r["text"]) for r in packing.packed(hits, q).collect()}
    facts = {r["query_id"]: r for r in packing.summary(packing.packed(hits, q), hits).collect()}
    want = {}
    for i, query, _ in q.collect():
        model, left, k = Model(query), 6000, 0
        for h in sorted(hits.filter(F.col("query_id") == i).collect(), key=lambda r: r["rank"]):
            if left > 0 and (text := model.passage(h["text"], left)):
                k, left = k + 1, left - len(text)
                want[i, k] = h["chunk_id"], text
        if k:
            assert facts[i]["packed_passages"] == k and facts[i]["context_chars"] == 6000 - left + len(facts[i]["anchor_text"] or "")
    assert got == want and len(got) > 10
    few = packing.packed(hits, q, 700).groupBy("query_id").agg(F.sum(F.length("text")).alias("n")).collect()
    assert few and all(r["n"] <= 700 for r in few)


def test_answers_refuse_without_evidence(spark, sf):
    rows = {r["query_id"]: r for r in registry.queries()["answer_stub"](spark, sf).collect()}
    assert rows[4]["insufficient"] and rows[4]["answer"] == "Insufficient evidence to answer."
    assert rows[0]["answer"].startswith("Based on the evidence: ") and rows[0]["citations"].startswith("book")


def test_gold_is_what_holds_the_passage(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(30))
    passages = [words, f"One here. Two {words}", "Short one.", f"A b c.\nD e f g h i j k l m. {words}"]
    texts = [f"x{passages[0]}y. More", f"Before. {passages[1]} and on without an end", f"Ab Short one. {passages[3]}z", "Nothing here", None, f"a {passages[0][1:]}"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(50 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries, hit = answers._gold(spark, str(tmp_path))
    held = {(1000 + i, f"book{k}") for i, p in enumerate(passages) for k, t in enumerate(texts) if t and p in t}
    assert {tuple(r) for r in hit.select("query_id", "document_id").collect()} == held
    assert {r["query_id"] for r in queries.collect()} == {i for i, _ in held}
