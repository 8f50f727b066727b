import pyarrow as pa
import pytest

from gleanery import registry
from gleanery.functions import counting
from gleanery.operators import chunking, corpus, embedding, search
from gleanery.plans import inputs
from tests.conftest import same

NAMES = ["adjacent_expansion", "build_prompt", "mmr_rerank", "pairwise_similarity", "rerank_relevance"]


@pytest.mark.parametrize("name", NAMES)
def test_no_index_is_written_for_a_few_queries(spark, sf, monkeypatch, name):
    monkeypatch.setattr(inputs, "_INDEXED", {})
    assert same(spark, sf, registry.queries()[name], registry.oracle_sql()[name])
    assert [held for _, held in inputs._INDEXED.values()] == [{"chunks"}]


def test_a_scan_finds_what_the_index_finds(spark, sf, monkeypatch):
    rows = [(f"q{i}", q, d) for i, (q, d) in enumerate(inputs.QUERIES) if q]
    q = spark.createDataFrame(rows, "query_id string, query string, document_id string")
    monkeypatch.setattr(counting, "SCANNED", 64)
    monkeypatch.setattr(inputs, "_INDEXED", {})
    c = inputs.corpus(spark, sf)
    cols = ["query_id", "rank", "chunk_id", "ordinal", "score"]
    scanned = [sorted(map(tuple, x.select(cols).collect())) for x in search.lists(q, c, 40, True)]
    assert not c.stored("postings")
    indexed = [sorted(map(tuple, x.select(cols).collect())) for x in (search.vector(q, c, 40), search.lexical(q, c, 40))]
    assert c.stored("postings") and all(indexed)
    assert scanned == indexed


def test_larger_sets_of_queries_are_indexed(spark, sf, monkeypatch):
    for module, name in ((corpus, "NAMED"), (embedding, "PASS")):
        with monkeypatch.context() as m:
            m.setattr(module, name, 1)
            m.setattr(inputs, "_INDEXED", {})
            assert same(spark, sf, registry.queries()["rerank_relevance"], registry.oracle_sql()["rerank_relevance"])
            assert [held >= {"postings", "vectors"} for _, held in inputs._INDEXED.values()] == [True]


def test_hits_meet_their_chunks_without_a_shuffle_of_texts(spark, sf):
    hits = search.candidates(inputs.queries(spark), inputs.corpus(spark, sf), "hybrid")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lists_of_sections_are_folded_a_few_at_a_time():
    bodies = pa.array([[f"Text {i}. " * 300, "Short."] for i in range(chunking.LISTS * 2 + 3)] + [None, []])
    made = list(chunking._spans(iter([bodies, bodies[:0]])))
    assert max(map(len, made)) == chunking.LISTS and sum(map(len, made)) == len(bodies)
    assert pa.concat_arrays(made).to_pylist() == [x for i in range(len(bodies)) for x in next(chunking._spans(iter([bodies[i : i + 1]]))).to_pylist()]


def test_stated_queries_need_no_python_process(spark):
    assert "RDD" not in inputs.queries(spark)._jdf.queryExecution().executedPlan().toString()


def test_packed_figures_are_those_of_the_index(spark, sf, monkeypatch):
    made = []
    for indexed in (False, True):
        monkeypatch.setattr(inputs, "_INDEXED", {})
        c = inputs.corpus(spark, sf)
        if indexed:
            assert c.postings and c.frequencies and c.stats and c.vectors
        made.append(sorted(map(tuple, registry.queries()["pack_summary"](spark, sf).collect())))
        assert c.stored("postings") == indexed
    assert made[0] == made[1] and len(made[0]) == 10
