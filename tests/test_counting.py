import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.functions import counting
from gleanery.functions import text as T
from gleanery.operators import embedding, index

TEXTS = ["", None, "a", "the The THE hand_hand hand", "x9 9x 'q-r 1abc' a-'b --- don't don't it's 007", "ends", "starts with ends", "Straße Kelvin İx café cafés — naïve", "and the for", "zz yy xx zz", "\x00nul a\x00b tab\tbed \n\n", "w" * 5000, "'''", "ab", "Q"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(f"b{i % 2}", f"b{i % 2}#{i}", i, t) for i, t in enumerate(TEXTS)], "document_id string, chunk_id string, ordinal int, text string").repartition(2)


@pytest.mark.parametrize("rows", [1, 2, 4096])
def test_words_are_counted_as_the_tokenisers_cut_them(texts, monkeypatch, rows):
    monkeypatch.setattr(counting, "ROWS", rows)
    want = {r["ordinal"]: r for r in texts.select("ordinal", T.lexical_tokens(F.col("text")).alias("l"), T.embedding_tokens(F.col("text")).alias("e"), T.keyword_tokens(F.col("text")).alias("k")).collect()}
    assert Counter((r["ordinal"], r["term"], r["tf"]) for r in index.term_frequencies(texts).collect()) == Counter((i, x, n) for i, w in want.items() for x, n in Counter(w["l"] or []).items())
    assert {r["ordinal"]: r["dl"] for r in index.chunk_lengths(texts).collect()} == {i: len(w["l"] or []) for i, w in want.items()}
    got = {r["ordinal"]: r for r in texts.select("ordinal", counting.buckets(F.col("text")).alias("b"), counting.keywords(F.col("text"), 8).alias("k")).collect()}
    for i, w in want.items():
        assert sum(n for _, n in got[i]["b"]) == len(w["e"] or [])
        assert got[i]["k"] == [x for x, _ in sorted(Counter(w["k"] or []).items(), key=lambda x: (-x[1], x[0]))][:8]


def test_counting_neither_sorts_nor_shuffles(texts):
    for df in (index.term_frequencies(texts.coalesce(1)), embedding.counts(texts.coalesce(1), ["chunk_id"], "text")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array" not in plan and "regexp_extract_all" not in plan


def test_frequencies_of_all_are_made_of_each_ones(texts):
    tf = index.term_frequencies(texts)
    assert "Expand" not in index.document_frequencies(tf)._jdf.queryExecution().executedPlan().toString()
    held = Counter()
    for r in tf.collect():
        held[r["document_id"], r["term"]] += 1
        held[index.ALL, r["term"]] += 1
    assert {(r["scope"], r["term"]): r["df"] for r in index.document_frequencies(tf).collect()} == held


def test_runs_of_words_know_their_row(spark):
    rows = spark.createDataFrame([(0, "a b c d"), (1, "b c"), (2, "x y b\n c"), (3, None), (4, "")], "i int, t string").coalesce(1)
    got = {r["i"]: r["h"] for r in rows.select("i", counting.runs_of_words(F.col("t"), 2).alias("h")).collect()}
    assert [len(got[i]) for i in range(5)] == [3, 1, 2, 0, 0]
    assert got[0][1] == got[1][0] == got[2][1] and len({*got[0], *got[2]}) == 4
    assert len(re.findall(r"\S+", "x y b\n c", re.ASCII)) == 3
