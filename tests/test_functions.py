import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import chunking, expansion, packing, rerank, store, views


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "text", "expected"),
    [
        (T.lexical_tokens, "naïve Größe a_b", ["na", "ve", "gr", "a_b"]),
        (T.normalize_query, "foo?", "foo"),
        (T.normalize_query, "foo? ", "foo?"),
        (T.packing_sentences, "Foo. bar\nbaz qux\n...x. y", ["Foo.", "bar", "baz qux", "...x. y"]),
        (T.normalize_page, "a \r\nb\r\n\r\n\r\nc\n", "a\nb\n\nc"),
        (T.normalize_citations, "x 【E 2†L1】 [ E03 ]", "x [E2] [E3]"),
        (T.strip_question_prefix, "what is it", "it"),
        (T.trim, " a b﻿", "a b"),
    ],
)
def test_fixed_values(spark, f, text, expected):
    assert value(spark, f(F.col("t")), t=text) == expected


def test_hyphen_joins_use_ascii_word_edges(spark):
    assert value(spark, expansion.lexical_variants(F.col("t")), t="a b c d e")[-1] == "a-b c-d e"
    assert value(spark, expansion.lexical_variants(F.col("t")), t="é à") == []


def test_percentile_and_generator(spark):
    assert value(spark, T.percentile_floor(F.array(F.lit(2.0), F.lit(1.0)), 0.95), t="") == 1.0
    assert value(spark, T.lcg(42, 3), t="") == [1083814273, 378494188, 2479403867]


def test_confidence(spark):
    one = lambda c, n: value(spark, T.confidence(F.lit(1 / 61), F.lit(c), F.lit(n)), t="")
    assert one(2, 3) == pytest.approx(1.0)
    assert one(0, 1) == pytest.approx(0.35 * (0.75 + 0.25 / 3))
    assert one(0, 0) == 0


def test_chunks_cover_their_sections(spark):
    text = "intro line one\n\n# Head\n\n" + " ".join(f"Sentence number {i} is here." for i in range(120)) + "\n\n" + "x" * 3000
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, "tail page")], "document_id string, page_number int, text string")
    full = text + "\n\n" + "tail page"
    rows = chunking.chunks(pages).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r["core"] == full[r["char_start"] : r["char_end"]] == r["text"][r["overlap_prefix_len"] :]
        assert r["page_start"] <= r["page_end"]
        assert len(r["core"]) <= 1200 or " " not in r["core"]
    assert rows[0]["overlap_prefix_len"] == 0 and rows[0]["section_title"] is None and rows[-1]["page_end"] == 2
    assert all(a["char_end"] <= b["char_start"] for a, b in zip(rows, rows[1:]))


def test_blank_documents_have_no_chunks(spark):
    assert chunking.chunks(spark.createDataFrame([("d", 1, " \n ")], "document_id string, page_number int, text string")).count() == 0


def test_empty_pages_are_dropped_before_numbering(spark):
    r = store.extracted(spark.createDataFrame([("d", "a\f \f\nb")], "document_id string, text string")).orderBy("page_number").collect()
    assert [(x["page_number"], x["text"].strip()) for x in r] == [(1, "a"), (2, "b")]


def test_shortened_text_ends_at_a_sentence_or_word():
    assert packing.shortened("abc. def ghi", 9) == "abc. def"
    assert packing.shortened("abcde. f ghi jkl", 9) == "abcde."
    assert packing.shortened("abcdefghijkl", 5) == "abcde" and packing.shortened("abc", 5) == "abc"


def test_memory_knows_what_contains_what():
    m = packing.Memory()
    m.add("A first sentence of some length that goes on and on until it has more than eighty characters. Short one.")
    assert m.holds(packing.normal("A first sentence of some length that goes on and on until it has more than eighty characters."))
    assert m.holds("so: " + packing.normal("A first sentence of some length that goes on and on until it has more than eighty characters."))
    assert not m.holds("short one.") and not m.holds("a first sentence of some length")


def test_greedy_choice():
    row = lambda rel, tokens, doc: {"relevance": rel, "tokens": set(tokens), "document_id": doc, "page_start": 1, "page_end": 1}
    rows = [row(1.0, "ab", "x"), row(0.99, "ab", "x"), row(0.8, "cd", "y")]
    assert rerank.pick(rows, 3, 0.72) == [0, 2, 1]
    assert rerank.pick(rows, 0, 0.72) == [0]


def test_pages_shown(spark):
    r = views.pagination(spark.createDataFrame([(1, 48, 5)], "id int, total int, page int")).first()
    assert (r["total_pages"], r["pages"], r["first"], r["last"]) == (10, "1,4,5,6,10", 21, 25)
