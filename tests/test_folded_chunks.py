import random
import re

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import chunking

GAP, BREAK = re.compile(r"\n\s*\n", re.ASCII), re.compile(chunking.T.CHUNK_BREAK, re.ASCII)


def _pieces(text, pattern):
    at = 0
    for m in pattern.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _plain(body):
    """Units by the stated patterns, then packed."""
    units = []
    for s, e in _pieces(body, GAP):
        if body[s:e].strip(T.WS_CHARS):
            units += [(s, e)] if e - s <= chunking.TARGET else [(s + a, s + b) for a, b in _pieces(body[s:e], BREAK) if b > a]
    out = []
    for s, e in units:
        if out and e - out[-1][0] <= chunking.TARGET:
            out[-1] = out[-1][0], e
        else:
            out.append((s, e))
    return out


def test_sections_are_folded_by_the_stated_patterns():
    rng = random.Random(5)
    for _ in range(300):
        body = "".join(rng.choice(["Word ", "end. ", "stop.  Next", "no\n", "\n\n", "\n \t\n", "! A", "?\nB", " ", "été ", "x" * rng.choice([1, 90, 1300]), ".", "　\n\n"]) for _ in range(rng.choice([0, 1, 5, 200])))
        assert chunking.fold(body) == _plain(body)


def test_chunks_carry_no_body_through_a_sort(spark):
    pages = spark.createDataFrame([("b", 1, "1.1 One\n\n" + "Some words here. " * 400), ("b", 2, "# Two\n\n" + "y" * 3000 + ". End it.")], "document_id string, page_number int, text string")
    d = chunking.chunks(pages)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(core" not in plan and "aggregate(" not in plan
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the pages and their lengths
    rows = d.orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(len(rows))) and len(rows) > 6
    for a, b in zip(rows, rows[1:], strict=False):
        if a["section_idx"] == b["section_idx"] and len(a["core"]) > chunking.OVERLAP:
            assert b["text"] == BREAK.split(a["core"][-chunking.OVERLAP :], maxsplit=1)[-1] + b["core"]
    assert all(r["text"][r["overlap_prefix_len"] :] == r["core"] for r in rows)


def test_keywords_and_summaries_need_no_join(spark):
    ch = spark.createDataFrame([("b#0", "b", 0, "Some words. More words here.")], "chunk_id string, document_id string, ordinal int, core string")
    d = chunking.described(ch)
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()
    r = d.select("summary", F.array_join("keywords", " ").alias("k")).first()
    assert (r["summary"], r["k"]) == ("Some words. More words here.", "words here")
