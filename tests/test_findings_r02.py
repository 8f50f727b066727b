from pyspark.sql import functions as F

import corpus_pipeline
from gleanery import registry
from gleanery.functions import text as T
from gleanery.llm import components, simhash
from gleanery.operators import corpus, expansion
from gleanery.plans import inputs


def test_near_duplicates_go_by_fingerprints_too(spark, sf):
    """Texts of one fingerprint whose sets of shingles differ: the named method links them, similarity doesn't."""
    texts = ["a b c " * 300 + " ".join(f"{k}w{i}" for i in range(40)) for k in "xy"] + ["some other text of a few words"]
    assert simhash.simhash(texts[0]) == simhash.simhash(texts[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, 1, 2]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == [0, 2]


def test_variants_beyond_the_most_are_not_made(spark):
    rows = [("stories-of co_op words and stories, the babies. the words",), ("",), ("?!.",), (" ".join(f"word{i}s" for i in range(300)),)]
    n = F.col("n")
    d = spark.createDataFrame(rows, "n string").select("n", expansion.lexical_variants(n).alias("all"), expansion.first_variants(n, F.array_distinct(T.expansion_tokens(n)), 8).alias("few"))
    names = F.array_distinct(F.filter(F.transform("all", T.normalize_query), lambda x: x != ""))
    for r in d.withColumns({"want": F.slice(names, 1, 8), "got": F.slice(F.transform("few", T.normalize_query), 1, 8)}).collect():
        assert r["got"] == r["want"] and len(r["few"]) <= 13


def test_queries_write_only_the_tables_they_read(spark, sf, monkeypatch):
    monkeypatch.setattr(inputs, "_INDEXED", {})
    registry.queries()["query_terms"](spark, sf).collect()
    assert not inputs._INDEXED
    registry.queries()["get_chunk"](spark, sf).collect()
    assert [held for _, held in inputs._INDEXED.values()] == [{"chunks"}]
    registry.queries()["lexical_search"](spark, sf).collect()
    assert [held for _, held in inputs._INDEXED.values()] == [{"chunks", "postings", "frequencies", "stats"}]


def test_postings_are_counted_without_a_shuffle(spark, sf):
    made = corpus.derived(inputs.corpus(spark, sf).chunks)
    for df in (made.postings, made.vectors):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_rows_of_the_terms_asked_are_joined(spark, sf, monkeypatch):
    terms = spark.createDataFrame([("the",), ("zzqx",), ("hand",)], "term string")
    postings = inputs.corpus(spark, sf).postings
    some = postings.filter(corpus.held(terms)).select("term").distinct().collect()
    assert {r["term"] for r in some} <= {"the", "zzqx", "hand"}
    monkeypatch.setattr(corpus, "NAMED", 1)
    more = postings.filter(corpus.held(terms))
    assert more.filter(F.col("term") == "hand").count() == postings.filter(F.col("term") == "hand").count()


def test_narrow_tables_are_written_by_few_tasks(spark):
    """Each file costs an executor processes of its own: labels of a few nodes aren't dealt over all shuffle partitions."""
    df = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)], "a long, b long")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        labels = components.components(df)
        assert len(labels.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, labels.collect())) == sorted((i + j, i) for i in range(0, 400, 2) for j in range(2))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
