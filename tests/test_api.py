import pytest
from pyspark.sql import functions as F

from gleanery import sources, streaming
from gleanery.api import ApiError, Library
from gleanery.operators import answering, corpus, embedding, search

BOOK = "# Foxes\n\nThe quick brown fox jumps over the lazy dog in the morning. Foxes live in dens and hunt at night.\f# Whales\n\nWhales are large mammals that live in the sea. They breathe air with lungs."


def extract(content: bytes) -> str:
    text = content.decode()
    if text.startswith("broken"):
        raise ValueError("no text in it")
    return text


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "a.pdf").write_text(BOOK)
    (d / "b.pdf").write_text("Bread is baked from flour and water. Bakers rise early.")
    (d / "c.pdf").write_text("broken")
    return d


@pytest.fixture(scope="module")
def library(spark, files, tmp_path_factory):
    lib = Library(spark, str(tmp_path_factory.mktemp("library")), extract)
    lib.upload(f"{files}/*.pdf")
    return lib


def by_name(library):
    return {r["filename"]: r for r in library.documents().collect()}


def test_states_and_parts(library):
    d = by_name(library)
    assert {n: (r["status"], r["error"], r["num_pages"]) for n, r in d.items()} == {"a.pdf": ("ready", None, 2), "b.pdf": ("ready", None, 1), "c.pdf": ("failed", "no text in it", None)}
    a = d["a.pdf"]["id"]
    assert library.status(d["c.pdf"]["id"]) == {"id": d["c.pdf"]["id"], "status": "failed", "error": "no text in it", "progress": None}
    assert library.document(a).first()["num_chunks"] == 2 and library.chunks(a).count() == 2 and library.chunks(a, 1, 1).count() == 1
    assert "Whales" in library.page(a, 2).first()["text"] and library.map(a).count() == 2
    for call in (lambda: library.document("none"), lambda: library.chunk(a, 99), lambda: library.page(a, 9), lambda: library.map(d["c.pdf"]["id"])):
        with pytest.raises(ApiError) as e:
            call()
        assert e.value.status == 404
    assert library.health()["status"] == "ok"


def test_uploads_are_refused(spark, library, files, tmp_path):
    (tmp_path / "x.txt").write_text("text")
    with pytest.raises(ApiError) as e:
        library.upload(f"{tmp_path}/x.txt", "text/plain")
    assert e.value.status == 415
    small = Library(spark, library.folder, extract, type(library.config)(max_upload_mb=0))
    with pytest.raises(ApiError) as e:
        small.upload(f"{files}/a.pdf")
    assert e.value.status == 413


def test_search_and_its_facts(library):
    hits, meta = library.search("where do whales live")
    rows = hits.collect()
    assert "Whales" in rows[0]["text"] and rows[0]["score_hybrid"] > 0 and meta["hit_count"] == len(rows) and meta["chunk_count"] == 3
    assert set(meta["timing_ms"]) == {"load_index", "hybrid_search", "facts", "search_total"}
    one, meta = library.search("live", "lexical", 5, by_name(library)["b.pdf"]["id"])
    assert one.count() == 0 and meta["chunk_count"] == 1
    assert library.search("  ")[1]["hit_count"] == 0 and library.search("fox", "vector")[0].count() > 0


def test_the_stored_index_equals_a_derived_one(spark, library):
    stored, made = streaming.library(spark, library.folder), corpus.derived(streaming.held(spark, library.folder, "chunks"))
    for name in ("postings", "frequencies", "stats"):
        a, b = getattr(stored, name), getattr(made, name)
        assert sorted(map(tuple, a.select(*sorted(b.columns)).collect())) == sorted(map(tuple, b.select(*sorted(b.columns)).collect()))
    assert corpus.current(stored).filter("not valid").count() == 0


def test_routing_keeps_to_the_best_sections(spark, library):
    c, a = streaming.library(spark, library.folder), by_name(library)["a.pdf"]["id"]
    q = spark.createDataFrame([(0, "whales live", a), (1, "whales live", None)], "query_id int, query string, document_id string")
    config = type(library.config)(top_sections=1)
    hits = search.candidates(q, c, "vector", config).collect()
    assert {r["section_title"] for r in hits if r["query_id"] == 0} == {"Whales"} and {r["section_title"] for r in hits if r["query_id"] == 1} >= {"Whales", "Foxes"}
    assert search.facts(q, c, search.candidates(q, c, "vector", config), "vector", config).filter("query_id = 0").first()["routed_sections"][0]["title"] == "Whales"


def test_answers(library):
    r = library.answer("where do whales live")
    assert r["answer"].startswith(answering.STUB) and r["cites"] == [1] and r["evidence"][0]["chunk_id"] == r["citations"][0] and not r["reflection"]["enabled"]
    assert 0 < r["confidence"] <= 1 and r["retrieval_meta"]["packed_passages"] == len(r["evidence"])
    assert library.answer("")["insufficient"]


def test_answers_of_a_model_are_reflected_on(library):
    def generate(system: str, prompt: str) -> str:
        assert system == answering.SYSTEM
        if answering.VERIFY in prompt:
            return "Claim 1: YES\nClaim 2: no"
        assert prompt.startswith("QUESTION: where do whales live\n\nEVIDENCE:\n[E1] (chunk=")
        return "Whales live in the sea [E1]. They fly at night 【E1†x】. That is all."

    r = library.answer("where do whales live", generate=generate)
    assert r["raw_answer"] == "Whales live in the sea [E1]. They fly at night [E1]. That is all."
    assert r["answer"] == "Whales live in the sea [E1]. That is all."
    assert (r["reflection"]["sentences_total"], r["reflection"]["sentences_dropped"], r["reflection"]["enabled"], r["reflection"]["requery"]) == (3, 1, True, False)
    refused = library.answer("where do whales live", generate=lambda system, prompt: answering.MARKER)
    assert refused["insufficient"] and refused["answer"] == answering.REFUSAL and refused["confidence"] == 0


def test_a_repeated_batch_changes_nothing(spark, files, tmp_path):
    folder, raw = str(tmp_path / "lib"), sources.uploads(spark, f"{files}/*.pdf")
    count = lambda: {t: streaming.held(spark, folder, t).count() for t in streaming.TABLES}
    streaming.ingest(streaming.uploads(raw), streaming.extracted(raw, extract), folder, 0)
    once = count()
    streaming.ingest(streaming.uploads(raw), streaming.extracted(raw, extract), folder, 0)
    assert count() == once and once["chunks"] == 3
    # The same files in a later batch take the place of the former.
    streaming.ingest(streaming.uploads(raw), streaming.extracted(raw, extract), folder, 1)
    assert count() == once and streaming.records(spark, folder).count() == 3


def test_a_stream_ingests_new_files_once(spark, files, tmp_path):
    (tmp_path / "in").mkdir()
    folder, run = str(tmp_path / "lib"), lambda: streaming.watch(spark, f"{tmp_path}/in/*.pdf", str(tmp_path / "lib"), extract, str(tmp_path / "state")).awaitTermination()
    for name in ("a.pdf", "c.pdf"):
        (tmp_path / "in" / name).write_text((files / name).read_text())
        run()
    run()
    r = {x["filename"]: (x["status"], x["batch"]) for x in streaming.records(spark, folder).collect()}
    assert r == {"a.pdf": ("ready", 0), "c.pdf": ("failed", 1)} and streaming.held(spark, folder, "chunks").count() == 2


def test_retry_and_delete(spark, files, tmp_path):
    (tmp_path / "d.pdf").write_text("broken")
    lib = Library(spark, str(tmp_path / "lib"), extract)
    id = lib.upload(f"{tmp_path}/d.pdf").first()["id"]
    assert lib.status(id)["status"] == "failed"
    (tmp_path / "d.pdf").write_text("Now there is a text about bread.")
    assert lib.retry(id).first()["status"] == "ready" and lib.chunks(id).count() == 1
    lib.delete(id)
    assert lib.documents().count() == 0 and streaming.held(spark, lib.folder, "chunks").count() == 0
    with pytest.raises(ApiError):
        lib.status(id)


def test_files_are_written_whole_and_by_part(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.write(spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string"), path, "k")
    sources.write(spark.createDataFrame([(3, "a")], "x int, k string"), path, "k", "replace")
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [2, 3]
    sources.write(spark.range(1).select(F.lit(9).alias("x"), F.lit("c").alias("k")), path, "k")
    assert [r["x"] for r in spark.read.parquet(path).collect()] == [9]


def test_vectors_from_a_service(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(1)
        assert len(texts) <= 2
        return [[3.0, 4.0] if t else [0.0, 0.0] for t in texts]

    df = spark.createDataFrame([(i, "x" if i else "") for i in range(5)], "id long, text string").coalesce(1)
    got = {r["id"]: r["embedding"] for r in embedding.remote(df, "id", "text", embed, 2).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[0] == [0.0, 0.0] and calls.value == 3
    with pytest.raises(Exception, match="another number of vectors"):
        embedding.remote(df, "id", "text", lambda texts: [], 2).collect()
