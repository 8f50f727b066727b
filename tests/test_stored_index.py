from gleanery.operators import corpus
from gleanery.plans import answers, inputs


def test_what_follows_from_the_rest_is_not_stored(spark, sf, tmp_path):
    made = corpus.write(inputs.pages(spark, sf), str(tmp_path))
    assert "core" not in spark.read.parquet(f"{tmp_path}/chunks").columns
    assert "chunk_id" not in spark.read.parquet(f"{tmp_path}/postings").columns
    assert any(f.name.endswith(".zstd.parquet") for f in (tmp_path / "postings").iterdir())
    whole = inputs.chunks(spark, sf)
    assert made.chunks.columns == whole.columns and made.chunks.exceptAll(whole).isEmpty() and whole.exceptAll(made.chunks).isEmpty()
    every = corpus.derived(whole).postings
    got = made.postings.select(every.columns)
    assert got.exceptAll(every).isEmpty() and every.exceptAll(got).isEmpty()


def test_gold_is_made_once(spark, sf, monkeypatch):
    made = []
    gold = answers._gold
    monkeypatch.setattr(answers, "_gold", lambda *a: made.append(1) or gold(*a))
    assert answers.QUERIES["eval_retrieval"][0](spark, sf).count() == 3
    assert len(made) == 1


def test_postings_come_in_order_of_their_part_without_a_sort(spark, sf):
    postings = corpus.derived(inputs.chunks(spark, sf).coalesce(1)).postings
    parts = [r["part"] for r in postings.select("part").limit(5000).collect()]
    assert parts == sorted(parts) and len(parts) == 5000
    assert "sortWithinPartitions" not in corpus._MADE["postings"].__code__.co_names
