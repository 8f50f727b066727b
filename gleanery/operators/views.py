"""What result pages show: facts of a result list, merged sections, page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T


def result_facts(hits: DataFrame) -> DataFrame:
    """query_id, pages, chunks, scores, sections of a query's hits, as shown."""
    title = T.trim(F.col("section_title"))
    g = hits.groupBy("query_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence("page_start", "page_end"))))).alias("p"),
        F.min("ordinal").alias("o0"), F.max("ordinal").alias("o1"), F.min("rrf_score").alias("s0"), F.max("rrf_score").alias("s1"),
        F.array_sort(F.collect_set(F.when(title != "", title))).alias("t"),
    )
    text = F.transform("p", lambda x: x.cast("string"))
    pages = F.when(F.size("p") <= 6, F.array_join(text, ", ")).otherwise(F.concat(F.array_join(F.slice(text, 1, 3), ", "), F.lit(" ... "), F.array_join(F.slice(text, -2, 2), ", ")))
    names = F.when(F.size("t") == 0, "untitled").when(F.size("t") > 3, F.concat(F.size("t"), F.lit(" sections"))).otherwise(F.array_join("t", ", "))
    return g.select("query_id", pages.alias("pages"), F.concat_ws("-", "o0", "o1").alias("chunks"), F.format_string("%.3f-%.3f", "s0", "s1").alias("scores"), names.alias("sections"))


def title_key(title: Column) -> Column:
    return F.regexp_replace(T.normalize_text(F.coalesce(title, F.lit(""))), r"[\s.·•:;,–—-]+\z", "")


def collapsed(sections: DataFrame) -> DataFrame:
    """Sections of equal title merged in a document; untitled ones stay apart."""
    key = title_key(F.col("title"))
    d = sections.withColumns({"key": F.when(key != "", key).otherwise(F.concat(F.lit("__untitled_"), F.col("section_no") - 1)), "label": F.when(T.trim(F.coalesce("title", F.lit(""))) != "", T.trim(F.col("title"))).otherwise(F.concat(F.lit("Section "), F.col("section_no")))})
    return d.groupBy("document_id", "key").agg(F.min_by("label", "section_no").alias("label"), F.min("chunk_ordinal_start").alias("chunk_ordinal_start"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.sum("chunk_count").alias("chunk_count"))


def pagination(totals: DataFrame, size: int = 5) -> DataFrame:
    """totals(id, total, page) with total_pages, current, first and last item, and the page numbers shown."""
    d = totals.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int"))
    d = d.withColumn("current", F.least(F.greatest(F.lit(1), F.col("page")), F.col("total_pages")).cast("int"))
    shown = F.filter(F.sequence(F.lit(1), F.col("total_pages")), lambda p: (p == 1) | (p == F.col("total_pages")) | (F.abs(p - F.col("current")) <= 1))
    return d.select("id", "total_pages", "current", ((F.col("current") - 1) * size + 1).alias("first"), F.least(F.col("total"), F.col("current") * size).alias("last"), F.array_join(F.transform(shown, lambda x: x.cast("string")), ",").alias("pages"))
