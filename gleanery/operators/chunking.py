"""Section-aware overlapping chunks of paged documents.

pages(document_id, page_number, text) -> lines -> sections -> paragraphs and sentences -> packed
chunks. Offsets are window sums over lines and pieces of one document; the only fold packs the
units of one section. Everything is keyed by document_id, so that one hash partitioning serves all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import counting
from gleanery.functions import text as T
from gleanery.functions.plan import pinned

TARGET, OVERLAP, KEYWORDS, SECTION_KEYWORDS, SECTION_SUMMARY = 1200, 200, 8, 10, 600
#: Lists of sections that are folded at once: a task's memory is theirs, not that of all texts it was sent.
LISTS = 8
_before = (Window.unboundedPreceding, -1)


def page_offsets(pages: DataFrame) -> DataFrame:
    """document_id, page_number, page_index (from 1), char_offset in the pages joined by a blank line."""
    w = Window.partitionBy("document_id").orderBy("page_number")
    return pages.select("document_id", "page_number", F.row_number().over(w).alias("page_index"), F.coalesce(F.sum(F.length("text") + 2).over(w.rowsBetween(*_before)), F.lit(0)).alias("char_offset"))


def lines(pages: DataFrame) -> DataFrame:
    """document_id, line_no, line, char_start and heading rule (null: no heading) of the joined pages."""
    joined = pages.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n\n").alias("full"))
    d = joined.filter(T.trim(F.col("full")) != "").select("document_id", F.posexplode(F.split("full", "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy("document_id").orderBy("line_no")
    d = d.withColumns({"char_start": F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(*_before)), F.lit(0)), "t": T.trim(F.col("line"))})
    return d.withColumn("rule", heading_rule(F.col("t"), F.lag("t").over(w), F.lead("t").over(w)))


def heading_rule(t: Column, before: Column, after: Column) -> Column:
    """Why a trimmed line is a heading, or null."""
    blank = lambda c: c.isNull() | (c == "")
    return (
        F.when(t == "", None)
        .when(t.rlike(r"^#+\s+\S.*\z"), "markdown")
        .when(t.rlike(r"^[0-9]+(?:\.[0-9]+)*\s+[A-Z].*\z") & (F.length(t) <= 120), "numbered")
        .when(t.rlike(r"^[A-Z0-9][A-Z0-9 \-:,&/()']{1,79}\z") & t.rlike("[A-Z]"), "caps")
        .when(blank(before) & blank(after) & (F.length(t) < 90) & t.rlike("^[A-Z]") & ~t.rlike(r"[.!?,]\z"), "isolated")
    )


def sections(pages: DataFrame) -> DataFrame:
    """document_id, section_idx, title, char_start, char_end, body."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    d = lines(pages).withColumn("section_idx", F.sum(F.when(F.col("rule").isNotNull() | (F.col("line_no") == 0), 1).otherwise(0)).over(w))
    d = d.withColumn("last", F.lead("line_no").over(w).isNull())
    title = F.when(F.col("rule").isNotNull(), T.trim(F.regexp_replace("line", "^#+", "")))
    g = d.groupBy("document_id", "section_idx").agg(
        F.min_by(title, "line_no").alias("title"),
        F.min("char_start").alias("char_start"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"),
        F.max("last").alias("last"),
    )
    g = g.withColumn("body", F.when(F.col("last"), F.col("body")).otherwise(F.concat("body", F.lit("\n"))))
    return g.withColumn("char_end", F.col("char_start") + F.length("body")).filter("char_end > char_start").select("document_id", "section_idx", "title", "char_start", "char_end", "body")


def _pieces(df: DataFrame, text: str, pattern: str, keys: list[str], out: str) -> DataFrame:
    """One row for each piece between matches: `out` its text, `out`_start its offset in the text."""
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("gap"))
    d = df.select("*", F.posexplode(cut).alias("_i", "_x"))
    size = F.length("_x.piece") + F.coalesce(F.length("_x.gap"), F.lit(0))
    w = Window.partitionBy(*keys).orderBy("_i").rowsBetween(*_before)
    return d.withColumns({f"{out}_start": F.coalesce(F.sum(size).over(w), F.lit(0)), out: F.col("_x.piece"), f"{out}_no": F.col("_i")}).drop("_i", "_x")


def paragraphs(secs: DataFrame) -> DataFrame:
    """Sections with one row for each non-blank paragraph: para, para_start (in the section), para_no."""
    d = _pieces(secs, "body", r"\n\s*\n", ["document_id", "section_idx"], "para").drop("body")
    return d.filter(T.trim(F.col("para")) != "")


def units(secs: DataFrame) -> DataFrame:
    """What is packed: short paragraphs, and the sentences of long ones. unit_start and unit_end are in the section."""
    p = paragraphs(secs).withColumn("cut", F.when(F.length("para") > TARGET, F.col("para")))
    short = p.filter(F.col("cut").isNull()).select("document_id", "section_idx", F.col("para_start").alias("unit_start"), (F.col("para_start") + F.length("para")).alias("unit_end"))
    long = _pieces(p.filter(F.col("cut").isNotNull()), "cut", T.CHUNK_BREAK, ["document_id", "section_idx", "para_no"], "sent").filter("sent <> ''")
    start = F.col("para_start") + F.col("sent_start")
    return short.unionByName(long.select("document_id", "section_idx", start.alias("unit_start"), (start + F.length("sent")).alias("unit_end")))


_GAP, _BREAK = re.compile(r"\n\s*\n", re.ASCII), re.compile(r"[.!?]\s+(?=[A-Z])", re.ASCII)


def _sizes(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each unit: a paragraph that isn't blank, or if it's long, each of its sentences."""
    at = 0
    for stop, after in [*(m.span() for m in _GAP.finditer(text)), (len(text), len(text))]:
        if stop - at <= TARGET:
            if text[at:stop].strip(T.WS_CHARS):
                yield at, stop
        elif text[at:stop].strip(T.WS_CHARS):
            s = at
            for m in _BREAK.finditer(text, at, stop):
                if m.start() + 1 > s:
                    yield s, m.start() + 1
                s = m.end()
            if stop > s:
                yield s, stop
        at = after


def fold(body: str) -> list[tuple[int, int]]:
    """Start and end of the spans of a section: its units packed greedily up to TARGET, never split."""
    out, start, end = [], None, 0
    for s, e in _sizes(body):
        if start is not None and e - start > TARGET:
            out.append((start, end))
            start = None
        start, end = s if start is None else start, e
    return out if start is None else [*out, (start, end)]


def _repeated(core: str) -> int:
    """How many of a core's last characters are repeated before the next chunk."""
    n = min(len(core), OVERLAP)
    cut = _BREAK.search(core, len(core) - n) if len(core) > OVERLAP else None
    return len(core) - cut.end() if cut else n


def _spans(sections: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of lists of sections' bodies, the spans in order: place of the section in its list, start, end, how much of the span before is repeated, text with it. LISTS at a time."""
    for batch in (x.slice(at, LISTS) for x in sections for at in range(0, max(1, len(x)), LISTS)):
        offsets, places, starts, ends, repeats, texts = [0], [], [], [], [], []
        for x in batch:
            for i, body in enumerate(x.as_py() or []):
                repeated = 0
                for s, e in fold(body):
                    core = body[s:e]
                    places.append(i)
                    starts.append(s)
                    ends.append(e)
                    repeats.append(repeated)
                    texts.append(last + core if repeated else core)
                    repeated = _repeated(core)
                    last = core[len(core) - repeated :]
            offsets.append(len(starts))
        rows = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(repeats, pa.int32()), pa.array(texts, pa.string())], ["i", "s", "e", "overlap", "text"])
        yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def _folded(bodies: Column) -> Column:
    return F.arrow_udf(_spans, "array<struct<i:int,s:bigint,e:bigint,overlap:int,text:string>>")(bodies)


def spans(secs: DataFrame) -> DataFrame:
    """secs with spans: start and end in the section, how much of the span before is repeated, and the text with it. Folded within a row, in time that grows with the text."""
    return secs.withColumn("spans", _folded(F.array("body")))


def chunk_id() -> Column:
    return F.concat_ws("#", "document_id", "ordinal")


def core_of(text: str, overlap: str) -> Column:
    """A chunk's text without what it repeats of the chunk before."""
    return F.expr(f"substring({text}, {overlap} + 1)")


def chunks(pages: DataFrame) -> DataFrame:
    """chunk_id, document_id, ordinal, text, core, page_start, page_end, char_start, char_end, section_idx, section_title, overlap_prefix_len."""
    d = sections(pages).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("section_idx", "title", "char_start", "body"))).alias("secs"))
    offsets = page_offsets(pages).groupBy("document_id").agg(F.sort_array(F.collect_list("char_offset")).alias("offsets"))
    # All that goes by document comes before the fold, behind which Spark would shuffle the texts again.
    d = pinned(d.join(offsets, "document_id"), heads=F.transform("secs", lambda x: x.dropFields("body")), bodies=F.transform("secs", lambda x: x["body"]))
    d = d.select("document_id", "heads", "offsets", _folded(F.col("bodies")).alias("spans")).select("document_id", "heads", "offsets", F.posexplode("spans").alias("ordinal", "x"))
    head = F.get("heads", F.col("x.i"))
    d = d.select("document_id", head["section_idx"].alias("section_idx"), head["title"].alias("section_title"), "ordinal", (head["char_start"] + F.col("x.s")).alias("char_start"), (head["char_start"] + F.col("x.e")).alias("char_end"), "offsets", "x.text", F.col("x.overlap").alias("overlap_prefix_len"))
    page = lambda at: F.greatest(F.lit(1), F.size(F.filter("offsets", lambda o: o <= at)))
    return d.select(
        chunk_id().alias("chunk_id"), "document_id", "ordinal", "text", core_of("text", "overlap_prefix_len").alias("core"),
        page(F.col("char_start")).alias("page_start"), page(F.greatest(F.col("char_end") - 1, F.col("char_start"))).alias("page_end"),
        "char_start", "char_end", "section_idx", "section_title", "overlap_prefix_len",
    )


def summaries(ch: DataFrame) -> DataFrame:
    return ch.select("chunk_id", "document_id", "ordinal", T.summary(F.col("core")).alias("summary"))


def keywords(ch: DataFrame) -> DataFrame:
    """chunk_id, keywords: the most frequent, ties by code point. Chunks without a keyword have no row."""
    return ch.select("chunk_id", counting.keywords(F.col("core"), KEYWORDS).alias("keywords")).filter(F.size("keywords") > 0)


def described(ch: DataFrame) -> DataFrame:
    """ch with summary and keywords (empty: none), made within the row."""
    return ch.withColumns({"summary": T.summary(F.col("core")), "keywords": counting.keywords(F.col("core"), KEYWORDS)})


def document_map(ch: DataFrame) -> DataFrame:
    """Neighbouring chunks of one title: document_id, section_no, title, chunk and page ranges, chunk_count."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    new = F.when(F.lag("ordinal").over(w).isNull() | ~F.col("section_title").eqNullSafe(F.lag("section_title").over(w)), 1).otherwise(0)
    d = ch.withColumn("new", new).withColumn("section_no", F.sum("new").over(w))
    return d.groupBy("document_id", "section_no").agg(
        F.min_by("section_title", "ordinal").alias("title"), F.min("ordinal").alias("chunk_ordinal_start"), F.max("ordinal").alias("chunk_ordinal_end"),
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count("*").alias("chunk_count"),
    )


def enriched(ch: DataFrame) -> DataFrame:
    """The document map with a summary and keywords of each section, by a range join on ordinals within documents."""
    m = document_map(ch)
    facts = summaries(ch).join(keywords(ch), "chunk_id", "left").select(F.col("document_id").alias("d"), "ordinal", "summary", "keywords")
    j = m.join(facts, (F.col("document_id") == F.col("d")) & F.col("ordinal").between(F.col("chunk_ordinal_start"), F.col("chunk_ordinal_end")))
    g = j.groupBy(*m.columns).agg(F.array_sort(F.collect_list(F.struct("ordinal", "summary", "keywords"))).alias("x"))
    text = F.array_join(F.filter(F.transform("x", lambda x: x["summary"]), lambda s: s != ""), " ")
    words = F.array_distinct(F.flatten(F.filter(F.transform("x", lambda x: x["keywords"]), lambda k: k.isNotNull())))
    return g.select(*m.columns, T.summary(text, SECTION_SUMMARY).alias("summary"), F.slice(words, 1, SECTION_KEYWORDS).alias("keywords"))
