"""Text functions as Column expressions: tokenisers, normalisers, splitters and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanery.functions.plan import pinned

# Stopwords of the lexical, rerank and keyword tokenisers.
STOPWORDS = (
    "the and for that with this are was but not you your all any can had has have from they their them there these those then than which who "
    "what when where why how will would could should may might must been being were into onto out off over under again further about above below "
    "because before after between during through while same some such each every few more most other own only very also just thus upon"
).split()
# Further stopwords of the packing tokeniser.
MORE_STOPWORDS = "does did a an as at be by if in is it of on or to we i".split()
# Question prefixes in order of precedence.
QUESTION_PREFIXES = "what is|what are|where is|where are|when is|when are|who is|who are|why is|why are|how does|how do|how is|how are|tell me about|show me|find"
# Symbols and the words that stand for them.
SYMBOL_WORDS = {"&": " and ", "@": " at ", "%": " percent ", "+": " plus ", "#": " number ", "$": " dollar ", "=": " equals "}

#: White space as browsers define it; Java's \s lacks most of it.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A run of it. Latin characters are told by one look, and the rest looked up only beyond them.
WS_RUN = r"(?:[\t\n\x0B\f\r \u00A0]|(?![\x00-\u167F])[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF])++"
LEXICAL, RERANK, PACKING, KEYWORD = r"[0-9A-Za-z_]+", r"[\p{L}\p{N}][\p{L}\p{N}_'-]*", r"[\p{L}\p{N}][\p{L}\p{N}'-]*", r"[A-Za-z][A-Za-z0-9'-]*"
#: Sentence breaks of chunks, summaries, packed evidence and answers.
CHUNK_BREAK, SUMMARY_BREAK, ANSWER_BREAK = r"(?<=[.!?])\s+(?=[A-Z])", r"(?<=[.!?])\s+(?=[A-Z0-9])", r"(?<=[.!?]) "
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def trim(c: Column) -> Column:
    """Without white space at either end. A pattern would look at every character."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, WS_RUN, " ")


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def without(tokens: Column, least: int, words: list[str]) -> Column:
    return F.filter(tokens, lambda x: (F.length(x) >= least) & ~x.isin(*words))


def counted(df: DataFrame, values: Column, out: str) -> DataFrame:
    """df with `out`, array<struct<x,n>>: an array's distinct values in order, and how often each occurs. All within a row, without a shuffle."""
    d = pinned(df, _s=F.sort_array(values))
    new = lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))
    d = pinned(d, _at=F.when(F.size("_s") > 0, F.filter(F.sequence(F.lit(0), F.size("_s") - 1), new)).otherwise(F.expr("cast(array() as array<int>)")))
    run = lambda i, k: F.struct(F.get("_s", i).alias("x"), (F.coalesce(F.get("_at", k + 1), F.size("_s")) - i).cast("long").alias("n"))
    return pinned(d, **{out: F.transform("_at", run)}).drop("_s", "_at")


def lexical_tokens(c: Column) -> Column:
    return without(matches(F.lower(c), LEXICAL), 2, STOPWORDS)


def rerank_tokens(c: Column) -> Column:
    """Expects NFKC text; see nfkc."""
    return without(matches(normalize_text(c), RERANK), 2, STOPWORDS)


def expansion_tokens(c: Column) -> Column:
    return matches(F.lower(c), RERANK)


def packing_tokens(c: Column) -> Column:
    return without(matches(F.lower(c), PACKING), 2, STOPWORDS + MORE_STOPWORDS)


def keyword_tokens(c: Column) -> Column:
    return without(F.transform(matches(c, KEYWORD), F.lower), 3, STOPWORDS)


def embedding_tokens(c: Column) -> Column:
    return matches(F.lower(c), LEXICAL)


def normalize_text(c: Column) -> Column:
    return trim(collapse(F.lower(c)))


@F.pandas_udf(StringType())
def _nfkc(texts):
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility composition. Python sees the text only where it isn't ASCII."""
    return F.when(c.rlike(r"\A[\x00-\x7F]*\z"), c).otherwise(_nfkc(F.when(~c.rlike(r"\A[\x00-\x7F]*\z"), c)))


def normalize_query(c: Column) -> Column:
    quotes = F.translate(F.lower(c), "\u201c\u201d\u2018\u2019", "\"\"''")
    return trim(collapse(F.regexp_replace(quotes, r"[?!.:,;]+\z", "")))


def strip_question_prefix(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"^(?:{QUESTION_PREFIXES}) ", ""))


def normalize_page(c: Column) -> Column:
    steps = [("\r\n", "\n"), ("\r", "\n"), ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n"), ("\n+\\z", "")]
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def truncate_word(c: Column, most: int) -> Column:
    cut = F.left(c, F.lit(most))
    space = F.when(cut.contains(" "), F.length(cut) - F.locate(" ", F.reverse(cut))).otherwise(-1)
    return F.when(F.length(c) <= most, c).otherwise(trim(F.when(space > most * 0.5, F.left(cut, space)).otherwise(cut)))


def truncate_boundary(c: Column, most: int | Column) -> Column:
    most = F.lit(most) if isinstance(most, int) else most
    cut = F.left(c, most)
    last = lambda mark: F.when(cut.contains(mark), F.length(cut) - F.locate(mark[::-1], F.reverse(cut)) - (len(mark) - 1)).otherwise(-1)
    stop, space = F.greatest(last(". "), last("? "), last("! ")), last(" ")
    kept = F.when(stop > most * 0.45, F.left(cut, stop + 1)).when(space > most * 0.5, F.left(cut, space)).otherwise(cut)
    return F.when(F.length(c) <= most, c).otherwise(F.regexp_replace(kept, f"{WS}+\\z", ""))


def summary(c: Column, most: int = 200) -> Column:
    parts = F.transform(F.slice(F.split(trim(c), SUMMARY_BREAK), 1, 2), trim)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    both = F.concat_ws(" ", first, second)
    return trim(F.left(F.when(second.isNotNull() & (F.length(both) <= most), both).otherwise(first), F.lit(most)))


def packing_sentences(c: Column) -> Column:
    parts = F.filter(F.transform(matches(c, r"[^.!?\n]+(?:[.!?]+|\z)|[^\n]+"), lambda x: trim(collapse(x))), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.filter(F.array(trim(collapse(c))), lambda x: x != ""))


def answer_sentences(c: Column) -> Column:
    parts = F.split(c, ANSWER_BREAK)
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def overlap_ratio(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def page_proximity(same: Column, a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.when(same, clamp01(1 - F.least(F.abs(a0 - b1), F.abs(b0 - a1)) / 3.0)).otherwise(0.0)


def exact_phrase(query: Column, text: Column) -> Column:
    phrase = F.regexp_replace(F.regexp_replace(query, '^"', ""), '"\\z', "")
    return F.when((F.length(phrase) >= 4) & F.contains(text, phrase), 1.0).otherwise(0.0)


def sentence_score(sentence: Column, terms: Column, phrase: Column) -> Column:
    hit = F.array_intersect(F.array_distinct(packing_tokens(sentence)), terms)
    words = F.aggregate(hit, F.lit(0.0), lambda a, x: a + F.when(F.length(x) >= 6, 1.4).otherwise(1.0))
    return words + F.when((phrase != "") & F.contains(normalize_text(sentence), phrase), 4.0).otherwise(0.0)


def normalize_citations(c: Column) -> Column:
    zero = r"[\u200B-\u200F\u2060\uFEFF]*"
    c = F.regexp_replace(c, r"【\s*E\s*0*([0-9]+)\s*(?:†[^】]*)?】", "[E$1]")
    return F.regexp_replace(c, rf"\[\s*{zero}E{zero}0*([0-9]+){zero}\s*\]", "[E$1]")


def citation_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[E([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))


def confidence(top: Column, citations: Column, passages: Column) -> Column:
    value = clamp01(top / (1.0 / 61)) * (0.35 + 0.65 * clamp01(citations / 2.0)) * (0.75 + 0.25 * clamp01(passages / 3.0))
    return F.when(passages > 0, value).otherwise(0.0)


def answer_score(conf: Column, citations: Column) -> Column:
    return clamp01(conf * (0.55 + 0.45 * clamp01(citations / 2.0)))


def compact(c: Column, most: int = 96) -> Column:
    t = trim(collapse(c))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 1)), F.lit("...")))


def percentile_floor(values: Column, p: float) -> Column:
    """Element at floor((n - 1) p) of the sorted values; 0 if there are none."""
    xs = F.sort_array(values)
    return F.coalesce(F.get(xs, F.floor((F.size(xs) - 1) * F.lit(p)).cast("int")), F.lit(0.0))


def lcg(seed: int, n: int) -> Column:
    """The first n states of the generator s -> (1664525 s + 1013904223) mod 2^32."""
    step = lambda s: (s * 1664525 + 1013904223) % 4294967296
    grow = lambda a, _: F.concat(a, F.array(step(F.element_at(a, -1))))
    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(F.lit(seed).cast("long")), grow), 2, n)


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def format_bytes(n: Column) -> Column:
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        x = n / float(1024**power)
        shown = F.when(x >= 10, F.format_string("%.0f", x)).otherwise(F.format_string("%.1f", x))
        out = F.when(n >= 1024**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 0, "0 B").otherwise(out)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.4, "medium").otherwise("low")


def score_fill(c: Column) -> Column:
    return F.greatest(F.lit(4.0), F.least(F.lit(100.0), F.when(c <= 1, c).otherwise(c / (c + 1)) * 100))


def progress_pct(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(current / total * 100 + 0.5).cast("int"))).otherwise(0)


def estimate_chunks(size_bytes: Column, pages: Column) -> Column:
    by_size = F.greatest(F.lit(1), F.floor(size_bytes / 2200 + 0.5).cast("int"))
    return F.greatest(by_size, F.coalesce(pages * 3, F.lit(0)))


# Commands of formulas and what a preview shows for them, in the order in which they are replaced.
FORMULA_COMMANDS = (
    (r"\\text\{([^{}]+)\}", "$1"), (r"\\mathrm\{([^{}]+)\}", "$1"), (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "$1⁄$2"), (r"\\sqrt\{([^{}]+)\}", "√($1)"), (r"\\left", ""), (r"\\right", ""),
    (r"\\cdot", "·"), (r"\\times", "×"), (r"\\leq", "≤"), (r"\\geq", "≥"), (r"\\neq", "≠"), (r"\\approx", "≈"), (r"\\sum", "Σ"), (r"\\prod", "Π"), (r"\\int", "∫"), (r"\\infty", "∞"),
    (r"\\alpha", "α"), (r"\\beta", "β"), (r"\\gamma", "γ"), (r"\\delta", "δ"), (r"\\theta", "θ"), (r"\\lambda", "λ"), (r"\\mu", "μ"), (r"\\pi", "π"), (r"\\sigma", "σ"), (r"\\omega", "ω"),
)
# What is tidied up after them.
FORMULA_REST = ((r"\^\{([^{}]+)\}", "^$1"), (r"_\{([^{}]+)\}", "_$1"), (r"[{}]", ""), (r"\\", ""), (r"\s*=\s*", " = "), (r"\s*\+\s*", " + "))


def formula_preview(c: Column) -> Column:
    """A formula's source as one readable line."""
    c = trim(c)
    for pattern, by in (*FORMULA_COMMANDS, *FORMULA_REST):
        c = F.regexp_replace(c, pattern, by)
    return trim(collapse(c))
