"""Query expansion: weighted variants of a query, as arrays of structs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.plan import pinned


def _replaced(q: Column, token: Column, by: Column) -> Column:
    return F.replace(q, token, by)


def _spellings(normal: Column, token: Column) -> Column:
    n = F.length(token)
    ends = lambda x: F.endswith(token, F.lit(x))
    options = [
        (F.contains(token, F.lit("-")), F.replace(token, F.lit("-"), F.lit(" "))),
        (F.contains(token, F.lit("_")), F.replace(token, F.lit("_"), F.lit(" "))),
        (ends("ies") & (n > 4), F.concat(F.left(token, n - 3), F.lit("y"))),
        (ends("s") & (n > 3), F.left(token, n - 1)),
        (~ends("s") & (n > 3), F.concat(token, F.lit("s"))),
    ]
    return F.array(*[F.when(test, _replaced(normal, token, by)) for test, by in options])


def _hyphened(normal: Column) -> Column:
    joined = F.regexp_replace(normal, rf"{T.EDGE}([\p{{L}}\p{{N}}]+)\s+([\p{{L}}\p{{N}}]+){T.EDGE}", "$1-$2")
    return F.array(F.when(joined != normal, joined))


def lexical_variants(normal: Column) -> Column:
    """Spelling variants by token, in order, then neighbouring words joined by hyphens."""
    per_token = F.flatten(F.transform(T.expansion_tokens(normal), lambda t: _spellings(normal, t)))
    return F.array_distinct(F.filter(F.concat(per_token, _hyphened(normal)), lambda x: x.isNotNull()))


def first_variants(normal: Column, tokens: Column, most: int) -> Column:
    """Of lexical_variants, the first `most` that differ when normalized. Later ones are not made: a text of n words has n variants of its length. tokens: the distinct ones."""
    empty = F.expr("cast(array() as array<string>)")

    def add(a: Column, v: Column) -> Column:
        old = (v["name"] == "") | F.array_contains(a["names"], v["name"])
        return F.when(old, a).otherwise(F.struct(F.concat(a["raw"], F.array(v["raw"])).alias("raw"), F.concat(a["names"], F.array(v["name"])).alias("names")))

    def grown(a: Column, options: Column) -> Column:
        named = F.transform(F.filter(options, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("raw"), T.normalize_query(x).alias("name")))
        return F.when(F.size(a["names"]) >= most, a).otherwise(F.aggregate(named, a, add))

    # A null token stands for the last step, the hyphens.
    steps = F.concat(tokens, F.array(F.lit(None).cast("string")))
    options = lambda t: F.when(t.isNull(), _hyphened(normal)).otherwise(_spellings(normal, t))
    return F.aggregate(steps, F.struct(empty.alias("raw"), empty.alias("names")), lambda a, t: grown(a, options(t)), lambda a: a["raw"])


def symbol_variants(query: Column, normal: Column) -> Column:
    """Symbols as words; slashes as spaces; symbols dropped: what differs from the query and isn't empty."""
    spelled = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), T.SYMBOL_WORDS.items(), query)
    spaced = F.regexp_replace(query, r"[\\/]", " ")
    bare = F.regexp_replace(query, r"[^\p{L}\p{N}\s]", "")
    return F.array_distinct(F.filter(F.transform(F.array(spelled, spaced, bare), T.normalize_query), lambda x: (x != "") & (x != normal)))


def acronym(normal: Column) -> Column:
    """Initials of two to eight tokens of three or more characters, or null."""
    tokens = F.filter(T.expansion_tokens(normal), lambda x: F.length(x) > 2)
    return F.when(F.size(tokens).between(2, 8), F.array_join(F.transform(tokens, lambda x: F.left(x, F.lit(1))), ""))


def expand(queries: DataFrame, most: int = 12, quoted: bool = True, hyde: str | None = None, hyde_chars: int = 800) -> DataFrame:
    """queries with `normalized` and `variants`, array<struct<query,kind,weight>>; equal queries keep their first variant."""
    d = pinned(queries, normalized=T.normalize_query(F.col("query")))
    most = max(1, most)
    d = pinned(d, _tokens=F.array_distinct(T.expansion_tokens(F.col("normalized"))), _words=F.size(T.expansion_tokens(F.col("normalized"))))
    d = pinned(d, _lexical=first_variants(F.col("normalized"), F.col("_tokens"), most), _symbols=symbol_variants(F.col("query"), F.col("normalized")), _stripped=T.strip_question_prefix(F.col("normalized")), _initials=acronym(F.col("normalized")))
    n = F.col("normalized")
    one = lambda q, kind, w: F.struct(q.alias("query"), F.lit(kind).alias("kind"), F.lit(float(w)).alias("weight"))
    none = F.expr("cast(array() as array<struct<query:string,kind:string,weight:double>>)")
    some = lambda test, q, kind, w: F.when(test, F.array(one(q, kind, w))).otherwise(none)
    stripped, initials = F.col("_stripped"), F.col("_initials")
    many = lambda xs, kind, w: F.transform(xs, lambda x: one(x, kind, w))
    own = F.concat(
        some(n != "", n, "normalized", 1),
        some(stripped != n, stripped, "phrase", 0.9),
        some(F.lit(quoted) & (F.col("_words") > 1), F.concat(F.lit('"'), n, F.lit('"')), "phrase", 0.85),
        many(F.col("_lexical"), "lexical", 0.7),
        many(F.col("_symbols"), "symbol", 0.7),
        some(initials.isNotNull(), F.concat_ws(" ", n, initials), "acronym", 0.65),
    )
    parts = F.when(n != "", own).otherwise(none)
    if hyde is not None:
        text = T.truncate_word(T.normalize_query(F.coalesce(F.col(hyde), F.lit(""))), max(80, hyde_chars))
        parts = F.concat(parts, some(text != "", text, "pseudo_hyde", 0.55))
    d = pinned(d, _parts=parts)
    d = pinned(d, _all=F.filter(F.transform("_parts", lambda v: F.struct(T.normalize_query(v["query"]).alias("query"), v["kind"], v["weight"])), lambda v: v["query"] != ""))
    d = pinned(d, _names=F.transform("_all", lambda v: v["query"]))
    first = F.filter("_all", lambda v, i: F.array_position("_names", v["query"]) == i + 1)
    return d.withColumn("variants", F.slice(first, 1, most)).drop(*[c for c in d.columns if c.startswith("_")])
