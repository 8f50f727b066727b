"""Queries of the scalar functions, over all documents, conversations, events and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import embedding, evaluate, expansion, store, views
from gleanery.plans import inputs as N
from gleanery.sources import table

_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
_PACK = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS + T.MORE_STOPWORDS) + ")"
_NORMAL = lambda x: N.trim_sql(f"regexp_replace(lower({x}), '\\s+', ' ', 'g')")
_COLLAPSED = lambda x: N.trim_sql(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def normalize_query_sql(x: str) -> str:
    return N.trim_sql(f"regexp_replace(regexp_replace(translate(lower({x}), '“”‘’', '\"\"'''''), '[?!.:,;]+$', ''), '\\s+', ' ', 'g')")


_SENTENCES = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?\\n]+(?:[.!?]+|\\z)|[^\\n]+'), lambda s: {_COLLAPSED('s')}), lambda s: s <> '')"
_ANSWER = lambda x: f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]) ', '\\1' || chr(31), 'g'), chr(31)), lambda s: {N.trim_sql('s')}), lambda s: s <> '')"


def _docs(column):
    return lambda spark, d: table(spark, d, "documents").select("doc_id", column(F.col("text")).alias("v"))


def _turns(column):
    return lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", column(F.col("text")).alias("v"))


def _joined(f, by=" "):
    return lambda c: F.array_join(f(c), by)


_D = lambda v: f"SELECT doc_id, {v} AS v FROM documents"
_C = lambda v: f"SELECT conv_id, turn, {v} AS v FROM conversations"
_KEPT = lambda tokens, stop: f"array_to_string(list_filter({tokens}, lambda x: length(x) >= 2 AND x NOT IN {stop}), ' ')"
_QUESTIONS = "(SELECT conv_id, turn, ['what is ', 'tell me about ', 'find ', ''][turn % 4 + 1] || text || ['?', ' & co/x_y', '.', ''][turn % 4 + 1] AS q FROM conversations)"


def _questions(spark, d):
    t = F.col("turn") % 4
    opening = F.element_at(F.array(*map(F.lit, ("what is ", "tell me about ", "find ", ""))), (t + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, ("?", " & co/x_y", ".", ""))), (t + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(opening, "text", ending).alias("query"))


_WORDS = r"list_transform(regexp_extract_all(n, '[\p{L}\p{N}][\p{L}\p{N}_''-]*'), lambda t: lower(t))"
_LEXICAL = rf"""list_concat(flatten(list_transform({_WORDS}, lambda t: [
   CASE WHEN contains(t, '-') THEN replace(n, t, replace(t, '-', ' ')) END, CASE WHEN contains(t, '_') THEN replace(n, t, replace(t, '_', ' ')) END,
   CASE WHEN ends_with(t, 'ies') AND length(t) > 4 THEN replace(n, t, left(t, length(t) - 3) || 'y') END,
   CASE WHEN ends_with(t, 's') AND length(t) > 3 THEN replace(n, t, left(t, length(t) - 1)) END,
   CASE WHEN NOT ends_with(t, 's') AND length(t) > 3 THEN replace(n, t, t || 's') END])),
   [CASE WHEN regexp_replace(n, '\b([\p{{L}}\p{{N}}]+)\s+([\p{{L}}\p{{N}}]+)\b', '\1-\2', 'g') <> n THEN regexp_replace(n, '\b([\p{{L}}\p{{N}}]+)\s+([\p{{L}}\p{{N}}]+)\b', '\1-\2', 'g') END])"""
_SPELLED = "q"
for _k, _v in T.SYMBOL_WORDS.items():
    _SPELLED = f"replace({_SPELLED}, '{_k}', '{_v}')"
_PREFIX = rf"CASE WHEN regexp_matches(n, '^(?:{T.QUESTION_PREFIXES}) ') THEN {N.trim_sql(f"regexp_replace(n, '^(?:{T.QUESTION_PREFIXES}) ', '')")} ELSE n END"
_UNIQUE = "list_filter({0}, lambda x, i: x IS NOT NULL AND list_position({0}, x) = i)"


def expansion_ctes(source: str, keys: str) -> str:
    """CTE `expanded` with keys, n, lexical, symbols, acronym from a source of keys and q."""
    return rf"""x0 AS (SELECT {keys}, q, {normalize_query_sql("q")} AS n FROM {source}),
 x1 AS (SELECT *, {_PREFIX} AS stripped, {_WORDS} AS ws, {_LEXICAL} AS lex, [{normalize_query_sql(_SPELLED)}, {normalize_query_sql("regexp_replace(q, '[\\\\/]', ' ', 'g')")}, {normalize_query_sql("regexp_replace(q, '[^\\p{L}\\p{N}\\s]', '', 'g')")}] AS sym FROM x0),
 x2 AS (SELECT *, {_UNIQUE.format("lex")} AS lexical, list_filter(sym, lambda x, i: x <> '' AND x <> n AND list_position(sym, x) = i) AS symbols, list_filter(ws, lambda t: length(t) > 2) AS ls FROM x1),
 expanded AS (SELECT *, CASE WHEN len(ls) BETWEEN 2 AND 8 THEN array_to_string(list_transform(ls, lambda t: left(t, 1)), '') END AS acronym FROM x2)"""


def variants_sql(keys: str, most: int, quoted: bool, hyde: str = "") -> str:
    """CTE `variants` with keys, position, query, kind, weight after `expanded`."""
    one = lambda q, kind, w: f"{{'q': {q}, 'kind': '{kind}', 'w': {w}::DOUBLE}}"
    parts = [
        f"[{one('n', 'normalized', 1)}]",
        f"CASE WHEN stripped <> n THEN [{one('stripped', 'phrase', 0.9)}] ELSE [] END",
        *([f"CASE WHEN len(ws) > 1 THEN [{one(chr(39) + chr(34) + chr(39) + ' || n || ' + chr(39) + chr(34) + chr(39), 'phrase', 0.85)}] ELSE [] END"] if quoted else []),
        f"list_transform(lexical, lambda v: {one('v', 'lexical', 0.7)})",
        f"list_transform(symbols, lambda v: {one('v', 'symbol', 0.7)})",
        f"CASE WHEN acronym IS NOT NULL THEN [{one(chr(110) + ' || ' + chr(39) + ' ' + chr(39) + ' || acronym', 'acronym', 0.65)}] ELSE [] END",
    ]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = f"list_concat({all_parts}, {p})"
    own = f"CASE WHEN n <> '' THEN {all_parts} ELSE [] END"
    if hyde:
        own = f"list_concat({own}, CASE WHEN {hyde} <> '' THEN [{one(hyde, 'pseudo_hyde', 0.55)}] ELSE [] END)"
    return f"""v0 AS (SELECT {keys}, {own} AS vs FROM expanded),
 v1 AS (SELECT {keys}, generate_subscripts(vs, 1) AS i, unnest(vs) AS v FROM v0),
 v2 AS (SELECT {keys}, i, {normalize_query_sql("v.q")} AS query, v.kind AS kind, v.w AS weight FROM v1),
 v3 AS (SELECT *, row_number() OVER (PARTITION BY {keys}, query ORDER BY i) AS again FROM v2 WHERE query <> ''),
 variants AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS position FROM v3 WHERE again = 1) WHERE position <= {most})"""


def _expanded(most, quoted, hyde=None):
    def run(spark, d):
        q = _questions(spark, d)
        if hyde:
            q = q.withColumn("hyde", F.concat(F.lit("Some "), F.repeat("query", 3)))
        x = expansion.expand(q, most, quoted, "hyde" if hyde else None, 100)
        return x.select("conv_id", "turn", F.posexplode("variants").alias("p", "v")).select("conv_id", "turn", (F.col("p") + 1).alias("position"), "v.query", "v.kind", "v.weight")

    return run


_HYDE = N.trim_sql(f"CASE WHEN length({normalize_query_sql('''('Some ' || repeat(q, 3))''')}) <= 100 THEN {normalize_query_sql('''('Some ' || repeat(q, 3))''')} ELSE left({normalize_query_sql('''('Some ' || repeat(q, 3))''')}, CASE WHEN length(left({normalize_query_sql('''('Some ' || repeat(q, 3))''')}, 100)) - strpos(reverse(left({normalize_query_sql('''('Some ' || repeat(q, 3))''')}, 100)), ' ') > 50 THEN 100 - strpos(reverse(left({normalize_query_sql('''('Some ' || repeat(q, 3))''')}, 100)), ' ') ELSE 100 END) END")
_VARIANT_COLUMNS = "SELECT conv_id, turn, position, query, kind, weight FROM variants"


def _query_arrays(f):
    return lambda spark, d: _questions(spark, d).withColumn("n", T.normalize_query(F.col("query"))).select("conv_id", "turn", f(F.col("query"), F.col("n")).alias("v"))


def _pairs(f):
    """Functions of two token sets: a document and the next."""

    def run(spark, d):
        x = table(spark, d, "documents").select("doc_id", T.lexical_tokens(F.col("text")).alias("a"))
        y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
        return x.join(y, "doc_id").select("doc_id", F.round(f(F.col("a"), F.col("b")), 9).alias("v"))

    return run


_SETS = rf"""t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[0-9A-Za-z_]+'), lambda x: length(x) >= 2 AND x NOT IN {_STOP})) AS a FROM documents),
 p AS (SELECT x.doc_id, x.a, y.a AS b, len(list_intersect(x.a, y.a)) AS n_both FROM t x JOIN t y ON y.doc_id = x.doc_id + 1)"""
_EVENTS = lambda f: lambda spark, d: f(table(spark, d, "events"))
_E = "value::DOUBLE"
_CONF = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value / 6000.0::DOUBLE) / (1.0::DOUBLE / 61))) * (0.35::DOUBLE + 0.65::DOUBLE * least(1.0::DOUBLE, (event_id % 4) / 2.0::DOUBLE)) * (0.75::DOUBLE + 0.25::DOUBLE * least(1.0::DOUBLE, (event_id % 5) / 3.0::DOUBLE))"
_CONF = f"CASE WHEN event_id % 5 > 0 THEN {_CONF} ELSE 0.0::DOUBLE END"


def _confidence():
    return T.confidence(F.col("value") / 6000.0, F.col("event_id") % 4, F.col("event_id") % 5)


def _bytes_sql(n: str) -> str:
    out = f"{n} || ' B'"
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        x = f"({n} / {1024**power}.0::DOUBLE)"
        out = f"CASE WHEN {n} >= {1024**power} THEN CASE WHEN {x} >= 10 THEN printf('%.0f', {x}) ELSE printf('%.1f', {x}) END || ' {unit}' ELSE {out} END"
    return out


def _formula_sql(x: str) -> str:
    for pattern, by in (*T.FORMULA_COMMANDS, *T.FORMULA_REST):
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return _COLLAPSED(x)


def _boundary_sql(x: str, most: int | str) -> str:
    cut = f"left({x}, {most})"
    last = lambda m: f"(CASE WHEN contains({cut}, '{m}') THEN length({cut}) - strpos(reverse({cut}), '{m[::-1]}') - {len(m) - 1} ELSE -1 END)"
    stop = f"greatest({last('. ')}, {last('? ')}, {last('! ')})"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE regexp_replace(CASE WHEN {stop} > {most} * 0.45 THEN left({cut}, {stop} + 1) WHEN {last(" ")} > {most} * 0.5 THEN left({cut}, {last(' ')}) ELSE {cut} END, '\\s+$', '') END"


def _word_sql(x: str, most: int) -> str:
    cut = f"left({x}, {most})"
    space = f"(CASE WHEN contains({cut}, ' ') THEN length({cut}) - strpos(reverse({cut}), ' ') ELSE -1 END)"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE {N.trim_sql(f'CASE WHEN {space} > {most * 0.5} THEN left({cut}, {space}) ELSE {cut} END')} END"


_CITED = "text || ' [E' || (turn % 3 + 1) || ']. More 【E' || (turn % 2 + 1) || '†L1】 and [ E0' || (turn % 4) || ' ]. Plain. End [E2].'"


def _cited(spark, d):
    t = F.col("turn")
    parts = [F.col("text"), F.lit(" [E"), t % 3 + 1, F.lit("]. More 【E"), t % 2 + 1, F.lit("†L1】 and [ E0"), t % 4, F.lit(" ]. Plain. End [E2].")]
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_citations(F.concat(*parts)).alias("answer"))


_NORMAL_CITED = rf"regexp_replace(regexp_replace({_CITED}, '【\s*E\s*0*([0-9]+)\s*(?:†[^】]*)?】', '[E\1]', 'g'), '\[\s*E0*([0-9]+)\s*\]', '[E\1]', 'g')"
_TERMS = "list_distinct(" + f"list_filter(regexp_extract_all(lower('the hand that thonre and onhandre'), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*'), lambda x: length(x) >= 2 AND x NOT IN {_PACK})" + ")"


def _scored(spark, d):
    q = F.lit("the hand that thonre and onhandre")
    s = table(spark, d, "documents").select("doc_id", F.posexplode(T.packing_sentences(F.col("text"))).alias("i", "s"))
    return s.select("doc_id", "i", F.round(T.sentence_score(F.col("s"), F.array_distinct(T.packing_tokens(q)), F.lit("and en")), 9).alias("v"))


QUERIES = {
    "tok_lexical": (_docs(_joined(T.lexical_tokens)), _D(_KEPT("regexp_extract_all(lower(text), '[0-9A-Za-z_]+')", _STOP))),
    "tok_rerank": (_docs(lambda c: F.array_join(T.rerank_tokens(T.nfkc(c)), " ")), _D(_KEPT(rf"regexp_extract_all({_NORMAL('text')}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_''-]*')", _STOP))),
    "tok_expansion": (_docs(_joined(T.expansion_tokens)), _D(r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}_''-]*'), ' ')")),
    "tok_packing": (_docs(_joined(T.packing_tokens)), _D(_KEPT(r"regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}''-]*')", _PACK))),
    "tok_keywords": (_docs(_joined(T.keyword_tokens)), _D(f"array_to_string(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]*'), lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN {_STOP}), ' ')")),
    "normalize_text": (_docs(T.normalize_text), _D(_NORMAL("text"))),
    "normalize_query": (lambda s, d: _questions(s, d).select("conv_id", "turn", T.normalize_query(F.col("query")).alias("v")), f"SELECT conv_id, turn, {normalize_query_sql('q')} AS v FROM {_QUESTIONS}"),
    "strip_question_prefix": (_query_arrays(lambda q, n: T.strip_question_prefix(n)), f"SELECT conv_id, turn, {_PREFIX} AS v FROM (SELECT conv_id, turn, {normalize_query_sql('q')} AS n FROM {_QUESTIONS})"),
    "lexical_variants": (_query_arrays(lambda q, n: F.array_join(expansion.lexical_variants(n), "|")), f"WITH {expansion_ctes(_QUESTIONS, 'conv_id, turn')} SELECT conv_id, turn, array_to_string(lexical, '|') AS v FROM expanded"),
    "symbol_variants": (_query_arrays(lambda q, n: F.array_join(expansion.symbol_variants(q, n), "|")), f"WITH {expansion_ctes(_QUESTIONS, 'conv_id, turn')} SELECT conv_id, turn, array_to_string(symbols, '|') AS v FROM expanded"),
    "acronym_variant": (_query_arrays(lambda q, n: expansion.acronym(n)), f"WITH {expansion_ctes(_QUESTIONS, 'conv_id, turn')} SELECT conv_id, turn, acronym AS v FROM expanded"),
    "expand_query": (_expanded(12, True), f"WITH {expansion_ctes(_QUESTIONS, 'conv_id, turn')},\n{variants_sql('conv_id, turn', 12, True)}\n{_VARIANT_COLUMNS}"),
    "expand_query_search": (_expanded(8, False), f"WITH {expansion_ctes(_QUESTIONS, 'conv_id, turn')},\n{variants_sql('conv_id, turn', 8, False)}\n{_VARIANT_COLUMNS}"),
    "expand_query_hyde": (_expanded(40, True, True), f"WITH {expansion_ctes(_QUESTIONS, 'conv_id, turn')},\n{variants_sql('conv_id, turn', 40, True, 'h').replace('FROM expanded', f'FROM (SELECT *, {_HYDE} AS h FROM expanded)')}\n{_VARIANT_COLUMNS}"),
    "truncate_word": (_docs(lambda c: T.truncate_word(c, 800)), _D(_word_sql("text", 800))),
    "truncate_boundary": (_docs(lambda c: T.truncate_boundary(c, 950)), _D(_boundary_sql("text", 950))),
    "page_normalize": (_docs(lambda c: T.normalize_page(F.concat(F.replace(c, F.lit("."), F.lit(". \t\r\n\r\n\n")), F.lit("\n\n")))), _D(r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, '.', '. ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10)) || chr(10) || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\n+$', '')")),
    "compact_text": (_docs(T.compact), _D(f"CASE WHEN length({_COLLAPSED('text')}) <= 96 THEN {_COLLAPSED('text')} ELSE left({_COLLAPSED('text')}, 95) || '...' END")),
    "sentences_chunker": (_docs(lambda c: F.array_join(F.split(c, T.CHUNK_BREAK, -1), "|")), _D(r"regexp_replace(text, '([.!?])\s+([A-Z])', '\1|\2', 'g')")),
    "sentences_packing": (_docs(_joined(T.packing_sentences, "|")), _D(f"array_to_string({_SENTENCES('text')}, '|')")),
    "sentences_answer": (_docs(_joined(T.answer_sentences, "|")), _D(f"array_to_string({_ANSWER('text')}, '|')")),
    "sentence_score": (_scored, rf"""WITH s AS (SELECT doc_id, generate_subscripts(xs, 1) - 1 AS i, unnest(xs) AS s FROM (SELECT doc_id, {_SENTENCES("text")} AS xs FROM documents)),
      h AS (SELECT doc_id, i, s, list_intersect(list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''-]*')), {_TERMS}) AS hit FROM s)
      SELECT doc_id, i, round(coalesce(list_sum(list_transform(hit, lambda x: CASE WHEN length(x) >= 6 THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END)), 0.0::DOUBLE) + CASE WHEN contains({_NORMAL("s")}, 'and en') THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END, 9) AS v FROM h"""),
    "exact_phrase": (_docs(lambda c: T.exact_phrase(F.lit('"thand the"'), T.normalize_text(c))), _D(f"CASE WHEN contains({_NORMAL('text')}, 'thand the') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")),
    "overlap_ratio": (_pairs(T.overlap_ratio), f"WITH {_SETS} SELECT doc_id, round(CASE WHEN least(len(a), len(b)) > 0 THEN n_both / least(len(a), len(b))::DOUBLE ELSE 0.0::DOUBLE END, 9) AS v FROM p"),
    "jaccard": (_pairs(T.jaccard), f"WITH {_SETS} SELECT doc_id, round(CASE WHEN least(len(a), len(b)) > 0 THEN n_both / (len(a) + len(b) - n_both)::DOUBLE ELSE 0.0::DOUBLE END, 9) AS v FROM p"),
    "normalize_citations": (lambda s, d: _cited(s, d), f"SELECT conv_id, turn, {_NORMAL_CITED} AS answer FROM conversations"),
    "sentence_citations": (lambda s, d: _cited(s, d).select("conv_id", "turn", F.posexplode(T.answer_sentences(F.col("answer"))).alias("i", "s")).select("conv_id", "turn", "i", F.array_join(T.citation_numbers(F.col("s")).cast("array<string>"), ",").alias("cites")), f"SELECT conv_id, turn, i, array_to_string(list_transform(regexp_extract_all(s, '\\[E([0-9]+)\\]', 1), lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS cites FROM (SELECT conv_id, turn, generate_subscripts(xs, 1) - 1 AS i, unnest(xs) AS s FROM (SELECT conv_id, turn, {_ANSWER('a')} AS xs FROM (SELECT conv_id, turn, {_NORMAL_CITED} AS a FROM conversations)))"),
    "page_proximity": (_EVENTS(lambda e: e.select("event_id", F.round(T.page_proximity(F.col("user_id") % 2 == 0, F.col("event_id") % 7, F.col("event_id") % 7 + 1, F.col("user_id") % 5, F.col("user_id") % 5 + 2), 9).alias("v"))), "SELECT event_id, round(CASE WHEN user_id % 2 = 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - least(abs(event_id % 7 - (user_id % 5 + 2)), abs(user_id % 5 - (event_id % 7 + 1))) / 3.0::DOUBLE)) ELSE 0.0::DOUBLE END, 9) AS v FROM events"),
    "answer_confidence": (_EVENTS(lambda e: e.select("event_id", F.round(_confidence(), 9).alias("v"))), f"SELECT event_id, round({_CONF}, 9) AS v FROM events"),
    "answer_score": (_EVENTS(lambda e: e.select("event_id", F.round(T.answer_score(_confidence(), F.col("event_id") % 4), 9).alias("v"))), f"SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_CONF}) * (0.55::DOUBLE + 0.45::DOUBLE * least(1.0::DOUBLE, (event_id % 4) / 2.0::DOUBLE)))), 9) AS v FROM events"),
    "confidence_band": (_EVENTS(lambda e: e.select("event_id", T.confidence_band(_confidence()).alias("v"))), f"SELECT event_id, CASE WHEN {_CONF} >= 0.75 THEN 'high' WHEN {_CONF} >= 0.4 THEN 'medium' ELSE 'low' END AS v FROM events"),
    "score_fill": (_EVENTS(lambda e: e.select("event_id", F.round(T.score_fill(F.col("value") / 50), 9).alias("v"))), "SELECT event_id, round(greatest(4.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN value / 50 <= 1 THEN value / 50 ELSE (value / 50) / (value / 50 + 1) END * 100)), 9) AS v FROM events"),
    "format_bytes": (_EVENTS(lambda e: e.select("event_id", T.format_bytes(F.col("event_id") * F.col("event_id") * 977).alias("v"))), f"SELECT event_id, {_bytes_sql('(event_id * event_id * 977)')} AS v FROM events"),
    "progress_pct": (_EVENTS(lambda e: e.select("event_id", T.progress_pct(F.col("event_id") % 90, F.col("user_id") % 80).alias("v"))), "SELECT event_id, CASE WHEN user_id % 80 > 0 THEN least(100, CAST(floor((event_id % 90) / (user_id % 80)::DOUBLE * 100 + 0.5) AS INTEGER)) ELSE 0 END AS v FROM events"),
    "estimate_chunks": (_EVENTS(lambda e: e.select("event_id", T.estimate_chunks(F.col("event_id") * 991, F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 300).cast("int"))).alias("v"))), "SELECT event_id, greatest(greatest(1, CAST(floor(event_id * 991 / 2200.0::DOUBLE + 0.5) AS INTEGER)), CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 300 AS INTEGER) * 3 ELSE 0 END) AS v FROM events"),
    "normalize_scores": (_EVENTS(lambda e: e.withColumn("m", F.max("value").over(Window.partitionBy("user_id"))).select("event_id", F.round(F.when(F.col("m") > 0, F.col("value") / F.col("m")).otherwise(0.0), 9).alias("v"))), "SELECT event_id, round(CASE WHEN max(value) OVER (PARTITION BY user_id) > 0 THEN value / max(value) OVER (PARTITION BY user_id) ELSE 0.0::DOUBLE END, 9) AS v FROM events"),
    "latency_summary": (_EVENTS(lambda e: evaluate.latency(e, "event_type", "value").withColumn("avg_ms", F.round("avg_ms", 7))), "SELECT event_type, count(*) AS n, round(avg(value), 7) AS avg_ms, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50_ms, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95_ms FROM events GROUP BY event_type"),
    "percentile_floor": (_EVENTS(lambda e: e.groupBy("user_id").agg(T.percentile_floor(F.collect_list("value"), 0.95).alias("v"))), "SELECT user_id, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS v FROM events GROUP BY user_id"),
    "lcg_sequence": (lambda s, d: s.range(1).select(F.posexplode(T.lcg(42, 100)).alias("i", "state")), "WITH RECURSIVE g AS (SELECT 0 AS i, (1664525::BIGINT * 42 + 1013904223) % 4294967296 AS state UNION ALL SELECT i + 1, (1664525::BIGINT * state + 1013904223) % 4294967296 FROM g WHERE i < 99) SELECT i, state FROM g"),
    "vector_dot": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(T.dot(F.col("embedding"), F.slice("embedding", 2, 40)), 7).alias("v")), "SELECT vec_id, round(list_sum(list_transform(generate_series(1, 40), lambda i: embedding[i]::DOUBLE * embedding[i + 1]::DOUBLE)), 7) AS v FROM embeddings"),
    "l2_normalize": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(T.l2_normalize(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 7).alias("v")), "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, round(unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 7) AS v FROM embeddings"),
    "vector_search_table": (
        lambda s, d: embedding.nearest(table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.lit(None).cast("string").alias("only")), table(s, d, "embeddings").select("vec_id", "embedding"), 10, "vec_id").withColumn("score", F.round("score", 9)),
        "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(round(list_sum(list_transform(generate_series(1, len(q.embedding)), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)), 12), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10",
    ),
    "formula_preview": (_docs(lambda c: T.formula_preview(F.concat(F.lit(r"\frac{a_{i}}{b^{2n}} \leq \left( \text{"), F.left(F.regexp_replace(c, r"[{}\\]", ""), F.lit(300)), F.lit(r"} \right)+x=\sqrt{\pi}")))), _D(_formula_sql(r"'\frac{a_{i}}{b^{2n}} \leq \left( \text{' || left(regexp_replace(text, '[{}\\]', '', 'g'), 300) || '} \right)+x=\sqrt{\pi}'"))),
    "pagination": (_EVENTS(lambda e: views.pagination(e.select(F.col("event_id").alias("id"), (F.col("event_id") % 97).alias("total"), (F.col("user_id") % 30).alias("page")))), "WITH t AS (SELECT event_id AS id, event_id % 97 AS total, user_id % 30 AS page FROM events), p AS (SELECT *, greatest(1, CAST(ceil(total / 5.0::DOUBLE) AS INTEGER)) AS total_pages FROM t), c AS (SELECT *, CAST(least(greatest(1, page), total_pages) AS INTEGER) AS current FROM p) SELECT id, total_pages, current, (current - 1) * 5 + 1 AS first, least(total, current * 5) AS last, array_to_string(list_filter(generate_series(1, total_pages), lambda x: x = 1 OR x = total_pages OR abs(x - current) <= 1), ',') AS pages FROM c"),
    "upload_validate": (lambda s, d: store.validated(table(s, d, "documents").select(F.concat(F.lit("f"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(".txt")).alias("filename"), F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "application/pdf").otherwise("text/plain").alias("content_type"), (F.col("n_chars") * 100000).alias("size_bytes"))), "SELECT *, CASE WHEN NOT (content_type IN ('', 'application/pdf') OR ends_with(lower(filename), '.pdf')) THEN 415 WHEN size_bytes > 209715200 THEN 413 ELSE 202 END AS status FROM (SELECT 'f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.txt' END AS filename, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'application/pdf' ELSE 'text/plain' END AS content_type, n_chars * 100000 AS size_bytes FROM documents)"),
}
