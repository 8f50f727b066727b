"""Document fingerprints by order min-hashing.

A text's k-mers are its runs of K words, and equal ones are numbered by occurrence: the second
`a b c` is another element than the first. For each of ORDERS independent orders, the L minimal
elements by that order's hash of (k-mer, occurrence) are selected, put back into text order, and
hashed together to 32 bits: an entry changes when a selected element is lost and also when two
change places, as edit distance does. Likeness of two signatures: the share of equal entries.

An order's hash is computed for all elements, but only values under a threshold, below which
ENOUGH of them are expected, are sorted; where fewer than L lie there, all are.

Fewer than K words are one k-mer; fewer than L elements are all selected. An empty or null text has
an empty fingerprint; two such have likeness 1, one of them and another text 0. Equal texts have equal fingerprints.
The next document is the next row by (doc_id, text), null doc_ids first; the first follows the last,
and one row alone follows itself. Repeated rows each give a row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import WORD, pinned

K, L, ORDERS, ENOUGH = 3, 2, 24, 12
#: Bits of a position. An array of 2^27 words and their references is over the 2 GB that a row can have.
AT = 27
POSITION = (1 << AT) - 1
ROWS_A_BUCKET, MOST_BOUNDS = 64, 10_000
_NONE = "cast(array() as array<bigint>)"


def elements(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add an array with a long for each element of a text: the hash of (k-mer, occurrence), its last AT bits replaced by the position."""
    at, kmer = lambda x: x.bitwiseAND(F.lit(POSITION)), lambda x: F.shiftright(x, AT)
    put = lambda h, i: h.bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long"))
    d = pinned(df, w_=F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)))
    kmers = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w_") - K, F.lit(0))), lambda i: put(F.xxhash64(*[F.get("w_", i + j) for j in range(K)]), i))
    # Sorting puts equal k-mers together, in text order.
    d = pinned(d, p_=F.when(F.size("w_") > 0, F.sort_array(kmers)).otherwise(F.expr(_NONE))).drop("w_")
    again = lambda xs, x, i: (i > 0) & (kmer(x) == kmer(F.get(xs, i - 1)))
    d = pinned(d, f_=F.filter("p_", lambda x, i: ~again("p_", x, i)), r_=F.filter("p_", lambda x, i: again("p_", x, i))).drop("p_")
    # What repeats is numbered by its distance from the start of its run.
    d = pinned(d, h_=F.filter(F.transform("r_", lambda x, i: F.when(~again("r_", x, i), i)), lambda i: i.isNotNull()))
    number = lambda x, n: put(F.xxhash64(kmer(x), n), at(x))
    runs = F.transform("h_", lambda h, t: F.transform(F.sequence(h, F.coalesce(F.get("h_", t + 1), F.size("r_")) - 1), lambda j: number(F.get("r_", j), j - h + 1)))
    return pinned(d, **{out: F.concat(F.transform("f_", lambda x: number(x, F.lit(0))), F.when(F.size("h_") > 0, F.flatten(runs)).otherwise(F.expr(_NONE)))}).drop("f_", "r_", "h_")


def signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the signature of a text column: ORDERS entries of eight hex digits, or none."""
    d = elements(df, text, "e_")
    n = F.size("e_")
    share = F.least(F.lit(float(ENOUGH)) / n, F.lit(1.0))
    d = pinned(d, t_=F.when(n <= ENOUGH, F.lit((1 << 63) - 1)).otherwise((share * float(1 << 64) - float(1 << 63)).cast("long")))
    rank = lambda x, r: F.xxhash64(F.shiftright(x, AT), r)

    def entry(few: Column, r: Column) -> Column:
        few = F.when(F.size(few) >= F.least(F.lit(L), n), few).otherwise(F.col("e_"))
        ranked = F.transform(few, lambda x: rank(x, r).bitwiseAND(F.lit(~POSITION)).bitwiseOR(x.bitwiseAND(F.lit(POSITION))))
        least = F.slice(F.sort_array(ranked), F.lit(1), F.lit(L))
        in_text = F.sort_array(F.transform(least, lambda y: F.shiftleft(y.bitwiseAND(F.lit(POSITION)), 64 - AT - 1).bitwiseOR(F.shiftrightunsigned(y, AT + 1))))
        tied = F.xxhash64(F.transform(in_text, lambda y: y.bitwiseAND(F.lit((1 << 64 - AT - 1) - 1))))
        return F.right(F.lpad(F.lower(F.hex(tied)), 16, "0"), F.lit(8))

    def of(r: Column) -> Column:
        few = F.filter("e_", lambda x: rank(x, r) <= F.col("t_"))
        return F.get(F.transform(F.array(few), lambda xs: entry(xs, r)), F.lit(0))  # one evaluation of `few`

    entries = F.transform(F.array(*map(F.lit, range(1, ORDERS + 1))), of)
    return pinned(d, **{out: F.when(n > 0, entries).otherwise(F.expr("cast(array() as array<string>)"))}).drop("e_", "t_")


def likeness(a: str, b: str) -> Column:
    """The share of equal entries; 1 if neither has any."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(same / F.lit(ORDERS)).cast("double")


def _rank(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are at most x, by a two-level search; 0 for null."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    array = lambda xs: F.expr(f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)")
    c = F.size(F.filter(array(bounds[::step]), lambda b: b <= x))
    fine = F.size(F.filter(F.slice(array(bounds), F.greatest((c - 1) * step + 1, F.lit(1)), F.lit(step)), lambda b: b <= x))
    return F.when(x.isNull() | (c == 0), 0).otherwise((c - 1) * step + fine)


def with_next(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Add n_text and n_sig, text and signature of the next row by (doc_id, text); the first follows the last.

    Rows are dealt to ranges of doc_id, whose bounds are quantiles (at most 10,000 numbers); the
    first row of each range is also sent to the range before it. Texts move once. Null doc_ids
    come first. ids: the same rows, of which only doc_id is read.
    """
    want = max(1, min(MOST_BOUNDS, ids.count() // ROWS_A_BUCKET))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / want for i in range(1, want)] or [0.5], 20 * MOST_BOUNDS).alias("q")).first()["q"] or []
    rank = _rank(sorted(set(cuts)), F.col("doc_id"))
    d = docs.withColumn("bucket", rank)
    firsts = {r["bucket"]: r["first"] for r in ids.select("doc_id", rank.alias("bucket")).groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("m")).select("bucket", F.col("m.doc_id").alias("first")).collect()}
    order = sorted(firsts)
    if not order:
        return d.withColumns({"n_text": F.col("text"), "n_sig": F.col("sig")}).drop("bucket")
    array = lambda xs, kind: F.expr(f"cast(split('{','.join(map(str, xs))}', ',') as array<{kind}>)")
    by_bucket = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    table = {b: (by_bucket[b], firsts[b]) for b in order}
    dense = [table.get(b, (0, 0)) for b in range(order[-1] + 1)]
    before = F.get(array([x[0] for x in dense], "int"), F.col("bucket"))
    first = F.get(array([x[1] if x[1] is not None else 0 for x in dense], "bigint"), F.col("bucket"))
    null_bucket = order[0] if firsts[order[0]] is None else -1
    is_first = F.when(F.col("bucket") == null_bucket, F.col("doc_id").isNull()).otherwise(F.coalesce(F.col("doc_id") == first, F.lit(False)))
    own = F.struct(F.col("bucket"), F.lit(False).alias("tail"))
    d = d.withColumn("_to", F.explode(F.when(is_first, F.array(own, F.struct(before.alias("bucket"), F.lit(True).alias("tail")))).otherwise(F.array(own)))).select(*[c for c in d.columns if c != "bucket"], "_to.*")
    w = Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return d.withColumns({"n_text": F.lead("text").over(w), "n_sig": F.lead("sig").over(w)}).filter(~F.col("tail")).drop("bucket", "tail")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(signature(d, "text", "sig"), docs.select("doc_id"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("n_text", F.lit(1), quarter))
    d = pinned(d, edited=edited).drop("n_text")
    d = signature(d, "edited", "e_sig")
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sig", "").alias("fingerprint"),
        F.array_join("e_sig", "").alias("edited_fingerprint"),
        likeness("sig", "e_sig").alias("near_edited"),
        likeness("sig", "n_sig").alias("near_next"),
    )
