"""Secret scans: three fixed patterns, and a battery of randomness tests on unlabelled tokens.

Base spans are the leftmost non-overlapping matches of each pattern. The battery takes each
run of 20 or more token characters, infers its encoding (hex, base32 or base64) and tests the
hypothesis that it is ordinary text. How likely would text give so flat an alphabet and so many
runs of character classes? Both scale with length under text and are combined by Stouffer's rule. A token
that a test of randomness rejects (Pearson's chi-squared against the uniform alphabet, the
number of runs, the lag-1 serial correlation of alphabet positions) has a p-value of 1: that only raises
p-values, so they stay valid under the hypothesis, and all tokens are tested, random or not.
Benjamini and Hochberg's step-up rule over all of them, run apart for each encoding and length band,
bounds the share of false discoveries. P-values are binned upwards, so that a stratum needs
401 counters however many tokens there are, and the thresholds are one number a stratum.

Null texts count as empty; an empty table gives an empty result; repeated rows each give a row, and
their tokens count as often; ties share a bin and so a decision; extra columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import packed, pinned

PATTERNS = {
    "assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    # A shorter run fails as a whole, so the least length can stand in these two patterns.
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encoding: pattern, alphabet, mean of the summed squared letter shares in text, share of class changes if random.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.15, 0.469),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.08, 0.305),
    "base64": (r"^.+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.07, 0.645),
}
#: Upper ends of the length bands, within which discoveries are controlled together.
BANDS = (24, 32, 48, 96)
TEXT_CHANGES, REJECT, RATE, BINS = 0.1, 3.29, 0.001, 400
BLOCK = 64


def _starts(parts: Column) -> Column:
    """Add to each struct<gap,len,...> its start. Lengths are summed within blocks, and block sums before each block: n * BLOCK / 2 + (n / BLOCK)^2 / 2 additions for n matches."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))

    def placed(blocks: Column, sums: Column) -> Column:
        return F.transform(blocks, lambda xs, b: inside(xs, F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0).cast("long"), lambda a, x: a + x)))

    def inside(xs: Column, base: Column) -> Column:
        one = lambda base: F.transform(xs, lambda x, i: F.struct((base + total(F.slice(xs, F.lit(1), i)) + x["gap"]).alias("start"), x["len"].alias("len"), x["match"].alias("match")))
        return F.get(F.transform(F.array(base), one), F.lit(0))

    # A value that several places need is bound as the one element of an array.
    bound = F.get(F.transform(F.array(blocks), lambda bs: F.get(F.transform(F.array(F.transform(bs, total)), lambda sums: F.flatten(placed(bs, sums))), F.lit(0))), F.lit(0))
    return F.when(F.size(parts) > 0, bound).otherwise(F.expr("cast(array() as array<struct<start:bigint,len:bigint,match:string>>)"))


def matched(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add for each pattern an array<struct<start,len,match>> of its leftmost non-overlapping matches.

    The matches are cut out of the text by the same pattern; what is left between them gives
    the offsets. Texts without a match are not cut.
    """
    df = pinned(df, **{f"_m_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    df = pinned(df, **{f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()})
    long = lambda c: F.length(c).cast("long")
    df = pinned(
        df,
        **{
            f"_z_{k}": F.when(
                F.size(f"_m_{k}") > 0,
                F.zip_with(F.slice(f"_p_{k}", F.lit(1), F.size(f"_m_{k}")), f"_m_{k}", lambda gap, m: F.struct(long(gap).alias("gap"), long(m).alias("len"), m.alias("match"))),
            ).otherwise(F.expr("cast(array() as array<struct<gap:bigint,len:bigint,match:string>>)"))
            for k in patterns
        },
    ).drop(*[f"_{x}_{k}" for k in patterns for x in "mp"])
    return pinned(df, **{k: _starts(F.col(f"_z_{k}")) for k in patterns}).drop(*[f"_z_{k}" for k in patterns])


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the logistic approximation, which errs on the large side far out."""
    x = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1.0 / (1.0 + F.exp(1.5976 * x + 0.070566 * x * x * x))


def tested(token: Column, length: Column) -> Column:
    """struct<encoding,band,bin> of a token's battery, by built-in functions over one token. bin: of -10 log10(p)."""
    body = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    encoding = F.when(body.rlike(ENCODINGS["hex"][0]), "hex").when(body.rlike(ENCODINGS["base32"][0]), "base32").otherwise("base64")
    band = sum((F.when(length > x, 1).otherwise(0) for x in BANDS), F.lit(0))
    facts = []
    for name, (_, alphabet, squares, changes) in ENCODINGS.items():
        facts.append(F.when(encoding == name, _battery(F.lower(body) if name == "hex" else body, alphabet, squares, changes)))
    outcome = F.coalesce(*facts)
    return F.struct(encoding.alias("encoding"), band.alias("band"), outcome.alias("bin"))


def _battery(body: Column, alphabet: str, squares: float, changes: float) -> Column:
    k = float(len(alphabet))
    n = F.greatest(F.length(body), F.lit(2)).cast("double")
    counts = F.transform(F.array(*[F.lit(c) for c in alphabet]), lambda c: (n - F.length(F.replace(body, c, F.lit("")))).cast("double"))
    chi = k / n * F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) - n
    z_uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    mean_text = k * (1 + (n - 1) * squares) - n
    z_flat = (mean_text - chi) / F.sqrt(2 * (k - 1) + 4 * F.greatest(mean_text - (k - 1), F.lit(0.0)))
    # Runs of classes are counted as class changes: each class run is squeezed to one mark.
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[0-9]+", "#"), "[a-z]+", "%"), "[A-Z]+", "&"), "[+/]+", "!")).cast("double") - 1
    z_runs = F.abs(runs - changes * (n - 1)) / F.sqrt(changes * (1 - changes) * (n - 1))
    z_many = (runs - TEXT_CHANGES * (n - 1)) / F.sqrt(TEXT_CHANGES * (1 - TEXT_CHANGES) * (n - 1))
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(alphabet)).cast("double"))
    first = F.aggregate(
        codes,
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("product"), F.lit(0.0).alias("square"), F.lit(0.0).alias("total"), F.lit(0.0).alias("ends")),
        lambda a, x: F.struct(
            x.alias("last"),
            (a["product"] + F.coalesce(a["last"] * x, F.lit(0.0))).alias("product"),
            (a["square"] + x * x).alias("square"),
            (a["total"] + x).alias("total"),
            F.when(a["last"].isNull(), x).otherwise(a["ends"]).alias("ends"),
        ),
        lambda a: F.struct(a["product"].alias("product"), a["square"].alias("square"), a["total"].alias("total"), (a["ends"] + a["last"]).alias("ends")),
    )
    m = first["total"] / n
    spread = first["square"] - n * m * m
    serial = F.when(spread > 0, (first["product"] - m * (2 * first["total"] - first["ends"]) + (n - 1) * m * m) / spread).otherwise(1.0)
    z_serial = F.abs(serial + 1 / n) * F.sqrt(n)
    random = (z_uniform <= REJECT) & (z_runs <= REJECT) & (z_serial <= REJECT)
    p = _upper_tail((z_flat + z_many) / 2**0.5)
    return F.when(random, F.greatest(F.least(F.floor(-10 * F.log10(p)), F.lit(BINS)), F.lit(0)).cast("int")).otherwise(0)


def thresholds(tests: DataFrame) -> dict[tuple[str, int], int]:
    """The least bin that the step-up rule accepts, for each encoding and band, over the tests of all tokens. At most 15 x 401 counts reach the driver."""
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in tests.groupBy("encoding", "band", "bin").count().collect():
        counts.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["count"]
    found = {}
    for stratum, bins in counts.items():
        tests, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if b and 10 ** (-b / 10) <= RATE * above / tests:
                found[stratum] = b
    return found


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `base` and `found`, arrays of struct<start,order,end,kind>, and n_ of each pattern to each row; columns of these names are replaced."""
    kept_columns = [c for c in docs.columns if c not in {"base", "found", *[f"n_{k}" for k in PATTERNS]}]
    d = packed(docs, _t=F.coalesce(F.col(text), F.lit("")))
    token = matched(d.select("_t"), "_t", {"random": TOKEN}).select(F.explode("random").alias("x"))
    facts = pinned(token, f=tested(F.col("x.match"), F.col("x.len"))).select("f.*")
    limits = thresholds(facts)
    d = matched(d, "_t", PATTERNS | {"random": TOKEN})
    value = lambda m: F.regexp_extract(m, PATTERNS["assign"], 2)
    kept = {
        "assign": F.filter("assign", lambda x: F.length(value(x["match"])) >= LEAST["assign"]),
        "access": F.filter("access", lambda x: x["len"] >= LEAST["access"]),
        "hex": F.filter("hex", lambda x: x["len"] >= LEAST["hex"]),
    }
    accept = F.lit(False)
    judged = F.transform("random", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), tested(x["match"], x["len"]).alias("f")))
    d = pinned(d, _k=F.struct(*[c.alias(k) for k, c in kept.items()]), _r=judged)

    def accepted(f: Column) -> Column:
        test = accept
        for (encoding, band), least in limits.items():
            test = test | ((f["encoding"] == encoding) & (f["band"] == band) & (f["bin"] >= least))
        return test

    def spans(col: Column, kind: str, order: int) -> Column:
        return F.transform(col, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), (x["start"] + x["len"]).alias("end"), F.lit(kind).alias("kind")))

    base = F.array_sort(F.concat(*[spans(F.col(f"_k.{k}"), k, i) for i, k in enumerate(PATTERNS)]))
    d = pinned(d, base=base, _n=F.struct(*[F.size(f"_k.{k}").cast("long").alias(f"n_{k}") for k in PATTERNS]))
    d = pinned(d, found=F.array_sort(F.concat("base", spans(F.filter("_r", lambda x: accepted(x["f"])), "random", 3))))
    return d.select(*[F.col("row").getField(c).alias(c) for c in kept_columns], "base", "found", "_n.*")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    d = scan(docs.select("doc_id", "text"))
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
