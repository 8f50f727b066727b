"""Mixing sources to target weights by a low-discrepancy schedule.

Targets come from the weights by rounds of water-filling under a cap of MAX_EPOCHS times a
source's size. The mix is a sequence of slots of `block` words each, one length for all sources.
Slot s = 0, 1, ... has the point frac((s + 1) / golden ratio), which the cumulative target shares
map to a source; ranking a source's slots gives each slot the block of that rank. A source's
documents are shuffled by the MD5 of their doc_id and laid end to end, MAX_EPOCHS times over:
its r-th block is words r * block to (r + 1) * block of that stream. The mix takes the words of
the blocks that some slot asks for, and nothing else: the schedule decides what is taken, and the golden
ratio keeps each source within a few blocks of its target in every stretch of the mix. Slots
past the end of a source's last epoch are empty. A source with a target that no point hits, as
one smaller than a block may be, gets one slot behind all others, which ends at its target.

Nothing runs in one task that grows with the table, its sources or a source: words are summed
over 4096 hash buckets a source, then within buckets; sources are ranked by ranges of their names;
slots by chunks. Rows that agree in doc_id, source and size are one run until they are dealt to blocks.

Null texts have size 0; the null source is a source, last in order; null doc_ids are like empty
ones in the shuffle; ties in it go by doc_id, then size; an empty table gives an empty result; rows that repeat
a doc_id are laid side by side, each its own row; extra columns are ignored, or kept by apply_mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import WORD, discard, materialised, packed, pinned, unpacked

WEIGHTS, SHARE, MAX_EPOCHS = (5.0, 2.0, 1.0), 1.5, 2
#: Most words of a block; slots that a mix has at least, where blocks get shorter instead.
BLOCK_WORDS, MIN_SLOTS = 512, 1 << 14
LEAST_CELLS, CHUNK = 1024, 1 << 16
GOLDEN = 0.6180339887498949
#: frac(2^20 / golden ratio), by which points of far slots keep their precision.
GOLDEN_FAR = 0.6555679417215288


def golden(slot: Column) -> Column:
    """Point of a slot in [0, 1)."""
    x = (slot % (1 << 20) + 1) * F.lit(GOLDEN) + F.floor(slot / (1 << 20)) * F.lit(GOLDEN_FAR)
    return x - F.floor(x)


def words(text: Column) -> Column:
    """Number of words, without an array of them: word ends are word characters before white space or the end."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "#")
    return F.length(F.regexp_replace(squeezed, "[^#]", "")).cast("long")


def block_length(total: int) -> int:
    """Words of a block in a mix of `total` words."""
    return max(1, min(BLOCK_WORDS, total // MIN_SLOTS))


def targets(sizes: DataFrame) -> DataFrame:
    """From source, source_size: source, source_size, i (rank by name), target, t (rounded) and the share interval [low, high).

    The level of a round is what full sources leave, by weight; a source whose cap lies below its
    share of it is full from then on. Rounds end when none is added. Two numbers a round, and two
    for each range of names, reach the driver.
    """
    spark = sizes.sparkSession
    ranged = materialised(sizes.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()))
    by_name = Window.partitionBy("part").orderBy("last", "source")
    upto = by_name.rowsBetween(Window.unboundedPreceding, 0)

    def starts(rows: DataFrame, value: str) -> DataFrame:
        held, at, out = sorted(rows.groupBy("part").agg(F.sum(value).cast("long").alias("n")).collect()), 0, []
        for part, n in held:
            out.append((part, at))
            at += n or 0
        return spark.createDataFrame(out, "part int, start long")

    s = ranged.withColumn("one", F.lit(1))
    s = s.join(starts(s, "one"), "part").withColumn("i", F.col("start") + F.row_number().over(by_name) - 1).drop("one", "start")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("i") % len(WEIGHTS) + 1).cast("int"))
    s = materialised(s.withColumns({"w": weight, "cap": F.col("source_size") * float(MAX_EPOCHS)}))
    discard(ranged)
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * SHARE
    level, full = 0.0, -1
    while True:
        is_full = F.col("cap") < F.lit(level) * F.col("w")
        r = s.agg(F.coalesce(F.sum(F.when(is_full, F.col("cap"))), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~is_full, F.col("w"))), F.lit(0.0)).alias("rest"), F.count_if(is_full).alias("n")).first()
        if r["n"] == full or not r["rest"]:
            break
        full, level = r["n"], (total - r["taken"]) / r["rest"]
    s = s.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("w")))
    s = s.withColumn("t", F.round("target").cast("long"))
    sums = starts(s, "t").withColumnRenamed("start", "before")
    mix = s.agg(F.sum("t")).first()[0] or 0
    s = s.join(sums, "part").withColumn("end", F.col("before") + F.sum("t").over(upto))
    whole = F.lit(max(mix, 1))
    return s.select("source", "source_size", "i", "target", "t", ((F.col("end") - F.col("t")) / whole).alias("low"), F.when(F.col("end") >= mix, 1.0).otherwise(F.col("end") / whole).alias("high"))


def schedule(sources: DataFrame, n_slots: int, n_sources: int, point=golden) -> DataFrame:
    """slot, i, rank: the source of each slot and the slot's rank among that source's, from 0.

    Points and intervals meet in cells, at least four to a source. Points being evenly spread, a
    cell holds its share of them, so all cells together make at most 1.25 rows a slot.
    """
    cells = max(LEAST_CELLS, 1 << (4 * max(n_sources, 1) - 1).bit_length())
    slots = sources.sparkSession.range(n_slots).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", point(F.col("slot"))).withColumn("cell", F.floor(F.col("point") * cells).cast("long"))
    cover = sources.filter(F.col("t") > 0).select("i", "low", "high")
    cover = cover.select("*", F.explode(F.sequence(F.floor(F.col("low") * cells).cast("long"), F.least(F.floor(F.col("high") * cells).cast("long"), F.lit(cells - 1)))).alias("cell"))
    owned = slots.join(cover, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "i", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = owned.groupBy("i", "chunk").count()
    base = counts.withColumn("base", F.sum("count").over(Window.partitionBy("i").orderBy("chunk")) - F.col("count")).select("i", "chunk", "base")
    inner = owned.withColumn("r", F.row_number().over(Window.partitionBy("i", "chunk").orderBy("slot")) - 1)
    return inner.join(base, ["i", "chunk"]).select("slot", "i", (F.col("base") + F.col("r")).alias("rank"))


def placed(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From doc_id, source, size: runs of equal rows (doc_id, source, size, n, offset in the source's stream, facts of the source), and the table of sources."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # Texts are read and counted once; the short rows are written to few files.
    runs = materialised(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3)).withColumn("span", F.col("size") * F.col("n")).hint("rebalance"))
    buckets = runs.groupBy("source", "bucket").agg(F.sum("span").alias("words"))
    sources = materialised(targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size"))))
    starts = buckets.withColumn("start", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).drop("words")
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    d = runs.withColumn("inner", F.sum("span").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("span"))
    facts = sources.select(F.col("source").alias("_of"), "source_size", "i", "target", "t")
    starts = starts.join(facts, starts["source"].eqNullSafe(facts["_of"])).drop("_of").withColumnsRenamed({"source": "_source", "bucket": "_bucket"})
    d = d.join(starts, d["source"].eqNullSafe(starts["_source"]) & (d["bucket"] == starts["_bucket"]))
    return d.select("doc_id", "source", "size", "n", (F.col("start") + F.col("inner")).alias("offset"), "source_size", "i", "target", "t"), sources


def pieces(sized: DataFrame, point=golden) -> DataFrame:
    """From doc_id, source, size: what the mix takes of each row, block by block.

    doc_id, source, size, source_size, target, copy (number of a row among its equals), epoch,
    slot and got (words). Rows of which nothing is taken have one piece with a null slot.
    """
    runs, sources = placed(sized)
    facts = sources.agg(F.sum("t"), F.count("*")).first()  # two numbers
    total, n_sources = facts[0] or 0, facts[1]
    block = block_length(total)
    n_slots = -(-total // block)
    slots = materialised(schedule(sources, n_slots, n_sources, point))
    missed = sources.filter("t > 0").join(slots.groupBy("i").agg(F.count("*").alias("slots")), "i", "left_anti")
    late = missed.select((F.lit(n_slots) + F.col("i")).alias("slot"), "i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t") - 1) / block))).alias("rank"), F.col("t").alias("until"))
    slots = slots.withColumn("until", F.lit(None).cast("long")).unionByName(late)
    # A run's copies come apart in two steps, so that no row makes more than CHUNK at once.
    few = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    rows = runs.withColumn("part", few).withColumn("copy", F.explode(F.sequence(F.col("part") * CHUNK, F.least(F.col("n"), (F.col("part") + 1) * CHUNK) - 1))).drop("part")
    at = lambda e: F.col("offset") + F.col("copy") * F.col("size") + e * F.col("source_size")
    epochs = F.array(*[F.struct(F.lit(e).alias("epoch"), at(e).alias("a"), (at(e) + F.col("size")).alias("b")) for e in range(MAX_EPOCHS)])
    cut = rows.withColumn("span", F.explode(epochs)).drop("offset", "n")
    cut = cut.withColumn("rank", F.explode(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("span.a") / block), F.floor((F.col("span.b") - 1) / block))).otherwise(F.array(F.lit(-1).cast("long")))))
    joined = cut.join(slots, ["i", "rank"], "left")
    end = F.least(F.col("span.b"), (F.col("rank") + 1) * block, F.coalesce("until", F.col("span.b")))
    got = F.when(F.col("slot").isNull(), 0).otherwise(F.greatest(end - F.greatest(F.col("span.a"), F.col("rank") * block), F.lit(0))).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", "copy", "span.epoch", "slot", got.alias("got"))


def mixed(docs: DataFrame, point=golden) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copy, taken, first_slot (null: nothing is taken)."""
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    p = pieces(sized, point)
    return p.groupBy("doc_id", "source", "size", "source_size", "target", "copy").agg(F.sum("got").alias("taken"), F.min(F.when(F.col("got") > 0, F.col("slot"))).alias("first_slot"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot."""
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix in the order of its slots: a row for each epoch that takes words of a document.

    A row stands where its first block does and has as many words as its blocks take, from the
    start of the text. Partitions follow one another by slot, and rows in them do. Rows that agree in doc_id, source
    and size share the plan of one of them. All columns are kept, whatever their names; n_chars follows the text.
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    p = pieces(sized).filter("copy = 0 and got > 0")
    plan = materialised(p.groupBy("doc_id", "source", "size", "epoch").agg(F.sum("got").alias("left"), F.min("slot").alias("slot")).hint("rebalance"))
    plan = plan.withColumnsRenamed({"doc_id": "p_id", "source": "p_source", "size": "p_size"})
    d = pinned(packed(docs, doc_id=F.col("doc_id"), source=F.col("source")), size=words(F.col("row.text")))
    d = d.join(plan, d["doc_id"].eqNullSafe(plan["p_id"]) & d["source"].eqNullSafe(plan["p_source"]) & (d["size"] == plan["p_size"]))
    # Slots are spread evenly over words, so equal ranges of them are equal shares of the mix.
    parts, most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan.agg(F.max("slot")).first()[0] or 0
    d = d.repartitionById(parts, F.floor(F.col("slot") * parts / (most + 1)).cast("int")).sortWithinPartitions("slot", "doc_id", "epoch")
    first = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("left").cast("int")), " ")
    d = pinned(d, mixed=F.when(F.col("left") == F.col("size"), F.col("row.text")).otherwise(first))
    return unpacked(d, docs.columns, text=F.col("mixed"), n_chars=F.length("mixed").cast("long"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
 s1 AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, {MAX_EPOCHS} * source_size::DOUBLE AS cap, {SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM s0),
 s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
 l AS (SELECT arg_min(level, cap / w) AS level FROM s2 WHERE cap > level * w),
 s3 AS (SELECT s2.source, s2.source_size, s2.i, least(s2.cap, coalesce((SELECT level FROM l) * s2.w, s2.cap)) AS target FROM s2),
 s4 AS (SELECT *, CAST(round(target) AS BIGINT) AS t, CAST(sum(CAST(round(target) AS BIGINT)) OVER () AS BIGINT) AS mix, CAST(sum(CAST(round(target) AS BIGINT)) OVER (ORDER BY i) AS BIGINT) AS e FROM s3),
 s AS (SELECT *, (e - t)::DOUBLE / greatest(mix, 1) AS low, CASE WHEN e >= mix THEN 1.0::DOUBLE ELSE e::DOUBLE / mix END AS high, greatest(1, least({BLOCK_WORDS}, mix // {MIN_SLOTS})) AS block FROM s4),
 n AS (SELECT max(block) AS block, (max(mix) + max(block) - 1) // max(block) AS slots FROM s),
 p AS (SELECT slot, x - floor(x) AS point FROM (SELECT slot, (slot % 1048576 + 1) * {GOLDEN}::DOUBLE + (slot // 1048576) * {GOLDEN_FAR}::DOUBLE AS x FROM (SELECT unnest(range((SELECT slots FROM n))) AS slot))),
 k AS (SELECT p.slot, s.i, row_number() OVER (PARTITION BY s.i ORDER BY p.slot) - 1 AS rank, CAST(NULL AS BIGINT) AS until FROM p JOIN s ON p.point >= s.low AND p.point < s.high AND s.t > 0),
 q AS (SELECT * FROM k UNION ALL SELECT (SELECT slots FROM n) + i, i, unnest(range((t + block - 1) // block)), t FROM s WHERE t > 0 AND i NOT IN (SELECT i FROM k)),
 o AS (SELECT d.doc_id, d.size, row_number() OVER () AS r, s.i, s.block, s.source_size, s.target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS o
   FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
 e AS (SELECT *, o + epoch * source_size AS a, o + epoch * source_size + size AS b FROM o CROSS JOIN range({MAX_EPOCHS}) AS x(epoch)),
 c AS (SELECT *, unnest(range(a // block, (b - 1) // block + 1)) AS rank FROM e WHERE size > 0),
 g AS (SELECT c.r, q.slot, greatest(0, least(c.b, (c.rank + 1) * c.block, coalesce(q.until, c.b)) - greatest(c.a, c.rank * c.block)) AS got FROM c JOIN q ON c.i = q.i AND c.rank = q.rank),
 f AS (SELECT r, CAST(sum(got) AS BIGINT) AS taken, min(slot) FILTER (WHERE got > 0) AS first_slot FROM g GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken, CAST(first_slot AS BIGINT) AS first_slot FROM o LEFT JOIN f USING (r)
"""
