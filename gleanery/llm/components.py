"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import discard, materialised


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): node, label, where label is the least node that it reaches.

    Each round takes the least label among a node's neighbours, then the label's own label, so
    that chains halve. Rounds end when no label changes. Null ends are dropped. Nothing but a
    count reaches the driver; each round's labels are a written table, which the next but one removes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null and a <> b").distinct()
    both = materialised(both, narrow=True)
    labels = materialised(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), narrow=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
        new = materialised(jumped.select("node", "old", F.least("label", "far").alias("label")), narrow=True)
        if new.filter("label <> old").isEmpty():
            discard(new, both)
            return labels
        discard(labels)
        written, labels = new.written_at, new.select("node", "label")
        labels.written_at = written
