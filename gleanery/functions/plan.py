"""Help with query plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    The optimizer copies a projected expression into every place that names it, a
    lambda body included. A generator over a one-element array stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
