"""What several operators share: table reading, checkpoints and written tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.plan import pinned

__all__ = ["WORD", "checkpoint_folder", "discard", "materialised", "packed", "pinned", "remove_at_exit", "table", "unpacked"]

#: A word, as all contracts define it: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of docs as one struct, `row`, beside the given ones: no name of a user's column can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of a packed table again, some of them replaced."""
    return rows.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in columns])


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    In local mode a session that names none, as in tests, gets a folder of its own. On a cluster
    that is an error, for executors on other machines could not read it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gleanery-checkpoint-"))
    return context.getCheckpointDir()


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove what was written when the driver's JVM ends."""
    place, files = _place(spark, path)
    files.deleteOnExit(place)


def materialised(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write a table into the checkpoint folder and read it again: lineage ends there.

    Columns stay compressed, unlike in a checkpoint. The files go when discard() is called or the
    driver's JVM ends. Shuffles that no live plan needs are given back at once. narrow: for tables of a
    few numbers a row, written by two tasks a core at most. On local disks each file costs its executor two processes that set permissions.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for t in tables:
        place, files = _place(t.sparkSession, t.written_at)
        files.delete(place, True)
