"""Sources and sinks: Parquet tables, uploaded files, JSON reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite", compression: str | None = None) -> None:
    """Write a table, partitioned where a column is named; Spark commits it as a whole. compression: null is the session's.

    Mode `replace` overwrites only the partitions that df has rows of.
    """
    w = df.write.mode("overwrite" if mode == "replace" else mode)
    if mode == "replace":
        w = w.option("partitionOverwriteMode", "dynamic")
    if compression:
        w = w.option("compression", compression)
    (w.partitionBy(partition) if partition else w).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: the checkpoint folder, or in local mode, where the session names none, one of our own."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        shared = tempfile.mkdtemp(prefix="gleanery-") if context.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/gleanery-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.deleteOnExit(place)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _files(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """A table written to the scratch folder and read again, for results that several steps use: what made it runs once, and executors may go."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: it changes when they do."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(place)
    rows = [f for x in (files or []) for f in ([x] if x.isFile() else x.getPath().getFileSystem(context._jsc.hadoopConfiguration()).listStatus(x.getPath()))]
    return ";".join(sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in rows))


def uploads(spark: SparkSession, glob: str) -> DataFrame:
    """document_id, content of files."""
    return spark.read.format("binaryFile").load(glob).selectExpr("path as document_id", "length as size_bytes", "content")


def texts(files: DataFrame, extract: Callable[[bytes], str]) -> DataFrame:
    """document_id, text with form feeds between pages, by a pluggable extractor."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame({"document_id": x["document_id"], "text": [extract(c) for c in x["content"]]})

    return files.mapInPandas(run, "document_id string, text string")


def report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)  # a report is a few rows
