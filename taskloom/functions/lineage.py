"""Cutting lineage: a table written in the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Set to false while a table is written: rows that lie by recording are joined where they are, by recording and frame too, without a further shuffle.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that isn't set and all tasks run in this process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-taskloom-"))
        named = _OWN[0]
    return named.rstrip("/")


def kept(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows, computed now and once; what is built on them plans from a scan and survives lost executors.  With ``by`` they are written in as many buckets of that column as a
    shuffle has parts, and what groups, orders or joins them by it (and others) reads them where they lie: rows that lie so already are not shuffled again, neither here nor later."""
    spark = df.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(ALL_KEYS, "true")
    spark.conf.set(ALL_KEYS, "false")
    try:
        writer = df.write.option("compression", "zstd")
        if by:
            writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(name, format="parquet")
        else:
            writer.parquet(path)
    finally:
        spark.conf.set(ALL_KEYS, before)
    return spark.table(name) if by else spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """The rows, joined by sorting and never by broadcast.  Spark sizes a table by its compressed files and counts an exploded array as one element, so rows of frames look many times smaller than
    they are, and a table that looks fit for a broadcast can fill the driver.  What is derived from these rows, by all but joins, is joined so too."""
    return df.hint("merge")
