"""Dense codes of distinct values, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.lineage import kept


def coded(rows: DataFrame, column: str, code: str = "code") -> DataFrame:
    """``column, code, rows``: the distinct values, numbered from 0 in their order (null first), and how many rows have each.

    Values are range-partitioned and sorted within their part; a part's codes begin where those of the parts before end.  So the codes don't depend on how
    the rows lie, and only a number for each part meets in one task."""
    spark = rows.sparkSession
    values = rows.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    first = F.col(column).asc_nulls_first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = kept(values.repartitionByRange(parts, first).sortWithinPartitions(first).withColumn("at_", F.monotonically_increasing_id()))
    values = values.withColumn("part_", F.shiftright("at_", 33))
    sizes = values.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("part_", before.alias("before_")))  # a row for each part
    return values.join(starts, "part_").select(column, (F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1)).alias(code), "rows")
