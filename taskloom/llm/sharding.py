"""Longest-processing-time sharding of groups that must stay together.

Documents with equal texts form a group; a group's size is the sum of the sizes of its members, and
the size of a document is the bytes of its text plus one.  Groups go, largest first, to the shard with
the least load so far, taken from a heap.

The heap runs on the driver over the distinct *sizes* of groups, not over groups.  Distinct sizes add up to at most all bytes, so
of T bytes there are at most sqrt(2 T) of them: 250,000 for 30 GB and 14 million for 100 TB, however many groups there are.  Groups
of one size go to the shards in turns, so the schedule has a row or two for each size: the shards in the order in which they take the groups
of that size, over and over.  That is the exact schedule, as if each group had gone through the heap.

Ranks within a size and slots within a shard are numbered without bringing a size or shard into
one task: rows are numbered within (size, bucket) or (shard, bucket), and the buckets' offsets are sums
over the counts of the buckets before.

Cases: a null text is empty, so its size is 1, and belongs with the other empty texts; an empty table
gives an empty result; equal sizes are ordered by the text's digest; repeated and null ``doc_id`` as in
``common``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import documents, partitions, table, written

SHARDS = 16
#: Groups or rows that a bucket holds about.
BUCKET_ROWS = 20_000
#: Ranks of a size that meet its part of the schedule in one place.
STRETCH = 1 << 16


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """``(size, first rank, ranks, turns)`` from ``(size, groups)``, largest size first: the groups of those ranks go to the shards
    in ``turns``, one after the other and from the start again, each to the shard with the least load (of equal ones, the first).

    Shards whose loads differ by less than a group take turns in the order of their loads, and keep that order, until they
    reach the next shard's load.
    """
    heap = [(0, s) for s in range(shards)]
    for size, groups in sizes:
        rank = 0
        while rank < groups:
            heap.sort()
            level = sum(load - heap[0][0] < size for load, _ in heap)
            run = groups - rank
            if level < shards:  # full turns until the last of the level ones is no longer before the next shard
                run = min(run, level * -(-(heap[level][0] - heap[level - 1][0]) // size))
            turns = [s for _, s in heap[:level]]
            yield size, rank, run, turns[:run]
            heap[:level] = [(load + (run // level + (i < run % level)) * size, s) for i, (load, s) in enumerate(heap[:level])]
            rank += run


def numbered(rows: DataFrame, within: str, by: list[str], name: str) -> DataFrame:
    """Adds ``name``: a gapless number from 0 within each value of ``within``."""
    spark = rows.sparkSession
    buckets = max(partitions(spark), rows.count() // BUCKET_ROWS)
    rows = rows.withColumn("bucket_", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    counts = rows.groupBy(within, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(within).orderBy("bucket_")) - F.col("n_")
    own = F.row_number().over(Window.partitionBy(within, "bucket_").orderBy(*by)) - 1
    rows = rows.withColumn("own_", own).join(counts.withColumn("before_", before).drop("n_"), [within, "bucket_"])
    return rows.withColumn(name, (F.col("before_") + F.col("own_")).cast("long")).drop("bucket_", "own_", "before_")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every document."""
    spark = docs.sparkSession
    rows = documents(docs).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    rows = written(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    groups = written(numbered(groups, "bytes", ["digest"], "rank").withColumn("stretch", F.floor(F.col("rank") / STRETCH)), "groups")
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("bytes", ascending=False)  # bounded: see above
    turns = pd.DataFrame(schedule(zip(sizes["bytes"].tolist(), sizes.n.tolist(), strict=True), shards), columns=["bytes", "first", "ranks", "turns"])
    turns = spark.createDataFrame(turns, "bytes long, first long, ranks long, turns array<int>")
    last = F.col("first") + F.col("ranks") - 1
    turns = turns.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor(last / STRETCH))))
    placed = groups.join(turns, ["bytes", "stretch"]).where(F.col("rank").between(F.col("first"), last))
    turn = F.pmod(F.col("rank") - F.col("first"), F.size("turns")).cast("int")
    placed = placed.select("digest", F.element_at("turns", turn + 1).alias("shard"))
    return numbered(rows.join(placed, "digest").drop("digest"), "shard", ["doc_id"], "slot")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
