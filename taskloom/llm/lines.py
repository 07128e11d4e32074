"""Line deduplication: ranks of line sequences by distributed prefix doubling, as deep as the windows of a suffix array need.

Lines are the parts of a text between newlines; the words of a line are its runs of characters other than ASCII white
space.  A *repeated run* is a run of lines with at least ``min_words`` words in all that stands earlier as well (at a smaller doc_id,
or in the same document above).  All lines of repeated runs are deleted, so the first copy stays: a single line of a few words, and
a passage of many lines to its last.  Lines without words are no content: they neither count nor break a run, and go if
they stand between two deleted lines.

1. Lines get ranks: the distinct lines that occur twice or more, numbered in order of their 128-bit hashes by a distributed
   sort.  All other lines end every common prefix and are dropped.
2. Prefix doubling: the rank of the 2h lines from a line on is the rank of the pair (rank of h lines there, rank of h
   lines further on), numbered by a distributed sort again.  Pairs that occur once are dropped: such suffixes have their place.
3. A *window* is the shortest run from a line on that has ``min_words`` words.  Suffixes whose common prefix reaches over the window are an
   interval of the suffix array: they have equal ranks of the largest power of two lines from either end of the window.
   Doubling ends when no window is longer, as common prefixes beyond a window are made of the windows that begin in it.
4. An interval's first place is kept, and all others are repeats.  Those are followed beyond their window, line by line, until
   the lines there have enough words to be a window themselves.  What the windows and tails cover are the maximal runs.

Ranks are assigned to distinct values and joined back, so a line that a third of all documents share is one value, aggregated
before the shuffle; its places are dealt to many tasks (``dealt_join``).

Cases: null and empty texts are one empty line and stay; repeated and null ``doc_id`` as in ``common``; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import dealt_join, documents, partitions, raw, signed, steps, table, word_hashes, words, written

#: Words of the shortest run that is deleted: a single line of a few words is one.
MIN_WORDS = 3


def line_list(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, line, x, y, need, n`` of the lines with words, numbered without the others: their hashes, the lines of their windows, 0 if
    the text ends before, and their words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, offsets = raw(batch.column("text"))
            rows = batch.num_rows
            breaks = np.flatnonzero(data == 10)
            start = np.sort(np.r_[offsets[:-1], breaks + 1])
            own = np.sort(np.r_[np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
            end = np.sort(np.r_[offsets[1:], breaks])
            word_start, _, _ = words(data, offsets)
            before = np.searchsorted(word_start, np.r_[start, len(data)])  # words that begin before each line
            full = np.diff(before) > 0
            start, end, own, before = start[full], end[full], own[full], np.r_[before[:-1][full], before[-1]]
            first = np.searchsorted(own, np.arange(rows))
            line = np.arange(len(own)) - first[own]
            total = np.r_[before[first[1:]], before[-1]][own]  # by the text's end
            reach = before[:-1] + min_words
            last = np.searchsorted(before, reach) - 1  # the line in which the window's last word begins
            need = np.where(reach <= total, last - np.arange(len(own)) + 1, 0)
            x, y = (word_hashes(data, start, end, base) for base in (0, 1))
            columns = [batch.column("doc_id").take(pa.array(own)), pa.array(line.astype(np.int32)), pa.array(signed(x)), pa.array(signed(y)), pa.array(need.astype(np.int32)), pa.array(np.diff(before).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "x", "y", "need", "n"])

    return docs.mapInArrow(split, "doc_id long, line int, x long, y long, need int, n int")


def in_order(values: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds ``name`` to distinct rows: their numbers in order of ``by``.

    Rows are range-partitioned by all of ``by`` and numbered within their part; a part's numbers begin where those of the parts
    before end.  The parts are written first, so that both refer to the same ones.
    """
    spark = values.sparkSession

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        for frame in frames:
            yield frame.assign(part_=part, own_=np.arange(n, n + len(frame), dtype=np.int64))
            n += len(frame)

    ordered = values.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    ordered = written(ordered.mapInPandas(number, ", ".join(f"{c} long" for c in by) + ", part_ int, own_ long"), "ordered")
    sizes = ordered.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))  # a row for each partition
    sizes = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    return ordered.join(F.broadcast(sizes), "part_").select(*by, (F.col("before_") + F.col("own_")).alias(name))


def ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds ``name``: the rank of the values of ``by`` among those that occur twice or more; other rows go."""
    several = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
    return rows.join(in_order(several, by, name), by)


def doubled(lines: DataFrame) -> tuple[DataFrame, int]:
    """The lines that can be in a repeated window, with their ranks ``r0``, ``r1``, ...: of 1, 2, ... lines from there on,
    null if those occur once or not all of them recur.  Also the number of rank columns."""
    rows = ranked(lines, ["x", "y"], "r0").drop("x", "y")
    unbroken = Window.partitionBy("doc_id").orderBy("line")
    rows = rows.withColumn("run", F.col("line") - F.row_number().over(unbroken))
    after = Window.partitionBy("doc_id", "run").orderBy(F.col("line").desc())
    rows = rows.withColumn("left", F.row_number().over(after))  # lines of the run from this one on
    rows = written(rows.withColumn("need", F.when(F.col("need") <= F.col("left"), F.col("need")).otherwise(0)).drop("left"), "ranks")
    longest = rows.agg(F.max("need")).first()[0] or 0
    k = 0
    while 2 << k <= longest:
        ahead = F.lead(f"r{k}", 1 << k).over(Window.partitionBy("doc_id", "run").orderBy("line"))
        pairs = written(rows.withColumn("next", ahead).select("doc_id", "line", F.col(f"r{k}").alias("here"), "next").where("here is not null and next is not null"), "pairs")
        new = ranked(pairs, ["here", "next"], f"r{k + 1}").select("doc_id", "line", f"r{k + 1}")
        rows = written(rows.join(new, ["doc_id", "line"], "left"), "ranks")
        k += 1
    return rows, k + 1


def window_ranks(rows: DataFrame, levels: int) -> DataFrame:
    """``doc_id, line, need, a, b`` of the windows that can be repeated; equal need, a and b mean equal contents."""
    level = F.coalesce(*(F.when(F.col("need") < 2 << k, k) for k in range(levels)))
    rank = F.coalesce(*(F.when(F.col("level") == k, F.col(f"r{k}")) for k in range(levels)))
    window = rows.where("need > 0").withColumn("level", level).select("doc_id", "line", "need", "level", rank.alias("a"))
    window = window.where("a is not null").withColumn("upto", F.expr("cast(line + need - shiftleft(1, level) as int)"))
    every = rows.select("doc_id", F.col("line").alias("upto"), *(f"r{k}" for k in range(levels)))
    return window.join(every, ["doc_id", "upto"]).select("doc_id", "line", "need", "a", rank.alias("b")).where("b is not null")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, line, need``: from each window that stands earlier, the longest run of lines that stands earlier.

    A run is cut into its window and a tail.  Tails need not be followed over ``min_words`` words: from there on a window begins that
    stands earlier too.  All copies of a window, the first as well, list the beginnings of their tails; of equal ones all but the
    first place are repeats.
    """
    rows, levels = doubled(line_list(docs, min_words))
    place, content = ["doc_id", "line"], ["need", "a", "b"]
    window = window_ranks(rows, levels)
    several = window.groupBy(*content).agg(F.min(F.struct(*place)).alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    window = dealt_join(window, written(several, "several"), content, "copies", "doc_id")
    window = written(window.withColumn("again", F.struct(*place) != F.col("f")).drop("f"), "windows")
    ahead = Window.partitionBy("doc_id", "run").orderBy("line").rowsBetween(0, max(0, min_words - 2))  # a line has a word at least
    tails = rows.select("doc_id", F.col("line").alias("upto"), F.col("n").alias("n_"), F.collect_list(F.struct("r0", "n")).over(ahead).alias("next")).where(F.col("n_") < min_words)
    window_end = window.withColumn("upto", F.col("line") + F.col("need"))
    longer = window_end.join(tails, ["doc_id", "upto"]).withColumn("t", F.explode(F.sequence(F.lit(1), F.size("next"))))
    longer = longer.withColumn("tail", F.slice("next", F.lit(1), F.col("t"))).where(F.aggregate("tail", F.lit(0), lambda s, x: s + x.n) < min_words)
    longer = longer.select(*place, *content, "t", F.transform("tail", lambda x: x.r0).alias("tail"), "again")
    equal = longer.groupBy(*content, "tail").agg(F.min(F.struct(*place)).alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    longer = longer.where("again").join(equal.drop("copies"), [*content, "tail"]).where(F.struct(*place) != F.col("f"))
    longer = longer.groupBy(*place).agg(F.max("t").alias("t"))
    found = window.where("again").select(*place, "need").join(longer, place, "left")
    return found.select(*place, (F.col("need") + F.coalesce("t", F.lit(0))).alias("need"))


def runs(windows: DataFrame) -> DataFrame:
    """``doc_id, start, upto``: the maximal runs that the windows cover."""
    in_order = Window.partitionBy("doc_id").orderBy("line")
    before = F.max(F.col("line") + F.col("need")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("line") > before).cast("int"), F.lit(1))
    numbered = windows.withColumn("new", new).withColumn("run", F.sum("new").over(in_order))
    return numbered.groupBy("doc_id", "run").agg(F.min("line").alias("start"), F.max(F.col("line") + F.col("need")).alias("upto")).drop("run")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` of every document, its repeated runs deleted."""
    docs = documents(docs)
    return deleted(docs, repeats(docs, min_words))


def deleted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without the runs, which number the lines that have words."""
    gone = runs(found).groupBy("doc_id").agg(F.collect_list(F.struct("start", "upto")).alias("gone"))

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            lines, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                own = text.split("\n")
                lines.append(len(own))
                at = [i for i, x in enumerate(own) if x.strip(" \t\n\v\f\r")] if spans else []
                for span in sorted(spans or (), key=lambda x: -x["start"]):
                    del own[at[span["start"]] : at[span["upto"] - 1] + 1]
                removed.append(lines[-1] - len(own))
                kept.append("\n".join(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "text"])

    return docs.join(gone, "doc_id", "left").mapInArrow(delete, "doc_id long, n_lines long, n_removed long, text string")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL
), x AS (
  SELECT doc_id, i, ls[i] AS s, len(list_filter(string_split_regex(ls[i], '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)
), f AS (
  SELECT doc_id, i, s, n, row_number() OVER d AS p, lead(i) OVER d AS i2, lead(s) OVER d AS s2, lead(n) OVER d AS n2, lead(s, 2) OVER d AS s3
  FROM x WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), r AS ( -- a run of three words or more is made of such runs of at most three lines, as each line has a word
  SELECT doc_id, p, 1 AS k, s AS c FROM f WHERE n >= 3
  UNION ALL SELECT doc_id, p, 2, s || chr(10) || s2 FROM f WHERE n + n2 >= 3
  UNION ALL SELECT doc_id, p, 3, s || chr(10) || s2 || chr(10) || s3 FROM f WHERE s3 IS NOT NULL
), again AS (
  SELECT doc_id, p, k FROM (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY doc_id, p) AS place FROM r) WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS p FROM again
), marked AS (
  SELECT f.doc_id, f.i, f.i2, lead(gone.p) OVER (PARTITION BY f.doc_id ORDER BY f.p) = f.p + 1 AS on_, gone.p IS NOT NULL AS out FROM f LEFT JOIN gone ON gone.doc_id = f.doc_id AND gone.p = f.p
), lost AS (
  SELECT doc_id, list(i) AS ps FROM (SELECT doc_id, unnest(CASE WHEN on_ THEN range(i, i2) ELSE [i] END) AS i FROM marked WHERE out) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ls ELSE list_filter(ls, lambda s, i: NOT list_contains(ps, i)) END, chr(10))) AS kept_sha256
FROM l LEFT JOIN lost ON lost.doc_id = l.doc_id
"""
