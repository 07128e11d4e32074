"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

A word is a maximal run of a-z, digits and characters beyond ASCII, after A-Z have been lower-cased.  A
window is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window.

1. The frequency of each benchmark term is counted over all documents.
2. Of each window the ``RAREST`` rarest positions are its *probe*; neighbouring windows mostly share
   one.  Postings (term, document, position) are read from the texts for the terms of probes; they are not kept, and each pass reads the texts anew.
3. A probe's lists, each shifted by the term's offset in the item, are intersected: what is left are
   (item, document, shift) triples where all of the probe's terms stand at their places.
4. For the documents of such triples the postings of all benchmark terms are intersected in the same way,
   shifted by each triple, which gives the item words that stand at their places; runs of ``size`` of them
   (or whole short items) are exact phrase matches.

Frequent terms meet only where a window has no rarer ones, and every join is an equi-join on term,
document or position, so a passage that a third of all documents hold is spread over all tasks.
The item side of joins is broadcast only if it was counted and has at most ``BROADCAST_ROWS`` rows.

``proximity`` answers queries with a slop from the same postings: all terms of an item within a
span of at most ``within`` words of a document, in any order.

Cases: null and empty texts have no words; documents without words are returned with zero counts; repeated and null
``doc_id`` as in ``common``; items that repeat an ``item_id`` each count as texts of that item, and
items with a null ``item_id`` take no part; either table may be empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import documents, table, written

SIZE, RAREST = 10, 3
#: Rows of a join's item side (some 100 bytes each at most) up to which it is broadcast.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def small(df: DataFrame) -> DataFrame:
    """The rows written down, and broadcast in joins if they are few."""
    df = written(df, "items")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_words(benchmark: DataFrame) -> DataFrame:
    """``part, item_id, term, off, n``: part tells apart texts that share an item_id."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).distinct().withColumn("part", F.xxhash64("item_id", "w"))
    return items.select("part", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("off", "term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, doc_id, pos`` of the given terms."""
    return docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(terms, "term")


def probes(items: DataFrame, frequency: DataFrame, size: int, rarest: int) -> DataFrame:
    """``probe, part, off, term, k``: the k rarest positions of each window, distinct."""
    counted = items.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    reach = F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - size + 1), F.least(F.col("off"), F.greatest(F.lit(0), F.col("n") - size))))
    by_rank = Window.partitionBy("part", "win").orderBy("df", "off")
    near = counted.select("part", "off", "term", "df", reach.alias("win")).withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= rarest)
    found = near.groupBy("part", "win").agg(F.array_sort(F.collect_list(F.struct("off", "term"))).alias("at"), F.min("df").alias("least"))
    found = found.where("least > 0").select("part", "at").distinct()  # a term that no document has rules the window out
    return found.select("part", F.xxhash64("part", "at").alias("probe"), F.size("at").alias("k"), F.explode("at").alias("x")).select("probe", "part", "k", "x.off", "x.term")


def aligned(docs: DataFrame, items: DataFrame, size: int, rarest: int) -> DataFrame:
    """``part, doc_id, shift``: where all terms of one of the part's probes stand at their places."""
    terms = small(items.select("term").distinct())
    occurring = docs.select(F.explode(words(F.col("text"))).alias("term")).join(terms, "term")
    frequency = occurring.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    probe = small(probes(items, frequency, size, rarest))
    rare = small(probe.select("term").distinct())
    hits = postings(docs, rare).join(probe, "term").select("probe", "part", "k", "doc_id", (F.col("pos") - F.col("off")).alias("shift"))
    hits = hits.groupBy("probe", "part", "k", "doc_id", "shift").agg(F.count(F.lit(1)).alias("n")).where("n = k")
    return hits.select("part", "doc_id", "shift").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, rarest: int = RAREST) -> DataFrame:
    """``item_id, doc_id, start, length``: maximal runs of matching words that hold a window; every
    word of a run is in an occurring window.  ``docs`` has doc_id and text."""
    items = written(item_words(benchmark), "items")
    places = written(aligned(docs, items, size, rarest), "places")
    held = docs.join(places.select("doc_id").distinct(), "doc_id", "left_semi")
    terms = small(items.select("term").distinct())
    expected = places.join(small(items), "part").select("part", "item_id", "n", "doc_id", "shift", "off", "term", (F.col("shift") + F.col("off")).alias("pos"))
    met = expected.join(postings(held, terms), ["doc_id", "pos", "term"])
    run = Window.partitionBy("part", "doc_id", "shift").orderBy("off")
    runs = met.withColumn("run", F.col("off") - F.row_number().over(run)).groupBy("part", "item_id", "n", "doc_id", "shift", "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= F.least(F.col("n"), F.lit(size))).select("item_id", "doc_id", "start", "length").distinct()


def proximity(docs: DataFrame, benchmark: DataFrame, within: int) -> DataFrame:
    """``item_id, doc_id, start, end``: the earliest stretches of at most ``within`` words that hold every
    distinct term of the item, in any order, one for each position where such a stretch ends first."""
    docs = documents(docs)
    items = written(item_words(benchmark).select("part", "item_id", "term").distinct(), "items")
    needed = items.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    listed = postings(docs, small(items.select("term").distinct())).join(small(items.join(needed, "part")), "term")
    back = Window.partitionBy("part", "doc_id").orderBy("pos").rangeBetween(1 - within, 0)
    seen = listed.withColumn("terms", F.size(F.collect_set("term").over(back))).withColumn("start", F.min("pos").over(back))
    return seen.where("terms = k").select("item_id", "doc_id", "start", F.col("pos").alias("end")).distinct()


def hit_words(found: DataFrame) -> DataFrame:
    """``doc_id, n_hit``: words covered by any of the matches of a document."""
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc_id", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.col("start")))
    return spans.select("doc_id", F.greatest(F.lit(0), F.col("end") - reached).alias("new")).groupBy("doc_id").agg(F.sum("new").alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids`` for every document."""
    docs = documents(docs)
    found = written(matches(docs, benchmark, size), "matches")
    names = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    counted = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(hit_words(found).join(names, "doc_id"), "doc_id", "left")
    none = F.array().cast("array<string>")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids")).withColumn("n_items", F.size("item_ids").cast("long"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, lens WHERE len(w) >= n)
), m AS (
  SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""
