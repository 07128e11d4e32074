"""How far the sources of each language lie apart in their words, exactly, in integers.

A group is a language and a source.  With N occurrences of the language's V kept terms (those in at least ``LEAST`` of its documents) a group gives a term
that it has c times the share ``p = 1 + floor(10^9 (c + 1) / (N + V))``; the divergence of share p from q is ``floor((p - q)^2 / q)``.

1. Terms are counted by document in Arrow batches (each distinct term is hashed once a batch, by its bytes) and summed by language, source and term.
2. A kept term is *heavy* if it is in over a quarter of the language's sources, or in over ``MOST`` of them, else *light*.
3. Heavy terms are dealt to blocks of about ``TERMS``, sources to blocks of ``SOURCES``: a dense numpy tile has a count for each of both.  Two tiles of a block of terms
   give the partial sums of all their pairs of sources.
4. Light terms add to each pair of sources what it would be if neither had any, plus corrections: one for each source that has the term, against every
   other source as one that lacks it (from a histogram of the source's counts), and one for each pair of sources in the term's posting list, which is short.
5. The partial sums are integers and are added up by pair.

No group is collected: a tile is bounded by its blocks, a posting list by ``MOST``, a histogram's part by ``SPAN``.  What is sent to every task is bounded
by a count of its rows.  A pair of sources is a row of the result; only such pairs are formed, and always in blocks.

Cases: null texts, languages and sources are empty ones; every row of the table is a document, also where an id is repeated or null; a group without terms is
compared like any other; a language without kept terms gives pairs of value 0 and no terms; a language with one source has no pairs; an empty table
gives an empty result; further columns are ignored.  Totals up to 9 * 10^15 are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import FEW_IDS, lower_ascii, raw, runs, steps, table, written

LEAST, TOP = 3, 200
#: A light term's posting list, terms and sources of a tile, counts of a histogram's part.
MOST, TERMS, SOURCES, SPAN = 64, 1024, 256, 4096
#: Pairs of one vectorised step, and bytes of text.
PAIRS, BYTES = 1 << 20, 1 << 23
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in each group and the documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=BYTES):
            data, offsets = raw(batch.column("text"))
            inside = LETTER[data]
            start, end, row = runs(inside, offsets)
            letters, ends = lower_ascii(data)[inside], np.r_[0, np.cumsum(end - start)]
            words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])
            coded = words.dictionary_encode()
            size = max(1, len(coded.dictionary))
            once, n = np.unique(row.astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)  # a term of a document
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key = group[once // size] * size + once % size
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            key, total, docs_ = key[first], np.add.reduceat(n[order], first) if len(first) else n, np.diff(np.r_[first, len(order)])
            of, term = key // size, pa.array(key % size)
            columns = [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), coded.dictionary.take(term).cast(pa.binary()).cast(pa.string()), pa.array(total), pa.array(docs_)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    found = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 (count + 1) / (total + vocabulary))``, three digits at a time, so that nothing overflows."""
    whole = np.maximum(1, total + vocabulary)
    rest, out = count + 1, np.zeros_like(whole)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def shared(count: Column, total: Column, vocabulary: Column) -> Column:
    """The same of columns."""
    whole = F.greatest(F.lit(1).cast("long"), total + vocabulary)
    over = lambda x: F.call_function("div", x, whole)
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + over(rest), rest % whole
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def summed(rows: dict[str, np.ndarray], langs: pa.Array) -> pa.RecordBatch:
    """Values added up by (lang, a, b); ``lang`` holds places in ``langs``."""
    lang, a, b, value = rows["lang"], rows["a"], rows["b"], rows["value"]
    order = np.lexsort((b, a, lang))
    lang, a, b, value = lang[order], a[order], b[order], value[order]
    new = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    value = np.add.reduceat(value, new) if len(new) else value
    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang[new])), pa.array(a[new]), pa.array(b[new]), pa.array(value)], names=["lang", "a", "b", "value"])


SUMS = "lang string, a long, b long, value long"


def few(rows: DataFrame, most: int = FEW_IDS) -> DataFrame:
    """Sent to every task if it has few rows."""
    return F.broadcast(rows) if rows.count() <= most else rows


def blocks_of(groups: DataFrame, wide: int) -> DataFrame:
    """``lang, block, sids, totals`` of up to ``wide`` groups each."""
    per = groups.groupBy("lang", F.expr(f"sid div {wide}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("sid", "total"))).alias("x"))
    return per.select("lang", "block", F.col("x.sid").alias("sids"), F.col("x.total").alias("totals"))


def dense(posts: DataFrame, terms: DataFrame, groups: DataFrame, blocks: DataFrame, wide: int) -> DataFrame:
    """Partial sums of the heavy terms: tiles of counts, a pair of tiles at a time."""

    def tile(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        width, sid, n = rows.column("width")[0].as_py(), rows.column("sid"), rows.column("n")
        there = np.flatnonzero(numbers(pc.is_valid(sid).combine_chunks()))
        counts = np.zeros((wide, width), np.int64)
        counts[numbers(sid.take(pa.array(there)).combine_chunks()) % wide, numbers(rows.column("slot").take(pa.array(there)).combine_chunks())] = numbers(n.take(pa.array(there)).combine_chunks())
        used = int(counts.any(1).nonzero()[0].max(initial=-1)) + 1
        return pa.table({"lang": rows.column("lang")[:1], "part": rows.column("part")[:1], "block": rows.column("block")[:1], "width": [width], "counts": [counts[:used].tobytes()]})

    spine = terms.select("lang", "part", "width").distinct().join(blocks.select("lang", "block"), "lang")
    none = F.lit(None).cast("long")
    rows = spine.select("lang", "part", "block", "width", none.alias("slot"), none.alias("sid"), none.alias("n"))
    rows = rows.unionByName(posts.select("lang", "part", F.expr(f"sid div {wide}").alias("block"), "width", "slot", "sid", "n"))
    tiles = written(rows.groupBy("lang", "part", "block").applyInArrow(tile, "lang string, part long, block long, width long, counts binary"), "tiles")
    named = few(blocks, 4096)
    left = tiles.join(named, ["lang", "block"]).select("lang", "part", "width", "sids", "totals", "counts")
    right = tiles.join(named, ["lang", "block"]).select("lang", "part", F.col("sids").alias("sids_"), F.col("totals").alias("totals_"), F.col("counts").alias("counts_"))
    v = few(groups.groupBy("lang").agg(F.first("v").alias("v")))
    pairs = left.join(right, ["lang", "part"]).join(v, "lang")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: E731, B023
                width, v = get("width"), get("v")
                sides = []
                for end in ("", "_"):
                    totals = np.array(get(f"totals{end}"), np.int64)
                    held = np.frombuffer(get(f"counts{end}"), np.int64).reshape(-1, width)
                    counts = np.zeros((len(totals), width), np.int64)
                    counts[: len(held)] = held
                    sides.append(share(counts, totals[:, None], np.int64(v)))
                p, q = sides
                a, b = np.array(get("sids"), np.int64), np.array(get("sids_"), np.int64)
                value = np.stack([apart(x, q).sum(1) for x in p]).ravel()
                a, b = np.repeat(a, len(b)), np.tile(b, len(a))
                off = a != b
                yield pa.RecordBatch.from_arrays([pa.array([get("lang")] * int(off.sum()), pa.string()), pa.array(a[off]), pa.array(b[off]), pa.array(value[off])], names=["lang", "a", "b", "value"])

    return pairs.mapInArrow(sums, SUMS)


def together(posts: DataFrame) -> DataFrame:
    """Corrections of light terms for pairs of sources that both have the term."""
    lists = posts.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "n", "total")).alias("x"), F.first("v").alias("v")).where("size(x) > 1")
    lists = lists.select("lang", "v", F.col("x.sid").alias("sid"), F.col("x.n").alias("n"), F.col("x.total").alias("total"))

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            lang, v = numbers(langs.indices), numbers(batch.column("v"))
            size = numbers(pc.list_value_length(batch.column("sid")))
            first = np.cumsum(size) - size
            sid, n, total = (numbers(batch.column(c).flatten()) for c in ("sid", "n", "total"))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for k in np.unique(size):
                every, at = np.flatnonzero(size == k), np.arange(k)
                i, j = np.nonzero(at[:, None] != at)
                for cut in range(0, len(every), max(1, PAIRS // (k * k))):
                    some = every[cut : cut + max(1, PAIRS // (k * k))]
                    place = first[some][:, None] + at
                    p, z = share(n[place], total[place], v[some][:, None]), share(np.zeros_like(place), total[place], v[some][:, None])
                    value = apart(p[:, i], p[:, j]) - apart(p[:, i], z[:, j]) - apart(z[:, i], p[:, j]) + apart(z[:, i], z[:, j])
                    found = summed({"lang": np.repeat(lang[some], len(i)), "a": sid[place][:, i].ravel(), "b": sid[place][:, j].ravel(), "value": value.ravel()}, pa.array(np.arange(len(langs.dictionary))))
                    for held, c in zip(out, ("lang", "a", "b", "value"), strict=True):
                        held.append(numbers(found.column(c)))
            if out[0]:
                yield summed(dict(zip(("lang", "a", "b", "value"), map(np.concatenate, out), strict=True)), langs.dictionary)

    return lists.mapInArrow(correct, SUMS)


def apiece(posts: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of the light terms: what each pair of sources has if neither holds a term, and the corrections for each source's own terms."""
    own = ["lang", "sid", "total", "v", "light"]
    counts = posts.groupBy(*own, "n").agg(F.count(F.lit(1)).alias("times"))
    parts = counts.groupBy(*own, F.expr(f"n div {SPAN}").alias("span")).agg(F.collect_list(F.struct("n", "times")).alias("x"))
    parts = parts.select(*own, F.col("x.n").alias("n"), F.col("x.times").alias("times"))
    none = F.lit(None).cast("array<long>")
    rows = groups.select(*own, none.alias("n"), none.alias("times")).unionByName(parts)
    rows = rows.join(few(blocks.select("lang", "sids", "totals"), 4096), "lang")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, v, b = row["sid"], np.int64(row["v"]), np.array(row["sids"], np.int64)
                mine, others = np.array([row["total"]], np.int64), np.array(row["totals"], np.int64)
                z, far = share(np.zeros(1, np.int64), mine, v), share(np.zeros(len(b), np.int64), others, v)
                if row["n"] is None:
                    ahead, back = row["light"] * apart(z, far), None
                else:
                    p, times = share(np.array(row["n"], np.int64), mine, v)[:, None], np.array(row["times"], np.int64)[:, None]
                    ahead = (times * (apart(p, far) - apart(z, far))).sum(0)
                    back = (times * (apart(far, p) - apart(far, z))).sum(0)
                off = b != a
                for x, y, value in ((np.full(len(b), a), b, ahead), (b, np.full(len(b), a), back)):
                    if value is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * int(off.sum()), pa.string()), pa.array(x[off]), pa.array(y[off]), pa.array(value[off])], names=["lang", "a", "b", "value"])

    return rows.mapInArrow(sums, SUMS)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = MOST, terms_a_tile: int = TERMS, wide: int = SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group the language's other sources by divergence from them (``pair``), and the ``top`` terms in which it
    lies farthest above the language (``term``).  ``most``, ``terms_a_tile`` and ``wide`` (sources of a tile) change the work, not the result."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), empty("text"))
    posts = written(counted(docs), "postings")
    groups = written(docs.select("lang", "source").distinct().withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1), "groups")
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"))
    kept = posts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("all")).where(F.col("docs") >= least)
    kept = kept.join(few(sources), "lang")
    heavy = F.col("g") > F.least(F.lit(most), F.greatest(F.lit(2), F.expr("s div 4")))
    terms = written(kept.select("lang", "term", "all", heavy.alias("heavy")), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("whole"), F.count(F.when(F.col("heavy"), 1)).alias("h"))
    dealt = terms.join(few(langs), "lang").withColumn("part", F.when(F.col("heavy"), F.pmod(F.xxhash64("term"), F.expr(f"(h + {terms_a_tile - 1}) div {terms_a_tile}"))))
    slot = Window.partitionBy("lang", "part")
    placed = dealt.where("heavy").withColumn("slot", F.row_number().over(slot.orderBy("term")).cast("long") - 1).withColumn("width", F.count(F.lit(1)).over(slot))
    none = F.lit(None).cast("long")
    terms = written(placed.select("lang", "term", "all", "heavy", "part", "slot", "width").unionByName(dealt.where("not heavy").select("lang", "term", "all", "heavy", none.alias("part"), none.alias("slot"), none.alias("width"))), "terms")
    posts = written(posts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept")
    totals = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.join(few(totals), ["lang", "source"], "left").join(few(langs), "lang", "left")
    groups = written(groups.select("lang", "source", "sid", zero("total"), zero("v"), zero("whole"), (F.coalesce("v", F.lit(0)) - F.coalesce("h", F.lit(0))).cast("long").alias("light")), "groups")
    posts = posts.join(few(groups), ["lang", "source"])
    blocks = blocks_of(groups, wide)
    light = posts.where("not heavy")
    parts = dense(posts.where("heavy"), terms.where("heavy"), groups, blocks, wide).unionByName(together(light)).unionByName(apiece(light, groups, blocks))
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda sid, c: few(groups.select("lang", F.col("sid").alias(sid), F.col("source").alias(c)))
    pairs = pairs.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    p, q = shared(F.col("n"), F.col("total"), F.col("v")), shared(F.col("all"), F.col("whole"), F.col("v"))
    above = posts.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    return pairs.unionByName(above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY lang, source, term
), kept AS (
  SELECT lang, term, sum(n) AS whole FROM c GROUP BY lang, term HAVING sum(docs) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(whole) AS whole FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), f AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM (SELECT g.lang, g.source, k.term, k.whole, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term)
), s AS (
  SELECT f.lang, source, term, n, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (total + v.v) AS HUGEINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (f.whole + 1) // (v.whole + v.v) AS HUGEINT) AS q FROM f JOIN v ON v.lang = f.lang
), pr AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source
), tm AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pr
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM tm) WHERE rank <= 200
"""
