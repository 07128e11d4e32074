"""Substring deduplication by relative Lempel-Ziv parsing against all earlier text.

A word is a maximal run of bytes other than space and the control characters 9 to 13.  Every document is factored against
the index of all reference blocks: a factor copies words from the earliest place that holds them, and
what no factor covers is literal.  A factor is made of windows of ``size`` words, so shorter repeats stay
literal, and every word that a window found earlier covers is in a factor.

1. Blocks.  Each window's *anchor* is the smallest hash among its sequences of ``GRAM`` words, so equal windows have equal
   anchors at equal offsets.  The windows that share an anchor are consecutive and form one block, of
   ``size`` to ``2 size - GRAM`` words.  Only anchors that occur twice or more in all documents go on.
2. Index.  Blocks with equal words are one entry, with its earliest place; all later blocks are factors whole.
3. Boundaries.  Where a repeat begins or ends within a block, the block is new but some of its
   windows are not.  So the windows of each entry's first block are indexed and looked up one by one.
   (The earliest place of any window lies in such a block: in a later one it would have been seen before.)
   An anchor with one entry needs none of that: all places that hold one of its windows hold the whole block.
4. The pieces found are parsed greedily, per document from left to right, into the longest factors.

Equality is that of an anchor and of a hash over the words, of independent bases.  Everything is joined and grouped by hashes after partial
aggregation; lookups are joins of rows with one entry each, so a block that a third of the documents hold costs
as many rows as it has places and is spread by the skew join.

Cases: null and empty texts have no words; documents shorter than a window keep all words; the order of occurrences is
that of (doc_id, position); repeated and null ``doc_id`` as in ``common``; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import documents, raw, signed, span_hashes, steps, table, word_hashes, words, written

SIZE, GRAM = 20, 4


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive values, the first of equals."""
    value, at, span = x, np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        left = value[:-step] <= value[step:]
        value, at = np.where(left, value[:-step], value[step:]), np.where(left, at[:-step], at[step:])
        span += step
    return at


class Blocks:
    """The blocks of a batch of texts: ``row``, anchor ``h``, first window ``a``, windows ``n``."""

    def __init__(self, column: pa.Array, size: int, gram: int):
        data, offsets = raw(column)
        start, end, row = words(data, offsets)
        self.hashes, self.others = (word_hashes(data, start, end, base) for base in (0, 1))
        self.first = np.searchsorted(row, np.arange(len(column)))  # of each text's words
        self.size, none = size, np.zeros(0, np.int64)
        self.row = self.a = self.n = none
        self.h = none.astype(np.uint64)
        if len(row) < size:
            return
        at = np.arange(len(row) - gram + 1)
        grams = span_hashes(self.hashes, at, at + gram)
        anchor = sliding_argmin(grams, size - gram + 1)
        windows = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
        if not len(windows):
            return
        anchor, own = anchor[windows], row[windows]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
        self.row, self.a, self.h = own[new], windows[new], grams[anchor[new]]
        self.n = np.diff(np.r_[new, len(windows)])

    def words(self) -> np.ndarray:
        """A hash of all the words of each block."""
        return span_hashes(self.others, self.a, self.a + self.n + self.size - 1, 1)


def blocks(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``h, words, doc_id, start, n`` of every block: anchor, hash of its words, and its windows' place and number."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            b = Blocks(batch.column("text"), size, gram)
            start, n = (b.a - b.first[b.row]).astype(np.int32), b.n.astype(np.int32)
            columns = [pa.array(signed(b.h)), pa.array(signed(b.words())), batch.column("doc_id").take(pa.array(b.row)), pa.array(start), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "words", "doc_id", "start", "n"])

    return docs.mapInArrow(find, "h long, words long, doc_id long, start int, n int")


def window_list(docs: DataFrame, size: int) -> DataFrame:
    """``h, window, doc_id, start`` of each window of the blocks in ``wanted`` (h, start, n), a list in each row."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, offsets = raw(batch.column("text"))
            start, end, row = words(data, offsets)
            hashes = word_hashes(data, start, end, 1)
            first = np.searchsorted(row, np.arange(batch.num_rows))
            wanted = batch.column("wanted")
            h, at, n = (wanted.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("h", "start", "n"))
            own = np.repeat(np.arange(batch.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False))
            own, h = np.repeat(own, n), np.repeat(h, n)
            begin = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = span_hashes(hashes, begin + first[own], begin + first[own] + size, 1)
            columns = [pa.array(h), pa.array(signed(found)), batch.column("doc_id").take(pa.array(own)), pa.array(begin.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "window", "doc_id", "start"])

    return docs.mapInArrow(unpack, "h long, window long, doc_id long, start int")


def pieces(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``doc_id, start, length, ref_doc, ref_start``: words that stand earlier at the reference."""
    every = blocks(docs, size, gram)
    repeated = every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    block = written(every.join(repeated, "h"), "blocks")
    entry = written(block.groupBy("h", "words").agg(F.min(F.struct("doc_id", "start", "n")).alias("e"), F.count(F.lit(1)).alias("c")), "entries")
    first = entry.select("h", "words", F.col("e.doc_id").alias("ref_doc"), F.col("e.start").alias("ref_start"), "c").where("c > 1").drop("c")
    later = (F.col("doc_id") != F.col("ref_doc")) | (F.col("start") != F.col("ref_start"))
    whole = block.join(first, ["h", "words"]).where(later).select("doc_id", "start", (F.col("n") + size - 1).alias("length"), "ref_doc", "ref_start")
    varied = entry.groupBy("h").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1").select("h")
    wanted = entry.join(varied, "h").groupBy("e.doc_id").agg(F.collect_list(F.struct("h", "e.start", "e.n")).alias("wanted"))
    window = window_list(docs.join(wanted, "doc_id"), size)
    earliest = window.groupBy("h", "window").agg(F.min(F.struct("doc_id", "start")).alias("r"), F.count(F.lit(1)).alias("c")).where("c > 1")
    earliest = earliest.select("h", "window", F.col("r.doc_id").alias("ref_doc"), F.col("r.start").alias("ref_start"))
    part = window.join(earliest, ["h", "window"]).where(later).select("doc_id", "start", F.lit(size).alias("length"), "ref_doc", "ref_start")
    return whole.unionByName(part)


def greedy(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Factors from pieces (start, length, ref_doc, ref_start): pieces that go on in the same reference are
    one, and at each place the one that reaches farthest is taken."""
    whole: dict[tuple[int, int], list[list[int]]] = {}
    for start, length, doc, at in sorted(found):
        runs = whole.setdefault((doc, at - start), [])
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + length)
        else:
            runs.append([start, start + length])
    spans = sorted((a, b, doc, shift) for (doc, shift), runs in whole.items() for a, b in runs)
    out, here, i = [], 0, 0
    while i < len(spans):
        here = max(here, spans[i][0])
        best = None
        while i < len(spans) and spans[i][0] <= here:
            if best is None or spans[i][1] > best[1]:
                best = spans[i]
            i += 1
        # a later span that begins within the factor is parsed from the factor's end on
        while best[1] > here:
            out.append((here, best[1] - here, best[2], here + best[3]))
            here = best[1]
            more = best
            while i < len(spans) and spans[i][0] <= here:
                if spans[i][1] > more[1]:
                    more = spans[i]
                i += 1
            best = more
    return out


def parsed(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``doc_id, text, factors`` for every document; factors in words: start, length, ref_doc, ref_start."""
    docs = documents(docs)
    kind = "array<struct<start:int,length:int,ref_doc:long,ref_start:int>>"
    found = pieces(docs, size, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "ref_doc", "ref_start")).alias("factors"))
    return docs.join(found, "doc_id", "left").select("doc_id", "text", F.col("factors").cast(kind).alias("factors"))


def deduplicated(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, text, factors``: the words outside all factors, joined by one space."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            n_words, n_removed, kept, factors = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("factors").to_pylist(), strict=True):
                own = text.encode().split()
                n_words.append(len(own))
                parts = greedy([tuple(f.values()) for f in found]) if found else []
                rest, at = [], 0
                for start, length, _, _ in parts:
                    rest += own[at:start]
                    at = start + length
                rest += own[at:]
                n_removed.append(len(own) - len(rest))
                kept.append(b" ".join(rest))
                factors.append([dict(zip(("start", "length", "ref_doc", "ref_start"), p, strict=True)) for p in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, kind)],
                names=["doc_id", "n_words", "n_removed", "text", "factors"],
            )

    return parsed(docs, size, gram).mapInArrow(remove, "doc_id long, n_words long, n_removed long, text string, factors array<struct<start:int,length:int,ref_doc:long,ref_start:int>>")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w)
), f AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM g
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM f WHERE r > 1) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
