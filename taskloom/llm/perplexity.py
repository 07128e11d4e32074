"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the bytes of UTF-8, of order ``ORDER``, so it knows every character apart; a text begins after ORDER - 1 start symbols and
ends with an end symbol.  Symbols have 9 bits, so an n-gram is one long.  Everything about n-grams is a
sharded count join; every table below is keyed, and shuffled, by the n-gram.

1. Counts of the highest order over the trusted texts but a ``HELD``-th of them; those of lower orders are continuation counts (in how many
   distinct ways an n-gram is extended to the left), each from the order above.  N-grams that begin with a start symbol can be
   extended in one way only and keep their plain counts.
2. Counts of counts give each order's three discounts; sums by context give the normalisers and the mass left over
   for the order below, and below the lowest for all symbols alike.
3. The distinct n-grams of all documents are joined with counts and contexts, lowest order first, which gives
   log p of every n-gram that occurs anywhere.
4. A document's perplexity is the exponential of the mean of -log p over its bytes and its end.  If the table of step 3 has at most
   ``TABLE_ROWS`` rows (16 bytes each) it is broadcast; if more, documents are dealt into blocks of about
   ``BLOCK_BYTES``, each block's distinct n-grams are joined with the table, and texts and answers meet by block.
5. Each language's limits are quantiles of the perplexities of its trusted documents that the model has not seen, the ``HELD``-th; languages without
   any take the limits of all.  Documents beyond them are rejected: above, text unlike the trusted; below, endless repetition.

All trusted rows and all documents count; nothing is sampled.

Cases: null and empty texts have no n-grams, a null perplexity, and are rejected; without trusted texts no document has a
perplexity and none is kept; if no trusted text is held out, the limits are those of all trusted texts; where a ``doc_id`` is repeated, with
different texts or languages, the smallest (text, language) stands for it; a null language is a language of its own; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import among, compressed, expanded, mixed, once_each, raw, steps, table, written

ORDER, BITS = 5, 9
#: One in so many trusted documents is kept out of the model and sets the limits.
HELD = 5
LOW, HIGH = 0.01, 0.98
TABLE_ROWS, BLOCK_BYTES = 3_000_000, 16 << 20
#: Languages up to which their limits are broadcast.
FEW_LANGUAGES = 100_000
#: Symbols beyond the bytes.  Start symbols are never predicted, so 257 can be.
START, END = 256, 257
SYMBOLS = 257


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends in each byte of the texts and in their ends, and the row of each; empty texts have none."""
    data, offsets = raw(column)
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    events = size[full] + 1
    start = offsets[full] + ORDER * np.arange(len(full))  # where the start symbols of each text begin
    symbols = np.full(len(data) + ORDER * len(full), START, np.int64)
    place = np.arange(len(data)) + np.repeat(ORDER * np.arange(len(full)) + ORDER - 1, size[full])
    symbols[place] = data
    symbols[start + ORDER - 1 + size[full]] = END
    packed = np.zeros(max(0, len(symbols) - ORDER + 1), np.int64)
    for i in range(ORDER):
        packed |= symbols[i : i + len(packed)] << (BITS * (ORDER - 1 - i))
    at = np.repeat(start, events) + np.arange(events.sum()) - np.repeat(np.cumsum(events) - events, events)
    return packed[at], np.repeat(full, events)


def counted(texts: DataFrame) -> DataFrame:
    """``g, c``: how often each n-gram of the highest order occurs; counted within batches before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                held.append(np.unique(grams(expanded(batch.column("z").slice(i, 512)))[0], return_counts=True))
                if len(held) == 16:
                    held = [merged(held)]
        if held:
            g, c = merged(held)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c.astype(np.int64))], names=["g", "c"])

    return texts.mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([c for _, c in held]), len(g)).astype(np.int64)


def suffix(n: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << (BITS * (n - 1))) - 1))


def context() -> Column:
    return F.shiftrightunsigned("g", BITS)


class Order:
    """Counts of one order: discounts, and the discounted share of each n-gram and the rest of each context."""

    def __init__(self, counts: DataFrame):
        of = counts.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
        n1, n2, n3, n4 = ({int(r.c): r.n for r in of}.get(i, 0) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        clip = lambda d, most: min(max(d, 0.05), most)  # noqa: E731  little text may give none, or more than all
        self.discounts = [clip(k - (k + 1) * y * b / a, k - 0.05) if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        d1, d2, d3 = self.discounts
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        sums = counts.groupBy(context().alias("h")).agg(F.sum("c").alias("total"), F.sum(taken).alias("taken"))
        self.shares = counts.select("g", (F.col("c") - taken).alias("left"))
        self.contexts = sums.select("h", "total", (F.col("taken") / F.col("total")).alias("rest"))


def log_probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``g, logp`` for each n-gram ``g`` of ``asked`` (distinct, of the highest order)."""
    by_order, wanted = {ORDER: counts}, {ORDER: asked}
    for n in range(ORDER, 1, -1):
        first = F.shiftrightunsigned("g", BITS * (n - 2))
        left = by_order[n].groupBy(suffix(n).alias("g")).agg(F.count(F.lit(1)).alias("ways"), F.sum("c").alias("plain"))
        by_order[n - 1] = written(left.select("g", F.when(first == START, F.col("plain")).otherwise(F.col("ways")).alias("c")), "counts")
        wanted[n - 1] = written(wanted[n].select(suffix(n).alias("g")).distinct(), "asked")
    p = wanted[1].select("g", F.lit(1.0 / SYMBOLS).alias("p"))
    for n in range(1, ORDER + 1):
        order = Order(by_order[n])
        lower = p if n == 1 else wanted[n].select("g", suffix(n).alias("s")).join(p.select(F.col("g").alias("s"), "p"), "s").drop("s")
        found = lower.join(order.shares, "g", "left").withColumn("h", context()).join(order.contexts, "h", "left")
        seen = F.coalesce("left", F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("p")
        p = written(found.select("g", F.when(F.col("total").isNull(), F.col("p")).otherwise(seen).alias("p")), "p")
    return p.select("g", F.log("p").alias("logp"))


class Lookup:
    """From n-gram to value: keys in order of their hashes, reached through the hashes' leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, int(len(keys)).bit_length())
        h = mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)
        order = np.argsort(h, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.searchsorted(h[order], np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        h = (mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
        at, out = self.first[h], np.full(len(keys), np.nan)
        open_ = np.arange(len(keys))
        while len(open_):
            there = at[open_] < self.first[h[open_] + 1]
            open_ = open_[there]
            hit = self.keys[at[open_]] == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit]
            at[open_] += 1
        return out


SCORES = "doc_id long, n_chars long, perplexity double"


def scores(doc_ids: pa.Array, texts: pa.Array, lookup: Lookup) -> pa.RecordBatch:
    g, row = grams(texts)
    events, total = np.bincount(row, minlength=len(texts)), np.bincount(row, lookup(g), len(texts))
    perplexity = pa.array(np.exp(-total / np.maximum(events, 1)), mask=(events == 0) | np.isnan(total))
    return pa.RecordBatch.from_arrays([doc_ids, pc.utf8_length(texts.cast(pa.large_string())).cast(pa.int64()), perplexity], names=["doc_id", "n_chars", "perplexity"])


def by_broadcast(docs: DataFrame, logp: DataFrame) -> DataFrame:

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("g", "logp")]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "logp"])

    parts = logp.mapInArrow(pack, "g binary, logp binary").collect()  # at most TABLE_ROWS, by the caller's check
    keys, values = (np.frombuffer(b"".join(bytes(x[i]) for x in parts), kind) for i, kind in ((0, np.int64), (1, np.float64)))
    held = docs.sparkSession.sparkContext.broadcast((keys, values))
    built: dict[int, Lookup] = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = built.get(0) or built.setdefault(0, Lookup(*held.value))
        for batch in steps(batches):
            yield scores(batch.column("doc_id"), batch.column("text"), lookup)

    return docs.mapInArrow(score, SCORES)


def by_blocks(docs: DataFrame, logp: DataFrame) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            g, row = grams(batch.column("text"))
            own = batch.column("block").to_numpy()[row]
            for b in np.unique(own):
                found = np.unique(g[own == b])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b)), pa.array(found)], names=["block", "g"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        lookup = Lookup(right.column("g").to_numpy(), right.column("logp").to_numpy())
        out = [scores(b.column("doc_id"), expanded(b.column("z")), lookup) for b in left.to_batches(max_chunksize=512)]
        return pa.Table.from_batches(out)

    texts = compressed(docs).withColumn("block", block).groupBy("block")
    answers = docs.select(block, "text").mapInArrow(ask, "block long, g long").distinct().join(logp, "g").groupBy("block")
    return texts.cogroup(answers).applyInArrow(score, SCORES)


def perplexities(docs: DataFrame, trusted: DataFrame, table_rows: int = TABLE_ROWS) -> DataFrame:
    """``doc_id, n_chars, perplexity`` of ``docs`` (doc_id, text) under the model of those in ``trusted`` (doc_id)."""
    counts = written(counted(compressed(among(docs, trusted))), "counts")
    if not counts.take(1):
        return docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.lit(None).cast("double").alias("perplexity"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in steps(batches):
            held.append(np.unique(grams(batch.column("text"))[0]))
            if len(held) == 16:
                held = [np.unique(np.concatenate(held))]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["g"])

    asked = written(docs.select("text").mapInArrow(ask, "g long").distinct(), "asked")
    logp = written(log_probabilities(counts, asked), "logp")
    return by_broadcast(docs, logp) if logp.count() <= table_rows else by_blocks(docs, logp)


def judged(docs: DataFrame, trusted: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, keep`` for every document; ``docs`` has doc_id, text and lang."""
    both = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), "lang").alias("x"))
    docs = once_each(both, "doc_id", "x").select("doc_id", "x.text", "x.lang")
    trusted = written(trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "trusted")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0
    found = perplexities(docs.select("doc_id", "text"), trusted.where(~held))
    found = written(docs.select("doc_id", "lang").join(found, "doc_id"), "perplexities")
    known = written(among(found, trusted).where("perplexity is not null"), "known")
    known = known.where(held) if known.where(held).take(1) else known
    quantile = [F.percentile_approx("perplexity", q, 10_000).alias(n) for q, n in ((low, "low"), (high, "high"))]
    name = F.coalesce("lang", F.lit("\u0000"))
    limits = written(known.groupBy(name.alias("name")).agg(*quantile), "limits")
    low_all, high_all = known.agg(*quantile).first()
    limits = F.broadcast(limits) if limits.count() <= FEW_LANGUAGES else limits
    joined = found.withColumn("name", name).join(limits, "name", "left")
    within = F.col("perplexity").between(F.coalesce("low", F.lit(low_all).cast("double")), F.coalesce("high", F.lit(high_all).cast("double")))
    return joined.select("doc_id", "lang", "n_chars", "perplexity", F.coalesce(within, F.lit(False)).alias("keep"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    return judged(table(spark, sf_dir, "documents"), trusted)
