"""Exact top-k by inner product: vectors in descending length, rotated partial sums, residual bounds.

1. Components become integers, floor(1024 x).  The Gram matrix of all vectors is summed over the partitions; the
   rotation to its eigenvectors (the right singular vectors of the data) puts most of the products into the
   first coordinates.
2. Vectors are range-partitioned by descending length and packed into blocks of ``BLOCK`` rows, in that
   order; queries are packed into blocks of ``QUERIES`` rows.
3. Blocks are searched in waves of descending length: the longest block, the rest of the first ``GROWTH`` parts, and so on, each wave
   some ``GROWTH`` times as large as all before.  A query's k-th best score so far is its *floor*, which rises from wave to wave.
4. Before any vector moves, pairs of blocks are formed as keys: a block of vectors and a block of queries only meet if the length of the
   longest vector times that of some query reaches the query's floor.  Lengths descend, so a wave without pairs is the last.
5. Where they meet, partial sums over the first rotated coordinates, plus the product of the residual lengths (Cauchy-Schwarz),
   are compared with the floor, over more coordinates each time; only vectors that stay above are scored, in integers.

Bounds are computed in floating point with a margin above their rounding error, so no score is lost, and
scores that equal the floor are kept, so ties go to the smaller ``vec_id``.

Queries meet all rows, but in blocks of thousands, and each task holds one block of either.  The driver holds a matrix of dimension squared.

Cases: vectors that are null, or hold null or non-finite components, take no part, neither do those with a null
``vec_id``; all finite ones do, however large: scores are exact in integers of any size, and one that a long cannot hold counts as the
nearest long; shorter vectors count as padded with zeros; where a ``vec_id`` is repeated the smallest vector stands for it; with fewer
candidates than k all are returned; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import once_each, partitions, table, written

SCALE, K = 1024, 10
BLOCK, QUERIES = 2048, 4096
#: How many times as many parts a wave has as all before it.
GROWTH = 8
LARGEST = 1.7e308
#: Parts of the coordinates after which the bound is tried.
PARTS = (0.125, 0.25, 0.5)


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, norm``: components as integers, which doubles hold exactly, and length of the vectors that take part."""
    vectors = once_each(vectors, "vec_id", "embedding").where(F.col("embedding").isNotNull())
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    cut = lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))
    whole = lambda c: F.when(F.abs(c) < 2.0**42, F.floor(c * SCALE).cast("double")).otherwise(cut(c * SCALE))  # noqa: E731  the larger ones are whole
    vectors = vectors.where(fine).select("vec_id", F.transform(x, whole).alias("v"))
    most = F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(1.0)))
    square = F.aggregate(F.col("v"), F.lit(0.0), lambda a, c: a + (c / F.col("most")) * (c / F.col("most")))
    return vectors.withColumn("most", most).select("vec_id", "v", F.least(F.col("most") * F.sqrt(square), F.lit(LARGEST)).alias("norm"))


def matrix(lists, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors of the Gram matrix, largest first.  Any rotation is right; vectors too long to be squared don't shape it."""

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for frame in frames:
            m = matrix(frame.v, dims)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(dims), "row": list(total)})

    rows = vectors.where(F.col("norm") < 2.0**100).select("v").mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    cells = rows.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    g = np.zeros((dims, dims))
    g[cells.i, cells.j] = cells.x
    return np.linalg.eigh(g)[1][:, ::-1].copy()


def packed(rows: DataFrame, dims: int, size: int, name: str) -> DataFrame:
    """Blocks of up to ``size`` rows of each partition, in its order: ``name``, longest, ids and components."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, []
        for frame in frames:
            held.append(frame)
            while sum(map(len, held)) >= size:
                rest = pd.concat(held, ignore_index=True)
                yield block(rest[:size], part, n)
                n, held = n + 1, [rest[size:]]
        if held and sum(map(len, held)):
            yield block(pd.concat(held, ignore_index=True), part, n)

    def block(frame: pd.DataFrame, part: int, n: int) -> pd.DataFrame:
        ids = frame.vec_id.to_numpy(np.int64)
        return pd.DataFrame({name: [part << 32 | n], "longest": [float(frame.norm.max())], "ids": [ids.tobytes()], "data": [matrix(frame.v, dims).tobytes()]})

    return rows.mapInPandas(pack, f"{name} long, longest double, ids binary, data binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], ~scores[kept]))[:k]]  # ~ descends, too, and has no overflow


def shrunk(x: np.ndarray) -> tuple[np.ndarray, int]:
    """The numbers times a power of two, so that squares and products stay finite; and the power."""
    power = max(0, int(np.frexp(np.abs(x).max(initial=0.0))[1]) - 60)
    return np.ldexp(x, -power), power


def exact(v: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers; ``most`` bounds them and all partial sums."""
    if most < 2.0**53:
        return (v @ q).astype(np.int64)
    if most < 2.0**62 and max(np.abs(v).max(), np.abs(q).max()) < 2.0**62:
        return v.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q.tolist()]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in v.tolist()]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in sums], np.int64)


def searched(pairs: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """``query_id, vec_id, score, q_block, q_norm``: for each pair of blocks the best k of each query that can matter."""
    dims = len(turn)
    cuts = [c for c in sorted({max(1, int(dims * p)) for p in PARTS}) if c < dims]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield from meet(row)

    def meet(row) -> Iterator[pd.DataFrame]:
        q, v = (np.frombuffer(x, float).reshape(-1, dims) for x in (row.q_data, row.data))
        q_ids, ids, floor = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64), np.full(len(q), -np.inf)
        if row.floor_ids is not None:
            floor[np.searchsorted(q_ids, row.floor_ids)] = row.floors
        (qf, q_power), (vf, v_power) = shrunk(q), shrunk(v)
        qr, vr = qf @ turn, vf @ turn
        q_len, v_len = np.sqrt((qf**2).sum(1)), np.sqrt((vf**2).sum(1))
        longest, q_norm = float(v_len.max()), np.minimum(np.ldexp(q_len, q_power), LARGEST)
        # a floor has the error of a double, a partial sum that of its terms
        floor = np.ldexp(floor - 1e-12 * np.where(np.isfinite(floor), np.abs(floor), 0), -q_power - v_power)
        slack = 1e-9 * q_len * max(longest, 1.0) + 1e-6
        rest = {c: (np.sqrt(np.maximum(0, (qr[:, c:] ** 2).sum(1))), np.sqrt(np.maximum(0, (vr[:, c:] ** 2).sum(1)))) for c in cuts}
        out = []
        for i in np.flatnonzero(q_len * longest + slack >= floor):
            near = np.flatnonzero(q_len[i] * v_len + slack[i] >= floor[i])
            part, done = np.zeros(len(near)), 0
            for c in cuts:
                part = part + vr[near, done:c] @ qr[i, done:c]
                high = part + rest[c][0][i] * rest[c][1][near] + slack[i] >= floor[i]
                near, part, done = near[high], part[high], c
            near = near[ids[near] != q_ids[i]]
            if len(near):
                most = min(float(q_len[i] * longest) + 1, LARGEST) * 2.0 ** min(q_power + v_power, 900)
                scores = exact(v[near], q[i], most)
                top = best(scores, ids[near], k)
                out.append((np.full(len(top), q_ids[i]), ids[near][top], scores[top], np.full(len(top), q_norm[i])))
        if out:
            found = pd.DataFrame({n: np.concatenate(x) for n, x in zip(("query_id", "vec_id", "score", "q_norm"), zip(*out, strict=True), strict=True)})
            yield found.assign(q_block=row.q_block)

    return pairs.mapInPandas(search, "query_id long, vec_id long, score long, q_norm double, q_block long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def floors_of(best_yet: DataFrame, q_blocks: DataFrame, k: int) -> DataFrame:
    """``q_block, floor_ids, floors, need``: the floors of its queries, and the length that a vector needs to reach any of them."""
    need = F.when(F.col("q_norm") > 0, F.col("score") / F.col("q_norm")).otherwise(F.lit(float("-inf")))
    full = best_yet.where(F.col("rank") == k).groupBy("q_block")
    full = full.agg(F.array_sort(F.collect_list(F.struct("query_id", "score"))).alias("x"), F.min(need).alias("need"), F.count(F.lit(1)).alias("full"))
    joined = q_blocks.select("q_block", "asked").join(full, "q_block", "left")
    every = F.coalesce(F.col("full") == F.col("asked"), F.lit(False))  # a query with fewer than k scores takes any
    return joined.select(
        "q_block", F.col("x.query_id").alias("floor_ids"), F.col("x.score").cast("array<double>").alias("floors"), F.when(every, F.col("need")).otherwise(F.lit(float("-inf"))).alias("need")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``queries`` (a column vec_id) against all of ``vectors``."""
    spark = vectors.sparkSession
    rows = written(integers(vectors), "vectors")
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    turn = rotation(rows, dims)
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    parts = partitions(spark)
    ordered = rows.repartitionByRange(parts, F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id")
    blocks = written(packed(ordered, dims, block, "block"), "blocks")
    q_parts = max(1, -(-asked.count() // query_block))
    q_blocks = packed(asked.repartition(q_parts).sortWithinPartitions("vec_id"), dims, query_block, "q_block")
    q_blocks = written(q_blocks.select("q_block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), (F.length("ids") / 8).cast("long").alias("asked")), "queries")
    part = F.shiftright("block", 32)  # parts are numbered in descending length
    first = blocks.agg(F.min("block")).first()[0]
    if first is None or not q_blocks.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    waves, upto = [F.col("block") == first, (F.col("block") != first) & (part < (first >> 32) + GROWTH)], (first >> 32) + GROWTH
    while upto < parts:
        waves.append((part >= upto) & (part < upto * GROWTH))
        upto *= GROWTH
    best_yet = spark.createDataFrame([], "query_id long, vec_id long, score long, q_norm double, q_block long, rank int")
    for wave in waves:
        floors = written(floors_of(best_yet, q_blocks, k), "floors")
        needs = floors.agg(F.collect_list(F.struct("q_block", "need")).alias("needs")).withColumn("one", F.lit(1))  # two numbers for thousands of queries
        keys = blocks.where(wave).select("block", "longest", F.lit(1).alias("one")).join(F.broadcast(needs), "one")
        reached = F.filter("needs", lambda x: F.col("longest") * (1 + 1e-9) + 1e-6 >= x.need * (1 - 1e-9 * F.signum(x.need)))
        keys = written(keys.select("block", F.explode(F.transform(reached, lambda x: x.q_block)).alias("q_block")), "pairs")
        if not keys.take(1):
            if blocks.where(wave).take(1):
                break
            continue
        pairs = keys.repartition(parts, "block", "q_block").join(blocks, "block").join(q_blocks.join(floors.drop("need"), "q_block"), "q_block")
        best_yet = written(ranked(searched(pairs, turn, k).unionByName(best_yet.drop("rank")), k), "best")
    return best_yet.select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""
