"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first until the calibrated recall is reached.

1. The tree is fitted to unit vectors of a bounded sample (``SAMPLE`` rows, or as many as have ``CELLS`` components, by the smallest hashes of their ids): k-means with
   ``BRANCH`` centroids, and again in each cluster, until a leaf stands for about ``LEAF`` rows or holds ``FEW`` sampled ones.  Every row is then indexed: it goes down to its leaf.
2. Of equal vectors only the k + 1 rows with the smallest ids can be an answer, so the others are left out of the leaves; equal queries are searched once.
3. Rows lie in order of their leaves, packed into blocks of up to ``BLOCK``; a leaf of any size is spread over as many blocks as it needs.  Queries are packed
   likewise, near ones together.
4. Best bin first: nodes wait in a priority queue by the distance of their centroids from the query; the nearest is taken, an inner one adds its
   children, and a leaf is visited.
5. Calibration: for ``PROBES`` of the queries all rows are compared, and the place of each true neighbour's leaf in the query's order of visits is looked up.  Visits are
   widened, one leaf more at a time, until ``RECALL`` of the true neighbours lie in visited leaves; every query then visits so many, and more
   if they hold fewer than k + 1 rows.
6. A block and a block of queries meet if any of these visits a leaf in it; the rows of each visited leaf are compared with its visitors.
   Scores of those near the best are computed anew from the original vectors, in double precision.

What the driver and every task hold is bounded by parameters: the sample, the tree (at most ``SAMPLE / FEW`` leaves) and the probes.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do those with a null ``vec_id``; shorter vectors count as
padded with zeros; where a ``vec_id`` is repeated the smallest vector stands for it; components of any size are scaled by a power of two first, so lengths
neither overflow nor vanish; with fewer candidates than k all are returned; ties go to the smaller id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import dealt_join, once_each, partitions, table, written
from taskloom.llm.topk import matrix

K, RECALL, PROBES = 5, 0.95, 256
SAMPLE, CELLS, FEW = 32_768, 1 << 22, 8
BRANCH, LEAF, ROUNDS = 16, 256, 12
BLOCK, QUERIES = 2048, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, as doubles."""
    x = F.col("embedding").cast("array<double>")
    rows = once_each(vectors, "vec_id", "embedding").select("vec_id", x.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("v").isNotNull() & fine & F.exists("v", lambda c: c != 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component of each is between a half and one; exact but for components that vanish beside it."""
    power = np.frexp(np.abs(x).max(1, initial=0.0))[1]
    return np.ldexp(x, -power[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def k_means(x: np.ndarray, k: int, rng: np.random.RandomState) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the nearest one of each row; fewer than k where rows are equal."""
    centroids = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(ROUNDS):
        near = nearest(x, centroids)
        used = np.unique(near)
        centroids = np.stack([x[near == c].mean(0) for c in used])
    return centroids, nearest(x, centroids)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


class Tree:
    """``nodes[i]`` has the centroids of an inner node's children and the children; a negative child c is the leaf ``~c``.  Leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        self.share = rows / max(1, len(sample))
        self.root = self.grow(sample, np.random.RandomState(0))
        del self.share

    def grow(self, x: np.ndarray, rng: np.random.RandomState) -> int:
        if len(x) * self.share > LEAF and len(x) >= 2 * FEW:
            centroids, near = k_means(x, min(BRANCH, len(x) // FEW), rng)
            if len(centroids) > 1:
                at = len(self.nodes)
                self.nodes.append((centroids, []))
                kept = np.unique(near)
                self.nodes[at] = (centroids[kept], [self.grow(x[near == c], rng) for c in kept])
                return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while open_:
            at, rows = open_.pop()
            if at < 0:
                out[rows] = ~at
            elif len(rows):
                centroids, children = self.nodes[at]
                near = nearest(x[rows], centroids)
                open_ += [(c, rows[near == i]) for i, c in enumerate(children)]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, self.root)]
        while queue:
            _, at = heapq.heappop(queue)
            if at < 0:
                yield ~at
            else:
                centroids, children = self.nodes[at]
                for d, c in zip(((centroids**2).sum(1) - 2 * centroids @ q).tolist(), children, strict=True):
                    heapq.heappush(queue, (d, c))


def sampled(rows: DataFrame, most: int, dims: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").toPandas()
    return matrix(found.v, dims)


def indexed(rows: DataFrame, tree: Tree, dims: int) -> DataFrame:
    """Adds ``leaf``."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(leaf=tree.leaf_of(unit(matrix(frame.v, dims))))

    return rows.select("vec_id", "v").mapInPandas(place, "vec_id long, v array<double>, leaf int")


def packed(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """``block, ids, data, leaves`` (the leaf of each row) of up to ``size`` rows, in order of leaves."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, held, count = TaskContext.get().partitionId(), 0, [], 0
        for frame in frames:
            while len(frame):
                held.append(frame[: size - count])
                frame, count = frame[len(held[-1]) :], count + len(held[-1])
                if count == size:
                    yield block(pd.concat(held), part << 32 | n)
                    n, held, count = n + 1, [], 0
        if held:
            yield block(pd.concat(held), part << 32 | n)

    def block(frame: pd.DataFrame, name: int) -> pd.DataFrame:
        ids, leaves = frame.vec_id.to_numpy(np.int64), frame.leaf.to_numpy(np.int32)
        return pd.DataFrame({"block": [name], "ids": [ids.tobytes()], "data": [matrix(frame.v, dims).tobytes()], "leaves": [leaves.tobytes()]})

    order = ["leaf", "vec_id"]
    rows = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return written(rows.mapInPandas(pack, "block long, ids binary, data binary, leaves binary"), "blocks")


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of scaled vectors with one."""
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))


def best(v: np.ndarray, ids: np.ndarray, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the k nearest rows, ties to the smaller id; ``rough`` cosines are within their rounding errors."""
    near = np.arange(len(ids))
    if len(ids) > k:
        near = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9)
    score = exact(v[near], q)
    top = np.lexsort((ids[near], -score))[:k]
    return near[top], score[top]


def probed(blocks: DataFrame, ids: np.ndarray, probes: np.ndarray, dims: int, k: int) -> pd.DataFrame:
    """``probe, leaf`` of the k nearest of all rows to each probe, others than itself."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, flat = scaled(probes), unit(probes)
        for frame in frames:
            for row in frame.itertuples():
                own, leaves = np.frombuffer(row.ids, np.int64), np.frombuffer(row.leaves, np.int32)
                v = scaled(np.frombuffer(row.data, float).reshape(-1, dims))
                rough = unit(v) @ flat.T
                out = []
                for i, q in enumerate(asked):
                    there = np.flatnonzero(own != ids[i])
                    at, score = best(v[there], own[there], q, rough[there, i], k)
                    out.append(pd.DataFrame({"probe": i, "vec_id": own[there][at], "score": score, "leaf": leaves[there][at]}))
                yield pd.concat(out)

    found = blocks.select("ids", "data", "leaves").mapInPandas(search, "probe int, vec_id long, score double, leaf int")
    order = Window.partitionBy("probe").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("probe", "leaf").toPandas()


def calibrated(tree: Tree, probes: np.ndarray, true: pd.DataFrame, recall: float) -> int:
    """How many leaves to visit, so that those of the share ``recall`` of all true neighbours are among them."""
    need = []
    for i, q in enumerate(unit(probes)):
        wanted = true.leaf[true.probe == i].tolist()
        place = {}
        for n, leaf in enumerate(tree.visits(q), 1):
            if leaf in wanted:
                place[leaf] = n
                if len(place) == len(set(wanted)):
                    break
        need += [place[leaf] for leaf in wanted]
    counts = np.bincount(need or [1])
    return int(np.searchsorted(np.cumsum(counts), recall * len(need)))


def visited(q_blocks: DataFrame, tree: Tree, sizes: dict[int, int], dims: int, most: int, least: int) -> DataFrame:
    """``q_block, leaf, who``: which queries of a block visit a leaf: ``most`` leaves each, and on until these hold ``least`` rows."""

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                who: dict[int, list[int]] = {}
                for i, q in enumerate(unit(np.frombuffer(row.q_data, float).reshape(-1, dims))):
                    held = 0
                    for n, leaf in enumerate(tree.visits(q), 1):
                        who.setdefault(leaf, []).append(i)
                        held += sizes.get(leaf, 0)
                        if n >= most and held >= least:
                            break
                yield pd.DataFrame({"q_block": row.q_block, "leaf": list(who), "who": [np.array(x, np.int32).tobytes() for x in who.values()]}).astype({"leaf": "int32"})

    return q_blocks.select("q_block", "q_data").mapInPandas(visit, "q_block long, leaf int, who binary")


def compared(pairs: DataFrame, dims: int, k: int) -> DataFrame:
    """``query, vec_id, score``: the best k of each query in the leaves of a block that it visits."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield from meet(row)

    def meet(row) -> Iterator[pd.DataFrame]:
        ids, leaves, q_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.leaves, np.int32), np.frombuffer(row.q_ids, np.int64)
        v, q = (scaled(np.frombuffer(x, float).reshape(-1, dims)) for x in (row.data, row.q_data))
        flat, asked = unit(v), unit(q)
        found: dict[int, list] = {}
        for visit in row.visits:
            a, b = np.searchsorted(leaves, [visit["leaf"], visit["leaf"] + 1])
            who = np.frombuffer(visit["who"], np.int32)
            rough = flat[a:b] @ asked[who].T
            for i, one in zip(who.tolist(), rough.T, strict=True):
                at, score = best(v[a:b], ids[a:b], q[i], one, k)
                found.setdefault(i, []).append((ids[a:b][at], score))
        out = []
        for i, parts in found.items():
            own, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            top = np.lexsort((own, -score))[:k]
            out.append((np.full(len(top), q_ids[i]), own[top], score[top]))
        if out:
            yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(("query", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return pairs.mapInPandas(search, "query long, vec_id long, score double")


def nearest_by_cosine(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL, block: int = BLOCK, query_block: int = QUERIES, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``queries`` (a column vec_id) against all of ``vectors``."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    if not n or not asked.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v")))
    rows, asked = rows.withColumn("v", padded), asked.withColumn("v", padded)
    tree = Tree(unit(sampled(rows, max(1, min(SAMPLE, CELLS // dims)), dims)), n)
    equal = Window.partitionBy("leaf", "v").orderBy("vec_id")
    held = indexed(rows, tree, dims).withColumn("r", F.row_number().over(equal)).where(F.col("r") <= k + 1).drop("r")
    blocks = packed(held, dims, block)
    one = written(asked.groupBy("v").agg(F.min("vec_id").alias("query"), F.count(F.lit(1)).alias("times")), "asked")
    q_blocks = packed(indexed(one.select(F.col("query").alias("vec_id"), "v"), tree, dims), dims, query_block)
    q_blocks = q_blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    some = one.orderBy(F.xxhash64("query"), "query").limit(max(1, min(probes, CELLS // dims))).toPandas()
    points = matrix(some.v, dims)
    most = calibrated(tree, points, probed(blocks, some["query"].to_numpy(np.int64), points, dims, k), recall)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                leaf, size = np.unique(np.frombuffer(row.leaves, np.int32), return_counts=True)
                yield pd.DataFrame({"leaf": leaf, "block": row.block, "size": size})

    places = written(blocks.select("block", "leaves").mapInPandas(placed, "leaf int, block long, size long"), "places")
    sizes = {r.leaf: r.size_ for r in places.groupBy("leaf").agg(F.sum("size").alias("size_")).collect()}  # as many as the tree has leaves
    visits = visited(q_blocks, tree, sizes, dims, max(1, most), k + 1)
    meets = visits.join(places.select("leaf", "block"), "leaf").groupBy("block", "q_block").agg(F.collect_list(F.struct("leaf", "who")).alias("visits"))
    pairs = meets.join(blocks, "block").join(q_blocks, "q_block")
    pairs = pairs.repartition(partitions(spark), "block", "q_block")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    found = compared(pairs, dims, k + 1).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    found = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("x"))
    found = written(found.join(one.select("query", "times"), "query"), "found")
    members = dealt_join(asked.select(F.col("vec_id").alias("query_id"), "v"), one, ["v"], "times", "query_id").select("query_id", "query")
    answers = dealt_join(members, found, ["query"], "times", "query_id")
    others = F.slice(F.filter("x", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(others).alias("r", "s"))
    return answers.select("query_id", (F.col("r") + 1).alias("rank"), "s.vec_id", "s.score")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_by_cosine(vectors, vectors.where(F.col("vec_id") % 50 == 0))
