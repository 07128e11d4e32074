"""The nearest neighbours against brute force: recall, scores, ties, and vectors of any size."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import neighbours

VECTORS = "vec_id long, embedding array<double>, label int"


def cosine(a, b):
    n = max(len(a), len(b))
    a, b = (np.array([*x, *[0.0] * (n - len(x))]) for x in (a, b))
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def brute(data, asked, k=5):
    out = {}
    for q in asked:
        found = sorted((-round(cosine(data[q], v), 12), i) for i, v in data.items() if i != q)
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def answers(found):
    out = collections.defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall(spark, kind):
    rng = np.random.RandomState(3)
    x = rng.randn(3000, 12) * (0.2 if kind == "clusters" else 1) + (rng.randn(40, 12)[rng.randint(0, 40, 3000)] if kind == "clusters" else 0)
    data = {i: v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame([(i, v, 0) for i, v in data.items()], VECTORS).repartition(3).withColumn("leaf", F.lit("x")).withColumn("v", F.lit(1)).withColumn("query", F.lit(2))
    got = answers(neighbours.nearest_by_cosine(df, df.where("vec_id % 10 = 0"), probes=100, block=200, query_block=64))
    want = brute(data, range(0, 3000, 10))
    assert len(got) == 300 and all(len(v) == 5 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * 300
    assert all(s == pytest.approx(cosine(data[q], data[i]), abs=1e-12) for q in got for i, s in got[q])


def test_ties_equal_vectors_and_odd_ones(spark):
    base = [[1.0, 2.0, 0.0], [1.0, 2.0], [0.0, 0.0, -3.0], [1e308, -1e308, 1e308], [1e-310, 0.0, 0.0], [5.0, 0.0, 0.0], [-1.0, -2.0, 0.0], [0.0, 1e200, 1.0]]
    data = {i: v for i, v in enumerate(base)}
    data |= {100 + i: [3.0, 1.0, 1.0] for i in range(50)}  # many equal ones
    odd = [(500, None, 0), (501, [0.0, 0.0, 0.0], 0), (502, [1.0, None, 2.0], 0), (503, [math.nan, 1.0, 1.0], 0), (504, [math.inf, 1.0, 1.0], 0), (505, [], 0), (None, [1.0, 1.0, 1.0], 0), (0, [9.0, 9.0, 9.0], 1)]
    df = spark.createDataFrame([(i, v, 0) for i, v in data.items()] + odd, VECTORS)
    got = answers(neighbours.nearest_by_cosine(df, df, block=7, query_block=5))
    want = brute(data, data)
    assert sorted(got) == sorted(data)
    for q in data:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert [i for i, _ in got[120]] == [100, 101, 102, 103, 104] and [i for i, _ in got[102]] == [100, 101, 103, 104, 105]


def test_fewer_candidates_than_k_and_none(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(3)], VECTORS)
    got = answers(neighbours.nearest_by_cosine(df, df))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 2], 1: [2, 0], 2: [1, 0]}
    assert neighbours.nearest_by_cosine(df.limit(0), df).count() == 0
    assert neighbours.nearest_by_cosine(df.limit(1), df).count() == 0


def test_the_tree_visits_every_leaf_nearest_first():
    rng = np.random.RandomState(1)
    x = neighbours.unit(rng.randn(2000, 6))
    tree = neighbours.Tree(x, 200_000)
    leaves = tree.leaf_of(x)
    assert tree.leaves > 100 and set(leaves.tolist()) == set(range(tree.leaves))
    order = list(tree.visits(x[7]))
    assert sorted(order) == list(range(tree.leaves)) and order[0] == leaves[7]
