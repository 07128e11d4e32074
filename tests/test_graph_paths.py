"""Paths, cycles and orders of graphs against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from taskloom.operators import graph

EDGES = "video_id long, source long, target long, edge_type string"


def table(spark, edges, video=1):
    return spark.createDataFrame([(video, a, b, "causal") for a, b in edges], EDGES)


def random_dag(seed, n, share, shuffled):
    rng = random.Random(seed)
    names = list(range(n))
    if shuffled:
        rng.shuffle(names)
    return [(names[a], names[b]) for a in range(n) for b in range(a + 1, n) if rng.random() < share]


def all_paths(edges):
    ahead, inner = {}, {b for _, b in edges}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)

    def walk(path):
        if path[-1] not in ahead:
            yield path
        for b in sorted(ahead.get(path[-1], ())):
            yield from walk([*path, b])

    return [p for root in sorted(set(ahead) - inner) for p in walk([root])]


@pytest.mark.parametrize("seed,n,share,shuffled", [(1, 12, 0.4, False), (2, 14, 0.35, True), (3, 30, 0.08, True), (4, 3, 1.0, False)])
def test_every_path_is_decoded_from_its_rank(spark, seed, n, share, shuffled):
    edges = random_dag(seed, n, share, shuffled)
    df = table(spark, edges).unionByName(table(spark, [(5, 9), (9, 12)], 2))
    want = all_paths(edges)
    got = graph.chains(df, size=7).where("video_id = 1").orderBy("rank").collect()
    assert [r.path for r in got] == want and [int(r["rank"]) for r in got] == list(range(len(want)))
    counts = {r.path_length: int(r.num_paths) for r in graph.chain_counts(df).where("video_id = 1").collect()}
    assert counts == {k: sum(len(p) == k for p in want) for k in {len(p) for p in want}}
    assert [r.path for r in graph.chains(df).where("video_id = 2").collect()] == [[5, 9, 12]]


def test_a_slice_of_more_paths_than_can_be_listed(spark):
    n = 240  # 2^238 paths
    df = table(spark, [(a, b) for a in range(n) for b in range(a + 1, n)])
    got = graph.chains(df, first=0, last=3).orderBy("rank").collect()
    assert [len(r.path) for r in got] == [n, n - 1, n - 1] and got[1].path == [*range(n - 2), n - 1]
    with pytest.raises(Exception, match="causal paths: ask for a slice"):
        graph.chains(df).count()


def test_no_paths(spark):
    assert graph.chains(table(spark, [])).count() == 0


def components(edges):
    nodes = {x for e in edges for x in e}
    ahead = {a: {b for c, b in edges if c == a} for a in nodes}

    def reach(a):
        seen, left = set(), list(ahead[a])
        while left:
            b = left.pop()
            if b not in seen:
                seen.add(b)
                left += ahead[b]
        return seen

    far = {a: reach(a) for a in nodes}
    return {a: min(b for b in far[a] if a in far[b]) for a in nodes if a in far[a]}


@pytest.mark.parametrize("seed,n,m", [(1, 12, 16), (2, 20, 26), (3, 9, 30), (4, 25, 24)])
def test_cycles_are_the_strongly_connected_components(spark, seed, n, m):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    df = table(spark, edges).unionByName(table(spark, [(0, 1), (1, 2)], 2)).unionByName(table(spark, [(3, 3)], 3))
    got = {(r.video_id, r.seg_id): r.component for r in graph.cycles(df).collect()}
    assert got == {(1, a): c for a, c in components(edges).items()} | {(3, 3): 3}
    nodes = spark.createDataFrame([(1, i) for i in range(n)] + [(2, i) for i in range(3)] + [(3, 3)], "video_id long, seg_id long")
    dag = {r.video_id: r.is_dag for r in graph.metadata(nodes, df).collect()}
    assert dag == {1: not components(edges), 2: True, 3: False}
    problems = graph.validated(nodes, nodes, df).where("problem = 'cycle'").select("video_id", "seg_id").collect()
    assert {tuple(r) for r in problems} == set(got)


@pytest.mark.parametrize("shuffled", [False, True])
def test_orders_hold_along_every_edge_and_fall_back_to_the_numbers(spark, shuffled):
    edges = random_dag(7, 20, 0.15, shuffled)
    df = table(spark, edges).unionByName(table(spark, [(2, 0), (0, 1), (1, 2)], 2))
    nodes = spark.createDataFrame([(1, i) for i in range(22)] + [(2, i) for i in range(4)], "video_id long, seg_id long")
    at = {(r.video_id, r.seg_id): r.position for r in graph.ordered(nodes, df).collect()}
    assert sorted(p for (v, _), p in at.items() if v == 1) == list(range(22))
    assert all(at[1, a] < at[1, b] for a, b in edges)
    assert [at[2, i] for i in range(4)] == [0, 1, 2, 3]
    level = {r.seg_id: r.level for r in graph.topological(nodes, df).where("video_id = 1").collect()}
    assert all(level[a] < level[b] for a, b in edges) and level[20] == 0
    cyclic = {r.seg_id: r.level for r in graph.topological(nodes, df).where("video_id = 2").collect()}
    assert cyclic == {0: None, 1: None, 2: None, 3: 0}


def test_a_causal_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        graph.chain_counts(table(spark, [(0, 1), (1, 0)]))
    with pytest.raises(ValueError, match="cycle"):
        graph.chains(table(spark, [(0, 1), (1, 2), (2, 1)]))


def test_long_tracks_take_time_in_proportion(spark):
    """Half a million frames of one track, and events of one hand: frames that were read anew for each row would not end."""
    from taskloom.functions.temporal import gap_filled
    from taskloom.operators import contacts

    n = 500_000
    track = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("frame_idx"), F.when(F.col("id") % 10 < 7, F.col("id") * 2.0).alias("x"))
    got = gap_filled(track, ["k"], ["x"], 5).agg(F.count(F.when(F.col("x") == F.col("frame_idx") * 2, 1)).alias("right"), F.count(F.when(F.col("filled"), 1)).alias("filled")).first()
    assert (got.right, got.filled) == (n - 3, n * 3 // 10 - 3)
    events = spark.range(n // 5).select(F.lit(1).alias("video_id"), F.lit("left").alias("hand"), F.lit(0).alias("object_id"), F.lit("touch").alias("label"), (F.col("id") * 20).alias("frame_start"), (F.col("id") * 20 + 3).alias("frame_end"), F.lit(0.5).alias("confidence"))
    assert contacts.merged(events).count() == n // 5


def test_graphml_keeps_types(spark):
    from taskloom.sources import files

    nodes = spark.createDataFrame([(1, 0, "pick <& \"x\"", 0.25, [3, 5], True), (1, 7, None, -1e-9, [], False), (2, 4, " a ", 2.0, None, None)], "video_id long, seg_id long, label string, confidence double, objects array<long>, sure boolean")
    edges = spark.createDataFrame([(1, 0, 7, "causal", None, [("a", 1)]), (1, 7, 0, "temporal", 12, None)], "video_id long, source long, target long, edge_type string, gap_frames long, evidence array<struct<name:string,n:int>>")
    xml = files.graphml_of(nodes, edges)
    back = files.from_graphml(xml)
    read = lambda kind, **of: back.where(F.col("kind") == kind).select("video_id", "a", "b", *(files.attribute(n, k).alias(n) for n, k in of.items())).orderBy("video_id", "a").collect()
    got = [tuple(r) for r in read("node", label="string", confidence="double", objects="array<bigint>", sure="boolean")]
    assert got == [(1, 0, None, "pick <& \"x\"", 0.25, [3, 5], True), (1, 7, None, None, -1e-9, [], False), (2, 4, None, " a ", 2.0, None, None)]
    got = read("edge", edge_type="string", gap_frames="bigint", evidence="array<struct<name:string,n:int>>")
    assert [(r.a, r.b, r.edge_type, r.gap_frames, r.evidence and [tuple(e) for e in r.evidence]) for r in got] == [(0, 7, "causal", None, [("a", 1)]), (7, 0, "temporal", 12, None)]
    types = back.where("kind = 'node' and a = 0").first().types
    assert types == {"label": "string", "confidence": "double", "objects": "json", "sure": "boolean"}


def test_every_file_of_a_run(spark, tmp_path):
    import json

    from taskloom.plans import engine
    from taskloom.plans.queries import Tables, detections, marked
    from taskloom.sources import files
    from taskloom.sources.config import Segments, Settings

    t = Tables(spark, "/root/testdata/sf0.001")
    run = engine.Engine(Settings(segments=Segments(min_duration=2)))
    found = run.files(run.run(t.frames, t.joints, detections=detections(t), landmarks=marked(t)))
    assert set(found) == {"timeline", "pose", "objects", "contacts", "actions", "task_graph", "bare_graph", "egocentric"}
    paths = files.write_all(found, f"file://{tmp_path}")
    videos = {r.video_id for r in t.totals.collect()}
    for name, path in paths.items():
        lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
        assert len(lines) == len(videos) and all(("nodes" in x) if name == "bare_graph" else x["schema_version"] == "1.0" for x in lines), name
