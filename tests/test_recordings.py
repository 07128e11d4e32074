"""Closed-form cases of the operators on recordings, and the registered queries against SQL on the smallest tables."""

import collections
import functools
import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from taskloom.functions import temporal
from taskloom.operators import actions, contacts, ego, graph, objects, pose, recorder, states, timeline
from taskloom.operators.objects import Tracker
from taskloom.plans.queries import ORACLES, QUERIES
from taskloom.sources import config, files

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def frames(spark, times, video=1):
    return spark.createDataFrame([(video, i, float(t)) for i, t in enumerate(times)], "video_id long, frame_idx long, t double")


def test_monotonic_times_are_repaired_by_the_step_before(spark):
    out = [r.t for r in timeline.fixed(frames(spark, [0, 0.1, 0.05, 0.3, 0.25, 0.4])).orderBy("frame_idx").collect()]
    assert out == pytest.approx([0, 0.1, 0.2, 0.3, 0.4, 0.4])
    assert out[4] <= out[5]


def test_a_single_frame_stays(spark):
    assert [r.t for r in timeline.fixed(frames(spark, [3])).collect()] == [3.0]


def test_nearest_frame_takes_the_earlier_of_two(spark):
    probes = spark.createDataFrame([(1, 0.5), (1, 0.6), (1, -9.0), (1, 9.0)], "video_id long, t double")
    assert rows(timeline.nearest_frames(probes, frames(spark, [0, 1, 2])).select("t", "frame_idx"), "t") == [(-9.0, 0), (0.5, 0), (0.6, 1), (9.0, 2)]


def test_gaps_are_filled_up_to_a_length_and_inside_only(spark):
    def fill(values, most):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k long, frame_idx long, x double")
        return [r.x for r in temporal.gap_filled(df, ["k"], ["x"], most).orderBy("frame_idx").collect()]

    assert fill([0.0, None, None, 3.0], 5) == pytest.approx([0, 1, 2, 3])
    assert fill([None, 1.0, 2.0, None], 5) == [None, 1.0, 2.0, None]
    assert fill([0.0, *[None] * 6, 7.0], 5) == [0.0, *[None] * 6, 7.0]


def test_hysteresis(spark):
    flags = [1, 1, 0, 0, 1, 0, 0, 0, 1]
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)], "k long, frame_idx long, f boolean")
    out = temporal.hysteresis(df, ["k"], F.col("f"), 2, 3, "on")
    assert [int(r.on) for r in out.orderBy("frame_idx").collect()] == [0, 1, 1, 1, 1, 1, 1, 0, 0]


def test_islands(spark):
    df = spark.createDataFrame([(1, i) for i in (3, 4, 5, 8, 9)], "k long, frame_idx long")
    assert rows(temporal.islands(df, ["k"]).select("frame_start", "frame_end"), "frame_start") == [(3, 5), (8, 9)]


def joint_series(spark, values, conf=1.0):
    return spark.createDataFrame([(1, i, 0, v, v, conf if v is not None else 0.0) for i, v in enumerate(values)], "video_id long, frame_idx long, joint long, x double, y double, conf double")


def test_smoothing(spark):
    get = lambda df: [r.x for r in df.orderBy("frame_idx").collect()]
    assert get(pose.moving_average(joint_series(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), ["x", "y"])) == pytest.approx([2, 2.5, 3, 3.5, 4])
    assert get(pose.exponential(joint_series(spark, [0.0, 2.0, None, 4.0]), ["x", "y"])) == pytest.approx([0, 1, 3, 2.5])
    assert get(pose.one_euro(joint_series(spark, [5.0, 5.0, 5.0]), ["x", "y"], 30.0)) == pytest.approx([5, 5, 5])


def boxes(spark, data):
    return spark.createDataFrame(data, "video_id long, object_id long, frame_idx long, class_name string, conf double, x1 double, y1 double, x2 double, y2 double")


def test_motion_state(spark):
    tracks = boxes(spark, [(1, 0, i, "part", 1.0, x - 1.0, 0.0, x + 1.0, 2.0) for i, x in enumerate([0, 0, 0, 0, 40, 40, 40, 40])])
    got = [r.motion_state for r in states.motion(tracks).orderBy("frame_idx").collect()]
    assert (got[0], got[3], got[7]) == ("static", "moving", "static")


def test_events_merge_and_average_from_the_left(spark):
    kind = "video_id long, hand string, object_id long, label string, frame_start long, frame_end long, confidence double"
    one = spark.createDataFrame([(1, "left", 0, "grasp", 0, 4, 0.6), (1, "left", 0, "grasp", 8, 12, 0.8), (1, "left", 0, "grasp", 15, 20, 0.5)], kind)
    assert [(r.frame_start, r.frame_end, round(r.confidence, 6)) for r in contacts.merged(one).collect()] == [(0, 20, 0.6)]
    two = spark.createDataFrame([(1, "left", 0, "grasp", 0, 4, 0.6), (1, "left", 0, "grasp", 11, 15, 0.6)], kind)
    assert contacts.merged(two).count() == 2


def test_grasp_rule(spark):
    kind = "video_id long, hand string, object_id long, frame_start long, frame_end long, duration long, hand_motion double, object_motion double, correlation double"
    feature = spark.createDataFrame([(1, "left", 0, 0, 4, 5, 0.0, 20.0, 0.8)], kind)
    state = spark.createDataFrame([(1, 0, f, "unknown", "unknown") for f in range(5)], "video_id long, object_id long, frame_idx long, support_relation string, containment string")
    got = contacts.interactions(feature, state).first()
    assert (got.label, round(got.confidence, 6)) == ("grasp", 0.82)


def test_tracker_drops_only_the_first_sight():
    tracker = Tracker()
    out = [tracker.update(f, [("part", 1.0, (0, 0, 10, 10))]) for f in range(4)]
    assert out == [[], [(0, 0)], [(0, 0)], [(0, 0)]]
    for f in range(4, 41):
        assert tracker.update(f, []) == []
    assert tracker.update(41, [("part", 1.0, (0, 0, 10, 10))]) == [(0, 0)]  # empty frames never prune


def test_segments(spark):
    b = spark.createDataFrame([(1, f, "motion_start", 0.7, [1]) for f in (4, 10, 12)], "video_id long, frame_idx long, trigger string, confidence double, objects array<long>")
    totals = spark.createDataFrame([(1, 30), (2, 7)], "video_id long, num_frames long")
    got = rows(actions.segments(b, totals, 5).select("video_id", "seg_id", "frame_start", "frame_end"), "video_id", "seg_id")
    assert got == [(1, 0, 0, 3), (1, 1, 4, 9), (1, 2, 12, 29), (2, 0, 0, 6)]


def test_gaps_between_segments_close_in_the_middle(spark):
    kind = "video_id long, seg_id long, frame_start long, frame_end long, confidence double, objects array<long>, t_start double, t_end double"
    got = actions.closed(spark.createDataFrame([(1, 0, 0, 9, 0.5, [1], 0.0, 0.3), (1, 1, 12, 20, 0.5, [1], 0.4, 0.7)], kind)).orderBy("seg_id").collect()
    assert [(r.frame_start, r.frame_end) for r in got] == [(0, 10), (11, 20)]
    assert got[0].t_end == pytest.approx(10 / 30) and got[1].t_start == got[0].t_end


def test_short_segments_merge_and_limits_hold(spark):
    kind = "video_id long, seg_id long, frame_start long, frame_end long, confidence double, objects array<long>"
    df = spark.createDataFrame([(1, 0, 0, 1, 0.4, [1]), (1, 1, 2, 20, 0.8, [2]), (1, 2, 21, 22, 0.6, [3])], kind)
    assert rows(actions.merged_short(df, 5).select("frame_start", "frame_end"), "frame_start") == [(0, 22)]
    assert actions.limited(df, 2).count() == 2


def test_causal_edge_needs_half(spark):
    segment = spark.createDataFrame([(1, 0, 0, 30, [1, 2]), (1, 1, 31, 60, [1, 2])], "video_id long, seg_id long, frame_start long, frame_end long, objects array<long>")
    state = "motion_state string, support_relation string, interaction_state string, containment string"
    pre = spark.createDataFrame([(1, 1, 1, "static", "table", "none", "none"), (1, 1, 2, "moving", "table", "none", "none")], f"video_id long, seg_id long, object_id long, {state}")
    kind = f"video_id long, seg_id long, object_id long, {state}, changes array<struct<dimension:string>>"
    post = spark.createDataFrame([(1, 0, 1, "static", "table", "none", "none", [("motion_state",)]), (1, 0, 2, "static", "table", "none", "none", [])], kind)
    causal = graph.causal_edges(segment, pre, post)
    assert causal.count() == 0  # (0.8 + 0.1) / 2
    assert rows(graph.temporal_edges(segment, causal).select("source", "target", "gap_frames"), "source") == [(0, 1, 1)]


def test_chains(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(4)], "video_id long, seg_id long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3)], "video_id long, source long, target long")
    assert sorted(r.path for r in graph.chains(edges).collect()) == [[0, 1, 3], [0, 2, 3]]
    assert [r.seg_id for r in graph.roots(nodes, edges).collect()] == [0] and [r.seg_id for r in graph.leaves(nodes, edges).collect()] == [3]
    assert rows(graph.topological(nodes, edges).select("seg_id", "level"), "seg_id") == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_chains_are_counted_over_all_edges_and_lengths(spark):
    far = [(1, a, b) for a in range(40) for b in range(a + 1, 40)]  # a path of k nodes for each choice of k - 2 of 38
    edges = spark.createDataFrame([*far, (2, 0, 9), (2, 9, 4), (2, 3, 9)], "video_id long, source long, target long")
    got = {(r.video_id, r.path_length): int(r.num_paths) for r in graph.chain_counts(edges).collect()}
    assert got == {**{(1, k): math.comb(38, k - 2) for k in range(2, 41)}, (2, 3): 2}
    assert graph.chain_counts(edges.limit(0)).count() == 0


def test_causal_paths_cross_far_segments(spark):
    from taskloom.plans.queries import Tables

    edges = [(r.video_id, r.source, r.target) for r in Tables(spark, SF).causal.collect()]
    ahead, targets = collections.defaultdict(list), {(v, b) for v, _, b in edges}
    for v, a, b in edges:
        ahead[v, a].append((v, b))

    @functools.cache
    def below(node):
        if node not in ahead:
            return {1: 1}
        return sum((collections.Counter({k + 1: n for k, n in below(b).items()}) for b in ahead[node]), collections.Counter())

    want = collections.Counter()
    for node in ahead:
        if node not in targets:
            want.update({(node[0], k): n for k, n in below(node).items()})
    assert {(r.video_id, r.path_length): int(r.num_paths) for r in QUERIES["causal_chains"](spark, SF).collect()} == want
    assert any(b - a > 2 for _, a, b in edges)


def test_similarity_is_recovered(spark):
    points = [(j, 50.0 + 31 * j % 400, 60.0 + 17 * j % 300) for j in range(17)]
    data = [(1, 0, j, x, y, 1.0, 0.004 * x - 1.2, 0.004 * y - 0.8, 0.1) for j, x, y in points]
    joints = spark.createDataFrame(data, "video_id long, frame_idx long, joint long, x double, y double, conf double, x3 double, y3 double, z3 double")
    fit = ego.image_fit(joints).first()
    assert (fit["scale"], fit.tx, fit.ty) == pytest.approx((0.004, -1.2, -0.8))
    assert ego.image_fit(joints.where("joint < 2")).count() == 0


def test_upright_body_looks_ahead(spark):
    at = {"left_shoulder": (-0.2, 0, 0), "right_shoulder": (0.2, 0, 0), "left_eye": (-0.03, -0.3, 0), "right_eye": (0.03, -0.3, 0)}
    data = [(1, 0, pose.J[n], 1.0, *map(float, p)) for n, p in at.items()]
    joints = spark.createDataFrame(data, "video_id long, frame_idx long, joint long, conf double, x3 double, y3 double, z3 double")
    h = ego.head_pose(joints, gaze_down=0.0, offset=0.0).first()
    assert (h.forward_x, h.forward_y, h.forward_z) == pytest.approx((0, 0, 1), abs=1e-5)
    assert (h.up_x, h.up_y, h.up_z) == pytest.approx((0, -1, 0), abs=1e-5)
    assert h.confidence == 1.0


def test_graph_files_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, 0, 9, "pick"), (1, 1, 10, 20, "place")], "video_id long, seg_id long, frame_start long, frame_end long, label string")
    edges = spark.createDataFrame([(1, 0, 1, "causal", 0.85, None)], "video_id long, source long, target long, edge_type string, confidence double, gap_frames long")
    found = files.graph_json(graph.metadata(nodes, edges), nodes, edges)
    files.write_json(found, str(tmp_path / "g"))
    n, e = files.read_graph(spark, str(tmp_path / "g"))
    assert rows(n, "seg_id") == rows(nodes, "seg_id") and rows(e, "source") == rows(edges, "source")
    back = files.from_graphml(files.graphml(found)).orderBy("kind", "a").collect()
    assert [(r.kind, r.a, r.b) for r in back] == [("edge", 0, 1), ("node", 0, None), ("node", 1, None)]
    assert back[1].attributes["label"] == "pick"


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("tracking:\n  iou: 0.5\n  unheard: 1\nother: 2\n")
    got = config.load(str(path))
    assert got.tracking.iou == 0.5 and got.tracking.max_age == 30 and config.load("/nowhere") == config.Settings()
    config.save(got, str(path))
    assert config.load(str(path)) == got


def test_live_contacts_equal_the_batch(spark):
    near = spark.createDataFrame([(1, "left", 0, i, float(i), 10.0 if f else 90.0) for i, f in enumerate([1, 1, 0, 0, 1, 0, 0, 0, 1, *[0] * 30])], "video_id long, hand string, object_id long, frame_idx long, t double, distance double")
    from taskloom.plans.queries import stream
    from taskloom.streaming import live

    got = live.run_to_end(live.live_contacts(live.stamped(stream(spark, near, "t"), delay="2 seconds")))
    place = ["video_id", "hand", "object_id", "frame_idx", "is_contact"]
    assert sorted(map(tuple, got.select(place).collect())) == sorted(map(tuple, contacts.contacts(near).select(place).collect()))


def test_live_tracks_equal_the_batch(spark):
    from taskloom.plans.queries import stream
    from taskloom.streaming import live

    boxes = [(1, f, float(f), d, "cup", 0.9, 10.0 * d + f, 0.0, 10.0 * d + f + 8, 9.0) for f in range(40) for d in range(2) if f % 9 or d]
    found = spark.createDataFrame(boxes, "video_id long, frame_idx long, t double, det_idx long, class_name string, conf double, x1 double, y1 double, x2 double, y2 double")
    got = live.run_to_end(live.live_tracks(live.stamped(stream(spark, found, "t"), delay="3 seconds")))
    want = objects.tracked(found.drop("t"), found.select("video_id", "frame_idx").distinct(), min_hits=2)
    place = ["video_id", "track_id", "frame_idx", "det_idx"]
    assert sorted(map(tuple, got.select(place).collect())) == sorted(map(tuple, want.select(place).collect()))


@pytest.mark.parametrize("name", ["frames_sampled", "timeline_fix_monotonic", "track_gap_fill", "contact_hysteresis", "pose_one_euro", "joint_angles", "interaction_labels", "fingertip_grab", "fingertip_smoothed", "hand_frames", "detections_cached", "pose_history", "recorder_actions", "stream_fingertips"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    norm = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_long_series_fold_in_batches(spark):
    times = [i / 10 - (1 if i % 50 == 49 else 0) for i in range(500)]
    want, before, last = [], None, None
    for t in times:
        t = last + (1 / 30 if before is None else last - before) if last is not None and t <= last else t
        before, last = last, t
        want.append(t)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = frames(spark, times).unionByName(frames(spark, times, 2))
        got = rows(timeline.fixed(df).select("video_id", "frame_idx", "t"), "video_id", "frame_idx")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [r[2] for r in got] == pytest.approx(want * 2)


def test_times_of_a_video(spark):
    videos = spark.createDataFrame([(1, 3, 10.0, 0.0), (2, 2, 10.0, 5.0)], "video_id long, num_frames long, fps double, t0 double")
    got = rows(timeline.from_times(videos, frames(spark, [0, 1, 0.5])).select("video_id", "t", "timestamp_source"), "video_id", "frame_idx")
    assert got == [(1, 0.0, "video"), (1, 1.0, "video"), (1, 2.0, "video"), (2, 5.0, "synthetic"), (2, 5.1, "synthetic")]
    with pytest.raises(Exception, match="another length"):
        timeline.from_times(videos, frames(spark, [0, 1])).collect()


def test_misaligned_series_are_found(spark):
    totals = spark.createDataFrame([(1, 3)], "video_id long, num_frames long")
    tracks = spark.createDataFrame([(1, 0, i) for i in range(3)] + [(1, 7, 0)], "video_id long, object_id long, frame_idx long")
    found = timeline.misaligned(totals, frames(spark, [0, 1]), tracks)
    assert rows(found.select("part", "object_id", "found"), "part") == [("object", 7, 1), ("pose", None, 2)]


@pytest.mark.parametrize("policy, want", [("none", (1, 1, 0, 0)), ("resize", (0.5, 0.75, 0, 0)), ("letterbox", (0.5, 0.5, 0, 60)), ("crop_center", (0.75, 0.75, -80, 0))])
def test_resizing_maps_points_both_ways(spark, policy, want):
    from taskloom.functions import geometry

    df = spark.createDataFrame([(640.0, 480.0, 100.0, 50.0)], "w double, h double, x double, y double")
    df = df.withColumns(geometry.resizing(policy, F.col("w"), F.col("h"), 320, 360))
    u, v = geometry.to_processed(F.col("x"), F.col("y"))
    x, y = geometry.to_original(F.col("u"), F.col("v"))
    r = df.withColumns({"u": u, "v": v}).withColumns({"x_": x, "y_": y}).first()
    assert (r.scale_x, r.scale_y, r.pad_left, r.pad_top) == pytest.approx(want)
    assert (r.x_, r.y_) == pytest.approx((100, 50))


def test_neighbours_in_the_graph(spark):
    edge = spark.createDataFrame([(1, 0, 2, "causal"), (1, 1, 2, "temporal"), (1, 0, 1, "causal")], "video_id long, source long, target long, edge_type string")
    assert rows(graph.predecessors(edge), "seg_id") == [(1, 1, [0]), (1, 2, [0, 1])]
    assert rows(graph.successors(edge, "causal"), "seg_id") == [(1, 0, [1, 2])]


def test_first_person_files(spark):
    import json

    out = [json.loads(r.json) for r in QUERIES["export_ego"](spark, SF).collect()]
    assert all(d["num_frames"] == len(d["frames"]) for d in out)
    assert all([f["frame_idx"] for f in d["frames"]] == list(range(d["num_frames"])) for d in out)
    every = [f for d in out for f in d["frames"]]
    assert all(len(f["left_arm"]["keypoints_3d"]) == 3 for f in every if f["left_arm"]) and any(f["objects"] for f in every)


def test_the_whole_engine(spark):
    got = {r.table for r in QUERIES["engine_tables"](spark, SF).where("rows > 0").collect()}
    assert {"frames", "timelines", "joints", "contact_frames", "object_frames", "boundaries", "action_segments", "graph_metadata", "ego_frames", "ego_objects"} <= got


TOUCHED = "video_id long, side string, frame_idx long, object_id long, is_contact boolean, is_grab boolean, grab_confidence double, cx double, cy double"


def test_contacts_last_over_frames_in_which_the_object_is_hidden(spark):
    # touched in frame 0 only; hidden in 1 and 2, back in 3: one of four frames is not over 40 percent, one of two is
    found = spark.createDataFrame([(1, "left", 0, 7, True, False, 0.0, 5.0, 6.0), (1, "left", 3, 7, False, False, 0.0, 5.0, 6.0), (1, "left", 1, 8, True, True, 0.4, 1.0, 2.0), (1, "left", 2, 8, False, False, 0.0, 1.0, 2.0)], TOUCHED)
    hands = spark.createDataFrame([(1, "left", i) for i in range(4)], "video_id long, side string, frame_idx long")
    got = rows(contacts.smoothed_contacts(found, hands).select("frame_idx", "object_id", "contact", "contact_x", "contact_y", "grabs"), "frame_idx")
    assert got == [(0, 7, True, None, None, False), (1, 8, True, None, None, True), (2, 8, True, 1.0, 2.0, False), (3, 7, False, None, None, False)]


def test_live_fingertips_and_resets(spark):
    from taskloom.plans.queries import stream
    from taskloom.streaming import live

    at = [(1, "left", i, float(i), None if i % 4 == 3 else i % 3, i % 5 < 2, i % 7 < 3, 0.4, i == 20) for i in range(40)]
    schema = "video_id long, side string, frame_idx long, t double, object_id long, is_contact boolean, is_grab boolean, grab_confidence double, reset boolean"
    data = spark.createDataFrame(at, schema)
    got = live.run_to_end(live.live_fingertips(live.stamped(stream(spark, data, "t"), delay="2 seconds")))
    want = []
    for part in (data.where("frame_idx < 20"), data.where("frame_idx > 20")):
        found = part.where("object_id is not null").select("video_id", "side", "frame_idx", "object_id", "is_contact", "is_grab", "grab_confidence", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
        want += contacts.smoothed_contacts(found, part).select("frame_idx", "object_id", "contact", "grabs", "grab_confidence").collect()
    assert sorted(map(tuple, got.select("frame_idx", "object_id", "contact", "grabs", "grab_confidence").collect())) == sorted(map(tuple, want))


def test_a_reset_clears_live_tracks_and_contacts(spark):
    from taskloom.plans.queries import stream
    from taskloom.streaming import live

    box = [(1, f, float(f), None if f == 5 else 0, "cup", 0.9, 0.0, 0.0, 9.0, 9.0, f == 5) for f in range(10)]
    found = spark.createDataFrame(box, "video_id long, frame_idx long, t double, det_idx long, class_name string, conf double, x1 double, y1 double, x2 double, y2 double, reset boolean")
    got = rows(live.run_to_end(live.live_tracks(live.stamped(stream(spark, found, "t"), delay="2 seconds"))).select("frame_idx", "track_id"), "frame_idx")
    assert got == [(f, 0) for f in (1, 2, 3, 4, 7, 8, 9)]  # numbers begin anew, and the first sight is dropped again
    near = spark.createDataFrame([(1, "left", 0, f, float(f), 10.0, f == 5) for f in range(10)], "video_id long, hand string, object_id long, frame_idx long, t double, distance double, reset boolean")
    got = rows(live.run_to_end(live.live_contacts(live.stamped(stream(spark, near, "t"), delay="2 seconds"))).select("frame_idx", "is_contact"), "frame_idx")
    assert got == [(f, f not in (0, 6)) for f in range(10) if f != 5]


def test_recording_by_command(spark):
    given = [(1, 1.0, 0, "start", "pick", 4), (1, 3.0, 0, "start", "place", None), (1, 3.5, 0, "stop", None, None), (1, 5.5, 0, "record", None, None), (1, 7.0, 0, "end", None, None), (1, 7.5, 0, "end", None, None), (1, 7.6, 0, "clear", None, None), (1, 8.5, 0, "start", "rest", 1)]
    commands = spark.createDataFrame(given, "video_id long, t double, seq int, command string, action string, object_id long")
    shown = frames(spark, range(10))
    got = rows(recorder.recorded(shown, commands).select("take", "position", "frame_idx"), "take", "position")
    assert got == [(0, p, f) for p, f in enumerate([0, 1, 2, 3, 6, 7])] + [(1, 0, 8), (1, 1, 9)]
    got = rows(recorder.annotated(shown, commands).drop("video_id"), "take", "frame_start")
    assert got == [(0, "pick", 4, 2, 4), (0, "place", None, 4, 6), (1, "rest", 1, 1, 2)]
    assert recorder.annotated(shown, commands.limit(0)).count() == 0 and recorder.recorded(shown, commands.limit(0), on=False).count() == 0


def test_cached_detections_and_held_poses(spark):
    found = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (1, 3, "c")], "video_id long, frame_idx long, class_name string")
    assert rows(recorder.cached(frames(spark, range(5)), found, skip=2).select("frame_idx", "source_frame", "class_name"), "frame_idx") == [(0, 0, "a"), (1, 0, "a"), (2, 0, "a"), (3, 3, "c"), (4, 3, "c")]
    joints = spark.createDataFrame([(1, i, 0, float(i)) for i in range(4)], "video_id long, frame_idx long, joint long, x double")
    held = recorder.held_poses(joints, ["x"], last=2).orderBy("frame_idx").collect()
    assert [[tuple(h) for h in r.held] for r in held] == [[(0, 0.0)], [(0, 0.0), (1, 1.0)], [(1, 1.0), (2, 2.0)], [(2, 2.0), (3, 3.0)]]


def test_hand_frames_and_pinch_in_space(spark):
    points = [(1, 0, "left", i, float(i), 0.0, 0.5, 0.0, 3.0 * (i == 4), 4.0 * (i == 8)) for i in reversed(range(21))]
    marks = spark.createDataFrame(points, "video_id long, frame_idx long, side string, landmark long, x double, y double, conf double, x3 double, y3 double, z3 double")
    (hand,) = contacts.hand_frames(marks).collect()
    assert hand.landmarks_2d == [[float(i), 0.0] for i in range(21)] and hand.landmarks_3d[8] == [0.0, 0.0, 4.0] and hand.is_detected
    assert hand.overall_confidence == 0.5 and contacts.hand_geometry(marks).first().pinch_3d == 5.0
    assert contacts.hand_frames(marks.drop("z3")).first().landmarks_3d is None


def test_models_run_in_tasks(spark):
    from taskloom.sources import models

    class Bright:  # a local class travels by value
        def __init__(self, least=10):
            self.least = least

        def detect_batch(self, images):
            return [[("light", b / 255, (i, 0, i + 1, 1)) for i, b in enumerate(image) if b >= self.least] for image in images]

        def estimate_batch(self, images):
            return [[[(i, i + 1, b / 255) for i, b in enumerate(image)]] if image else [] for image in images]

        def lift(self, points, conf, size):
            return [(x / size[0], y / size[1], 0.0) for x, y in points], conf / 2

    models.register("detector", "bright", Bright)
    with pytest.raises(ValueError, match="unknown detector: dark"):
        models.named("detector", "dark")
    with pytest.raises(ValueError, match="unknown kind"):
        models.register("ears", "bright", Bright)
    images = spark.createDataFrame([(1, 0, bytes([51, 5])), (1, 1, b""), (2, 0, bytes([30, 40]))], "video_id long, frame_idx long, image binary")

    for least, want in ((10, [(1, 0, 0), (2, 0, 0), (2, 0, 1)]), (35, [(1, 0, 0), (2, 0, 0)])):
        assert rows(models.detected(images, models.named("detector", "bright"), least=least).select("video_id", "frame_idx", "det_idx"), "video_id", "det_idx") == want
    joints = models.posed(images, Bright)
    assert rows(joints.select("video_id", "person", "joint", "x", "y"), "video_id", "joint") == [(1, 0, 0, 0.0, 1.0), (1, 0, 1, 1.0, 2.0), (2, 0, 0, 0.0, 1.0), (2, 0, 1, 1.0, 2.0)]
    solid = models.lifted(joints, Bright, (2, 4)).where("video_id = 1")
    assert rows(solid.select("joint", "x3", "y3", "conf3"), "joint") == [(0, 0.0, 0.25, 0.1), (1, 0.5, 0.5, pytest.approx(5 / 510))]
