"""What the third round of findings asked for."""

import duckdb
import pandas as pd

from taskloom.functions import lineage, temporal
from taskloom.operators import body_view, ego, pose
from taskloom.plans import queries
from taskloom.streaming import live


def test_rows_of_frames_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    """compressed frames look small, the lists made of them are not."""
    spark.range(200).selectExpr("0L as user_id", "timestamp_seconds(id) as ts", "id as event_id", "'view' as event_type", "0.5D as value").write.parquet(f"{tmp_path}/events.parquet")
    t = queries.Tables(spark, str(tmp_path))
    plans = [body_view.nested(t.frames, t.joints, t.landmarks, t.tracks), t.joints.join(t.tracks, ["video_id", "frame_idx"])]
    for plan in plans:
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_six_decimals_round_as_in_the_sql(spark):
    """the double just below 0.5046875 prints as that, and the SQL rounds it down."""
    value = 0.3 + 1 * 0.15 + 35.0 / 320 * 0.5
    values = [value, 0.44999999999999996 + 0.0546875, 0.5046875, -0.5046875, 1.0000005, 2.5e-7]
    sql = duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").orderBy("i").select(queries.r("v")).collect()
    assert [r[0] for r in found] == [r[0] for r in sql]


def test_joints_are_smoothed_where_their_gaps_were_filled(spark):
    """no shuffle beside that of the windows, and no call for each joint; the batches may cut a joint anywhere."""
    joints = spark.range(600).selectExpr("id % 7 as video_id", "id div 21 as frame_idx", "id div 7 % 3 as joint", "double(id * id % 101) as x", "double(id % 13) as y", "0.5D as conf")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    for smooth in (pose.exponential, lambda j, c: pose.one_euro(j, c, 30.0)):
        assert exchanges(smooth(joints, ["x", "y"])) == exchanges(pose.filled(joints, ["x", "y"]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    for size in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(map(tuple, pose.exponential(joints, ["x", "y"]).select("video_id", "joint", "frame_idx", "x", "y").collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1]
    state = {}
    for v, j, f, x, _ in found[1]:
        given = float(next(i for i in range(600) if (i % 7, i // 21, i // 7 % 3) == (v, f, j)) ** 2 % 101)
        state[v, j] = given if (v, j) not in state else 0.5 * given + 0.5 * state[v, j]
        assert x == state[v, j]


def test_a_recordings_joints_and_pairs_share_a_key_of_the_live_queries():
    """each key costs calls to the state store in every batch."""
    for made in (live.Poses([], 3, live.KEEP), live.Contacts([], 50.0, 2, 3, live.KEEP)):
        rows = [dict(ts=ts, n=n, frame_idx=n, joint=j, hand="left", object_id=j, x=0.0, y=0.0, conf=1.0, distance=1.0) for ts, n, j in ((0, 0, 1), (0, 0, 2), (1, 1, 2), (live.KEEP + 1, 2, 1), (live.KEEP + 1, 2, 2))]
        parts = dict(made.by_part(rows, ["joint"], {}))
        assert [(p, [(r["frame_idx"], r["fresh"]) for r in got]) for p, got in parts.items()] == [((1,), [(0, False), (2, True)]), ((2,), [(0, False), (1, False), (2, False)])]


def test_shared_tables_lie_by_recording(spark, tmp_path):
    """what is made of frames, and joined with it, is not shuffled again."""
    spark.range(200).selectExpr("id % 9 as user_id", "timestamp_seconds(id) as ts", "id as event_id", "'view' as event_type", "0.5D as value").write.parquet(f"{tmp_path}/events.parquet")
    t = queries.Tables(spark, str(tmp_path), shared=True)
    heads, moving = queries.by_recording(ego.head_pose(t.joints)), t.moving
    spark.conf.set(lineage.ALL_KEYS, "false")
    try:
        rows = ego.in_head_frame(t.joints.withColumnsRenamed({"x3": "px", "y3": "py", "z3": "pz"}), heads).join(moving.drop("conf"), ["video_id", "frame_idx"])
        plan = rows.groupBy("video_id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(lineage.ALL_KEYS)
    assert "Exchange" not in plan
    assert heads.count() == 200 and moving.count() == 600 and rows.count() == 200 * 17 * 3


class Held:
    """A list state that counts its calls."""

    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def clear(self):
        self.put([])

    def appendValue(self, row):
        self.calls.append("append")
        self.rows.append(row)


class Mark(list):
    """Stands for the handle, which makes states and timers, and for the watermark."""

    at = 0

    def getListState(self, name, schema):
        return Held(self)

    def registerTimer(self, at):
        self.append("timer")

    def getCurrentWatermarkInMs(self):
        return self.at


def test_recordings_share_a_key_of_the_live_queries_and_stay_apart():
    """F8, F9: the calls to the store don't grow with the recordings; a recording that was silent is forgotten, the others go on."""
    made, mark = live.Contacts([], 50.0, 2, 3, 1000), Mark()
    made.init(mark)
    give = lambda ts, videos, distance: list(made.handleInputRows((0,), iter([pd.DataFrame({"ts": pd.to_datetime([ts] * len(videos), unit="ms"), "video_id": videos, "frame_idx": [ts] * len(videos), "hand": "left", "object_id": 0, "distance": distance})]), mark))

    def then(at):
        mark.at = at
        return {(r.video_id, r.frame_idx): r.is_contact for out in made.handleExpiredTimer((0,), mark, None) for r in out.itertuples()}

    every = list(range(50))
    give(10, every, 1.0)
    assert then(10) == {(v, 10): False for v in every} and len(mark) <= 12
    give(900, every[:20], 1.0)
    give(1200, every, 1.0)
    assert then(900) == {(v, 900): True for v in every[:20]}
    # those silent for more than 1000 ms begin anew
    assert then(1200) == {(v, 1200): v < 20 for v in every}
    assert then(2201) == {} and not made.seen.rows and not made.state.rows


def test_a_fold_over_a_table_in_buckets_takes_each_key_whole(spark):
    """the shuffle was left out as the table lay by key, and its files were then read in any tasks."""
    rows = lineage.kept(spark.range(4000).selectExpr("id % 40 as video_id", "id as frame_idx").repartition(8), by="video_id")

    def step(parts):
        yield pd.DataFrame({"n": [sum(len(p) for p in parts)]})

    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # a task for each file, as with large ones
    try:
        found = [r.n for r in temporal.folded(rows, ["video_id"], ["frame_idx"], step, "n long").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [100] * 40


def test_rows_of_the_live_queries_wait_as_one_batch():
    """Spark converts what the state holds value by value, so rows wait as one value; gaps stay gaps, and numbers beside them whole."""
    made, mark = live.Fingers([], 5, 10**12), Mark()
    made.init(mark)
    rows = pd.DataFrame({"ts": pd.to_datetime([20, 10, 30], unit="ms"), "video_id": 1, "side": "right", "frame_idx": [1, 0, 2], "object_id": [2.0, 2**53, None], "is_contact": [True, False, None], "is_grab": [False, True, None], "grab_confidence": [0.0, 0.75, None]})
    list(made.handleInputRows((0,), iter([rows]), mark))
    assert [len(r) for r in made.waiting.rows] == [1] and isinstance(made.waiting.rows[0][0], bytes)
    mark.at = 25
    first = [tuple(r)[1:] for out in made.handleExpiredTimer((0,), mark, None) for r in out.itertuples()]
    assert first == [(1, "right", 0, 2**53, False, True, 0.75), (1, "right", 1, 2, True, False, 0.0)]
    assert live.unpacked(made.waiting.rows[0][0]).to_pylist() == [{"ts": 30, "video_id": 1, "side": "right", "frame_idx": 2, "object_id": None, "is_contact": None, "is_grab": None, "grab_confidence": None}]
