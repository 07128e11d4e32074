"""Live recording: due frames, commands, takes, rates, held poses, the live view; and what happens at a restart."""

import json
import time

import pytest
from pyspark.sql import functions as F

from taskloom.operators import body_view, recorder
from taskloom.sources.ticks import FrameTicks, Ticks
from taskloom.streaming import live, recording


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_frames_fall_due_by_the_clock():
    ticks = Ticks({"recordings": json.dumps([[1, 10, 5.0], [2, 3, 1.0]]), "begin": "100"})
    assert ticks.due(99.9) == {"1": 0, "2": 0} and ticks.due(100.0) == {"1": 1, "2": 1}
    assert ticks.due(101.0) == {"1": 6, "2": 2} and ticks.due(999.0) == {"1": 10, "2": 3}
    parts = ticks.partitions({"1": 6, "2": 3}, {"1": 10, "2": 3})
    assert [list(ticks.read(p)) for p in parts] == [[(1, i, i / 5.0) for i in range(6, 10)]]
    with pytest.raises(ValueError, match="above 0"):
        Ticks({"recordings": "[[1, 2, 0]]", "begin": "0"})


def test_a_restarted_loop_neither_loses_nor_repeats_frames(spark, tmp_path):
    spark.dataSource.register(FrameTicks)
    out = f"file://{tmp_path}/rows"

    def run(enough):
        frames = spark.readStream.format("frame_ticks").option("recordings", json.dumps([[1, 60, 10.0], [2, 25, 5.0]])).option("begin", str(begin)).load()
        query = frames.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="200 milliseconds").start()
        until = time.time() + 120
        while time.time() < until and sum(p["numInputRows"] for p in query.recentProgress) < enough:
            assert query.exception() is None
            time.sleep(0.1)
        query.stop()
        return spark.read.schema(frames.schema).parquet(out).count()

    begin = time.time() - 0.5
    first = run(1)
    assert 0 < first
    while time.time() < begin + 7:
        time.sleep(0.1)
    run(85 - first)
    assert rows(spark.read.parquet(out).select("video_id", "frame_idx"), "video_id", "frame_idx") == [(1, i) for i in range(60)] + [(2, i) for i in range(25)]


GIVEN = "video_id long, t double, seq long, command string, action string, object_id long"


def commands():
    frames = [(v, float(i), i, None, None, None) for v in (1, 2) for i in range(12)]
    given = [(1, 1.0, 0, "start", "pick", 4), (1, 3.0, 0, "start", "place", None), (1, 3.5, 0, "stop", None, None), (1, 5.5, 0, "record", None, None), (1, 7.0, 0, "end", None, None), (1, 7.6, 0, "clear", None, None), (1, 8.5, 0, "start", "rest", 1), (1, 10.0, 0, "save", None, None), (2, 5.0, 0, "stop", None, None)]
    return frames, given


def replay(spark, data, path, parts):
    """The rows as a stream: a batch for each part, and a closing one."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, data.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(0.05 * (i < len(parts) - 1))
    return spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_recording_live_equals_the_batch_also_after_a_restart(spark, tmp_path):
    frames, given = commands()
    data = spark.createDataFrame([*frames, *given], GIVEN)
    every = sorted([*frames, *given], key=lambda r: r[1])
    path, out = f"file://{tmp_path}", f"file://{tmp_path}/out"
    rest = [every[15:], [(None, 900.0, None, None, None, None)]]
    stream = replay(spark, data, path, [every[:15]])
    # the first run ends before the later rows are there
    live.run_to_end(recording.live_recorder(live.stamped(stream, delay="2 seconds")), out)
    for part in rest:
        replay(spark, data, path, [part])
        found = live.run_to_end(recording.live_recorder(live.stamped(spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), delay="2 seconds")), out)
    shown, told = spark.createDataFrame([(v, s, t) for v, t, s, *_ in frames], "video_id long, frame_idx long, t double"), spark.createDataFrame(given, GIVEN)
    assert rows(found.where("kind = 'frame'").select("video_id", "take", "position", "frame_idx"), "video_id", "take", "position") == rows(recorder.recorded(shown, told).select("video_id", "take", "position", "frame_idx"), "video_id", "take", "position")
    want = rows(recorder.annotated(shown, told).select("video_id", "take", "action", "object_id", "frame_start", "frame_end"), "video_id", "take", "frame_start")
    assert rows(found.where("kind = 'action'").select("video_id", "take", "action", "object_id", "frame_start", "frame_end"), "video_id", "take", "frame_start") == want


def test_a_batch_that_is_written_again_is_there_once(spark, tmp_path):
    path = f"file://{tmp_path}/takes"
    sink = recording.takes_sink(path)
    batch = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 6), (2, 0, 0, 9)], "video_id long, take long, position long, frame_idx long")
    later = spark.createDataFrame([(1, 1, 0, 7)], batch.schema)
    for number, df in ((0, batch), (1, later), (1, later), (0, batch)):
        sink(df, number)
    held = lambda last: rows(recording.taken(spark, path, batch.schema, last).select("video_id", "take", "position", "frame_idx"), "video_id", "take", "position")
    assert held(True) == [(1, 1, 0, 7), (2, 0, 0, 9)]
    assert held(False) == [(1, 0, 0, 5), (1, 0, 1, 6), (1, 1, 0, 7), (2, 0, 0, 9)]


def test_the_meter_follows_the_batches(spark, tmp_path):
    meter = recording.Meter()
    spark.streams.addListener(meter)
    try:
        data = spark.createDataFrame([(1, float(i)) for i in range(30)], "video_id long, t double")
        stream = replay(spark, data, f"file://{tmp_path}", [[(1, float(i)) for i in range(a, a + 10)] for a in (0, 10, 20)])
        query = recording.metered(stream).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        done, until = str(query.id), time.time() + 20
        while meter.rows.get(done, 0) < 30 and time.time() < until:
            time.sleep(0.1)
        rate = 0.0
        for p in query.recentProgress:
            if p["numInputRows"]:
                rate = recording.metre(rate, p["numInputRows"], p["durationMs"]["triggerExecution"] / 1000)
        assert meter.rows[done] == 30 and meter.rates[done] == pytest.approx(rate)
    finally:
        spark.streams.removeListener(meter)


def test_rates_have_the_closed_form(spark):
    times, t = [], 0.0
    for i in range(1500):
        times.append(t)
        t += 0.0 if i % 97 == 5 else 0.02 + 0.01 * (i % 3)
    got = [r.rate for r in recording.metred(spark.createDataFrame([(1, i, x) for i, x in enumerate(times)], "video_id long, frame_idx long, t double")).orderBy("frame_idx").collect()]
    want, rate = [], 0.0
    for a, b in zip([None, *times], times, strict=False):
        rate = 0.0 if a is None else 0.9 * rate + 0.1 / max(b - a, 0.001)
        want.append(rate)
    assert got == pytest.approx(want, rel=1e-9)


def test_keys_without_rows_are_forgotten_and_resets_clear_the_ring(spark, tmp_path):
    day = live.KEEP / 1000
    data = [(1, 0, i, float(i), float(i), 0.5, float(i), i == 4) for i in range(8)] + [(2, 0, 0, 0.0, 0.0, 0.5, 2 * day + 60, False), (1, 0, 9, 9.0, 9.0, 0.5, 2 * day + 120, False)]
    df = spark.createDataFrame(data, "video_id long, joint long, frame_idx long, x double, y double, conf double, t double, reset boolean")
    parts = [data[:8], data[8:9], data[9:], [(None, None, None, None, None, None, 9 * day, None)]]
    found = live.run_to_end(live.live_poses(live.stamped(replay(spark, df, f"file://{tmp_path}", parts), delay="2 seconds"), last=3), f"file://{tmp_path}/out")
    held = {r.frame_idx: [h.frame_idx for h in r.held] for r in found.where("video_id = 1").collect()}
    assert held == {0: [0], 1: [0, 1], 2: [0, 1, 2], 3: [1, 2, 3], 5: [5], 6: [5, 6], 7: [5, 6, 7], 9: [9]}


def test_the_live_view_of_a_stream_is_that_of_a_table(spark, tmp_path):
    joint = [(5, 100.0, 100.0, 0.9), (6, 200.0, 100.0, 0.9), (7, 90.0, 150.0, 0.9), (9, 80.0, 200.0, 0.9), (8, 210.0, 150.0, 0.2), (10, 220.0, 200.0, 0.9)]
    hand = lambda x: [(i, x + i, 200.0 + i % 4, None) for i in range(21)]
    schema = "video_id long, frame_idx long, joints array<struct<joint:long,x:double,y:double,conf:double>>, hands array<struct<det_idx:int,side:string,points:array<struct<landmark:long,x:double,y:double,z:double>>>>, objects array<struct<object_id:long,x1:double,y1:double,x2:double,y2:double>>"
    df = spark.createDataFrame([(1, 0, joint, [(0, "right", hand(60.0)), (1, "right", hand(70.0))], [(7, 190.0, 90.0, 210.0, 110.0)]), (1, 1, None, None, None)], schema)
    got = body_view.seen(df, 640, 480).orderBy("frame_idx").collect()
    assert got[0].right_arm is None and got[0].right_hand is None and got[1].left_arm is None and got[1].objects == []
    wrist = got[0].left_arm[2]
    assert (wrist.x, wrist.y, wrist.z) == pytest.approx((-0.6 + (80 - 150) / 100 * 0.3, 0.6 + 100 / 480 * 0.5, 0.6 + 1.0 * 0.2))
    assert (got[0].objects[0].object_id, got[0].objects[0].x, got[0].objects[0].z) == (7, pytest.approx(0.4), pytest.approx(1.2 - 20 / 640 * 1.5))
    assert got[0].left_hand.points[0].x == pytest.approx(-0.5 + (0 - 10) / 20 * 0.4) and got[0].left_hand.pinch_distance == pytest.approx(4 / 20) and got[0].left_hand.pinching
    df.write.parquet(f"file://{tmp_path}/in")
    out = live.run_to_end(body_view.seen(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), 640, 480), f"file://{tmp_path}/out")
    assert out.orderBy("frame_idx").collect() == got


def test_codes_do_not_depend_on_how_rows_lie(spark):
    from taskloom.functions.codes import coded

    values = [None, "b", "a", "é", "b", None, "c"] * 30 + [f"v{i:03}" for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "label string")
    want = sorted({v for v in values if v is not None}, key=str.encode)
    for parts in (1, 7):
        got = {r.label: (r.code, r.rows) for r in coded(df.repartition(parts), "label").collect()}
        assert got == {None: (0, 60)} | {v: (i + 1, values.count(v)) for i, v in enumerate(want)}


def test_a_worker_loads_a_model_once(spark, tmp_path):
    import os

    from taskloom.sources import models

    class Falsy:
        def __init__(self, folder):
            with open(f"{folder}/loads", "a") as file:
                file.write(f"{os.getpid()}\n")

        def __bool__(self):
            return False

        def detect_batch(self, images):
            return [[("x", 1.0, (0, 0, 1, 1))] for _ in images]

    images = spark.createDataFrame([(1, i, b"x") for i in range(40)], "video_id long, frame_idx long, image binary").repartition(20)
    assert models.detected(images, Falsy, folder=str(tmp_path)).count() == 40
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads))
