"""What the fourth round of findings asked for."""

import math
import random
from functools import reduce
from itertools import accumulate, groupby

import duckdb
import pandas as pd
import pytest
from test_findings_r03 import Mark

from taskloom.functions import lineage
from taskloom.operators import contacts, pose
from taskloom.plans import engine, queries
from taskloom.streaming import live

NEAR = "video_id long, hand string, object_id long, frame_idx long, is_contact boolean, wx double, wy double, cx double, cy double"


def test_features_have_the_last_digits_of_the_sql(spark):
    """confidences that are equal but for the last digit decide which boundary stays, so steps are summed up in the SQL engine's order and with its roundings."""
    hand = [(9, 4), (9, 4), (9, 2), (9, 4), (8, 1), (9, 4), (9, 0), (9, 4), (5, 0), (9, 4)]
    things = [[(0, 0), (7, 5), (7, 5), (7, 5), (5, 1), (7, 5), (7, 5), (7, 5), (5, 5), (7, 5)], [(7, 5)] * 3 + [(0, 0)] * 7, [(0, 0)] * 6 + [(7, 5)] * 3 + [(5, 1)], [(7, 5), (5, 1)] * 5]
    path = lambda steps: [(float(x), float(y)) for x, y in accumulate([(0, 0), *steps], lambda p, s: (p[0] + s[0], p[1] + s[1]))]
    rows = [(v, "left", 1, f, True, *p, *q) for v, steps in enumerate(things) for f, (p, q) in enumerate(zip(path(hand), path(steps), strict=True))]
    found = contacts.features(spark.createDataFrame(rows, NEAR).repartition(4)).orderBy("video_id").collect()
    for r, steps in zip(found, things, strict=True):
        a, b = ([math.hypot(*s) for s in reversed(w)] for w in (hand, steps))
        want = duckdb.connect().execute("SELECT sum(a), sum(b), covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) FROM (SELECT unnest(?::DOUBLE[]) AS a, unnest(?::DOUBLE[]) AS b)", [a, b]).fetchone()
        assert (r.frame_start, r.frame_end, r.hand_motion, r.object_motion, r.correlation) == (0, 10, *want)


def test_correlations_of_odd_steps_raise_nothing():
    assert contacts.correlation([1.0] * 3, [1.0, 2.0, 4.0]) == 0.0
    assert contacts.correlation([1.0, 2.0, 4.0], [2.0, 4.0, 8.0]) == pytest.approx(1.0)
    for odd in (math.nan, math.inf, 1e308):
        assert math.isnan(contacts.correlation([1.0, odd, 4.0, -odd], [odd, 4.0, -odd, 8.0]))


def held_one_by_one(rows, marks, size, keep):
    """What is held of each joint, row by row: ``rows`` are (ts, video, joint, frame, conf, reset), taken at each mark."""
    rings, seen, out = {}, {}, []
    for before, mark in zip([-1, *marks], marks):
        now = sorted((r for r in rows if before < r[0] <= mark), key=lambda r: (r[3], r[0]))
        for part in {r[1:3] for r in now}:
            ring = rings.get(part, [])
            for _, group in groupby((r for r in now if r[1:3] == part), key=lambda r: r[3]):
                group, silent = list(group), False
                for r in group:
                    silent = silent or part in seen and r[0] - seen[part] > keep
                    seen[part] = max(r[0], seen.get(part, r[0]))
                ring = [] if silent or any(r[5] for r in group) else ring
                for r in (r for r in group if not r[5]):
                    ring = [*ring, (r[3], r[4])][-size:]
                    out.append((*part, r[3], tuple(ring)))
            rings[part] = ring
        for part in list(seen):
            latest = max(at for other, at in seen.items() if other[0] == part[0])
            waits = any(r[1] == part[0] and r[0] > mark for r in rows)
            if not rings[part] or latest - seen[part] > keep or (latest + keep <= mark and not waits):
                del seen[part], rings[part]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(12))
def test_held_poses_of_many_joints_are_taken_together(seed):
    """a timer takes all rows of its recordings as columns, and holds them as one value; resets, silences, equal frames and unordered times as row by row."""
    some = random.Random(seed)
    rows = [(some.randrange(400) * (1 if some.random() < 0.7 else 3), some.randrange(3), some.randrange(2), some.randrange(30), some.choice([None, 0.1, 0.2, 0.7]), some.random() < 0.1) for _ in range(150)]
    rows = list({r[:4]: r for r in rows}.values())
    marks, size, keep = [150, 160, 400, 700, 1300], 4, 90
    want = held_one_by_one(rows, marks, size, keep)
    for made in (live.Poses(["reset"], size, keep), live.HeldPoses(["reset"], size, keep)):
        mark, got = Mark(), []
        made.init(mark)
        for before, mark.at in zip([-1, *marks], marks):
            # all later rows wait too
            frame = pd.DataFrame([(pd.Timestamp(t, unit="ms"), v, j, f, 1.0, None, c, z) for t, v, j, f, c, z in (rows if before < 0 else [])], columns=["ts", "video_id", "joint", "frame_idx", "x", "y", "conf", "reset"])
            list(made.handleInputRows((0,), iter([frame]), mark))
            for out in made.handleExpiredTimer((0,), mark, None):
                got += out.astype(object).where(out.notna(), None).itertuples(index=False, name=None)
            assert len(made.rings.rows) <= 1 and not made.state.rows
        if type(made) is live.Poses:
            assert {(h["x"], h["y"]) for r in got for h in r[3]} <= {(1.0, None)}
            assert sorted(((*r[:3], tuple((h["frame_idx"], h["conf"]) for h in r[3])) for r in got), key=str) == want
        else:
            key = lambda r: (r[:5], r[5] is not None, r[5])
            assert sorted(got, key=key) == sorted(((*r[:3], len(r[3]), r[3][0][0], None if any(c is None for _, c in r[3]) else reduce(float.__add__, (c for _, c in r[3]), 0.0)) for r in want), key=key)


def test_the_tables_of_a_run_lie_by_recording(spark, tmp_path):
    """each table was shuffled again for what is made of it; what is counted by recording, and joined by recording and frame, is read where it lies."""
    spark.range(200).selectExpr("id % 9 as user_id", "timestamp_seconds(id) as ts", "id as event_id", "'view' as event_type", "0.5D as value").write.parquet(f"{tmp_path}/events.parquet")
    t = queries.Tables(spark, str(tmp_path), shared=True)
    tables = engine.Engine().run(t.frames, t.joints, detections=queries.detections(t), landmarks=queries.marked(t))
    spark.conf.set(lineage.ALL_KEYS, "false")
    try:
        for name in ("frames", "joints", "contact_frames", "interactions", "object_frames", "boundaries", "action_segments", "ego_frames", "ego_objects", "ego_arms", "ego_hands", "ego_landmarks", "ego_pinches"):
            assert "Exchange" not in tables[name].groupBy("video_id").count()._jdf.queryExecution().executedPlan().toString(), name
    finally:
        spark.conf.unset(lineage.ALL_KEYS)
    assert {n: tables[n].count() for n in ("frames", "joints", "ego_frames")} == {"frames": 200, "joints": 3400, "ego_frames": 200}


@pytest.mark.parametrize("smooth", [pose.exponential, lambda j, c: pose.one_euro(j, c, 30.0)])
def test_columns_that_are_missing_apart_are_smoothed_in_one_pass(spark, smooth):
    """pixels and metres were smoothed apart and joined again."""
    joints = spark.range(300).selectExpr("id % 3 as video_id", "id div 6 as frame_idx", "id div 3 % 2 as joint", "0.5D as conf", "if(id % 7 > 1, double(id * id % 101), null) as x", "if(id % 7 > 1, double(id % 13), null) as y", "if(id % 5 > 0, double(id % 31), null) as x3")
    sets, key = [["x", "y"], ["x3"]], ["video_id", "joint", "frame_idx"]
    both = smooth(joints, sets)
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    for columns in sets:
        rows = [sorted(map(tuple, df.select(*key, *columns).collect()), key=lambda r: r[:3]) for df in (both, smooth(joints, columns))]
        assert rows[0] == rows[1] and len(rows[0]) == 300
