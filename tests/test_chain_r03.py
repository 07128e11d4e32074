"""Findings on the time of the chain from boxes to segments (F11, F13 to F20, F22, F23, F25, F26): what its shared steps shuffle and sort."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from taskloom.functions import lineage, temporal
from taskloom.operators import actions, contacts, states


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hysteresis_sorts_once_and_nulls_say_nothing(spark):
    flags = [None, True, None, True, True, False, False, None, False, False, False, True, True]
    rows = spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "k int, frame_idx long, f boolean")
    found = temporal.hysteresis(rows, ["k"], F.col("f"), 2, 3, "on")
    assert planned(found).count("Sort [") == 1
    assert [r.on for r in found.orderBy("frame_idx").collect()] == [False] * 4 + [True] * 6 + [False] * 2 + [True]


def test_support_and_containment_of_a_frame_need_no_join(spark):
    box = "video_id long, frame_idx long, object_id long, class_name string, x1 double, y1 double, x2 double, y2 double"
    rows = [(0, 0, 1, "fixture", 0.0, 50.0, 100.0, 90.0), (0, 0, 2, "part", 10.0, 30.0, 20.0, 60.0), (0, 0, 3, "box", 0.0, 0.0, 100.0, 100.0), (0, 0, 4, "bin", 5.0, 5.0, 50.0, 80.0), (0, 0, 5, "part", None, None, None, None), (0, 1, 2, "part", 10.0, 30.0, 20.0, 60.0)]
    found = states.contained(states.supported(spark.createDataFrame(rows, box)))
    assert "Join" not in planned(found)
    got = {(r.frame_idx, r.object_id): (r.support, r.containment) for r in found.collect()}
    # the part's bottom is near the fixture's top, and the first container around it is the box
    assert got == {(0, 1): ("table", "in_box"), (0, 2): ("fixture", "in_box"), (0, 3): ("table", "none"), (0, 4): ("table", "in_box"), (0, 5): ("unknown", "unknown"), (1, 2): ("table", "none")}


def test_features_are_taken_along_the_contacts_own_rows(spark):
    frames = [0, 1, 2, 3, 5, 8, 9]  # runs 0-3, 5, 8-9
    rows = [(0, "left", 1, f, f != 9, 3.0 * f, 0.0, float(f * f), 0.0, "table" if f else "hand", "none" if f < 3 else "in_bin") for f in frames]
    near = spark.createDataFrame(rows, "video_id long, hand string, object_id long, frame_idx long, is_contact boolean, wx double, wy double, cx double, cy double, support string, containment string")
    found = contacts.features(near)
    assert "Join" not in planned(found) and planned(found).count("Exchange") == 1
    got = [tuple(r[c] for c in ("frame_start", "frame_end", "duration", "hand_motion", "object_motion", "correlation", "s_start", "c_end")) for r in found.orderBy("frame_start").collect()]
    assert got == [(0, 3, 4, 9.0, 9.0, 0.0, "hand", "in_bin"), (5, 5, 1, 0.0, 0.0, 0.0, "table", "in_bin"), (8, 8, 1, 0.0, 0.0, 0.0, "table", "in_bin")]


def test_both_sets_of_marked_frames_meet_the_tracks_in_one_join(spark):
    tracks = spark.createDataFrame([(0, 1, f, "static", "table", "none") for f in range(4)], "video_id long, object_id long, frame_idx long, motion_state string, support string, containment string")
    of = lambda *frames: spark.createDataFrame([(0, 1, f) for f in frames], "video_id long, object_id long, frame_idx long")
    found = states.refined(tracks, of(1, 1, 2), of(2, 3))
    assert planned(found).count("Join") == 1
    got = [(r.support_relation, r.interaction_state) for r in found.orderBy("frame_idx").collect()]
    assert got == [("table", "none"), ("table", "in_contact"), ("hand", "grasped"), ("hand", "grasped")]


def test_boundaries_of_a_frame_are_gathered_as_rows(spark):
    """A row for each boundary is shuffled, not a candidate for each field of evidence."""
    state = spark.createDataFrame([(0, 1, f, "moving" if f > 1 else "static", "hand" if f > 1 else "table", "none", "none") for f in range(4)], f"video_id long, object_id long, frame_idx long, {', '.join(d + ' string' for d in states.DIMENSIONS)}")
    found = actions.merged_boundaries(actions.state_boundaries(state))
    assert "max_by" not in planned(found)
    row = found.first()
    assert (row.trigger, row.confidence, row.objects, row.evidence.prev_state, row.evidence.curr_support, row.evidence.label) == ("motion_start", 0.8, [1], "static", "hand", None)


def test_the_sessions_setting_is_as_before_when_a_table_was_written(spark):
    before = spark.conf.get(lineage.ALL_KEYS)
    assert lineage.kept(spark.range(3)).count() == 3
    with pytest.raises(PySparkException):
        lineage.kept(spark.range(3).select(F.raise_error(F.lit("no"))))
    assert spark.conf.get(lineage.ALL_KEYS) == before


def test_fingertips_meet_boxes_as_a_list_of_their_hand(spark):
    """one join by frame; not a row for each fingertip and box, aggregated again."""
    points = [(0, 0, "right", i, 10.0 * i, 5.0, 0.5) for i in range(21)] + [(0, 1, "right", 4, 1.0, 1.0, 0.5)]  # no palm in the second frame
    landmarks = spark.createDataFrame(points, "video_id long, frame_idx long, side string, landmark int, x double, y double, conf double")
    tracks = spark.createDataFrame([(0, f, 1, 75.0, 0.0, 125.0, 10.0) for f in (0, 1)], "video_id long, frame_idx long, object_id long, x1 double, y1 double, x2 double, y2 double")
    found = contacts.fingertip_contacts(landmarks, tracks)
    assert planned(found).count("Join") == 1
    row = found.collect()
    assert [(r.frame_idx, r.is_contact, r.is_grab, r.touch_x, r.touch_y) for r in row] == [(0, True, True, 80.0, 5.0)]
    # tips at 80 and 120 are inside and weigh 0.75 each; 160 is 35 away; the pinch is 40; the palm at 75 is on the box's edge
    assert row[0].grab_confidence == pytest.approx(1.5 / 2.5 * 0.4 + 0.6 * 0.3 + 0.3)
