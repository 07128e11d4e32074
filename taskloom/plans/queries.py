"""The operators on recordings derived from ``events``, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.functions import codes
from taskloom.functions.geometry import center
from taskloom.functions.lineage import kept, large, shared_dir
from taskloom.operators import body_view as body_view_
from taskloom.operators import actions, contacts, ego, graph, objects, pose, recorder, states, timeline
from taskloom.plans import engine
from taskloom.plans.oracles import sql
from taskloom.sources import adapter, files
from taskloom.sources.config import Segments, Settings
from taskloom.streaming import recording

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, once: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle, once)
        return f

    return keep


def r(name: str, as_: str | None = None) -> Column:
    """Six decimals as the SQL's engine rounds: the product with a million is rounded, not the decimal text, which differ at a half."""
    return (F.round(F.col(name) * 1e6) / 1e6).alias(as_ or name)


def n(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def by_recording(rows: DataFrame) -> DataFrame:
    return kept(rows, by="video_id")


class Tables:
    """The derived tables of a folder.  Those that several others are built on are kept, so that each is computed once and
    plans stay small; they lie by recording, and so do the frames where many tables are made of them (``shared``)."""

    def __init__(self, spark: SparkSession, sf_dir: str, shared: bool = False):
        self.frames = large(by_recording(adapter.frames(spark, sf_dir)) if shared else adapter.frames(spark, sf_dir))
        self.totals = timeline.summary(self.frames).select("video_id", "num_frames")
        self.tracks = adapter.object_frames(self.frames)
        self.joints = adapter.pose_joints(self.frames)
        self.landmarks = adapter.landmarks(self.frames)

    @cached_property
    def moving(self) -> DataFrame:
        """With support and containment."""
        return large(by_recording(states.contained(states.supported(states.motion(self.tracks)))))

    @cached_property
    def contact(self) -> DataFrame:
        return large(by_recording(contacts.contacts(contacts.distances(contacts.hand_positions(self.joints), self.moving))))

    @cached_property
    def features(self) -> DataFrame:
        return contacts.features(self.contact)

    @cached_property
    def interactions(self) -> DataFrame:
        return contacts.interactions(self.features)

    @cached_property
    def events(self) -> DataFrame:
        return large(by_recording(contacts.events(self.interactions)))

    @cached_property
    def states(self) -> DataFrame:
        return large(by_recording(states.refined(self.moving, contacts.contact_frames(self.contact), contacts.grasp_frames(self.events))))

    @cached_property
    def boundaries(self) -> DataFrame:
        return large(by_recording(actions.merged_boundaries(actions.contact_boundaries(self.events), actions.state_boundaries(self.states))))

    @cached_property
    def raw_segments(self) -> DataFrame:
        return actions.timed(actions.segments(self.boundaries, self.totals, 2), self.frames)

    @cached_property
    def segments(self) -> DataFrame:
        return large(by_recording(actions.closed(self.raw_segments)))

    @cached_property
    def labelled(self) -> DataFrame:
        return actions.labelled(self.segments, self.events, self.states)

    @cached_property
    def causal(self) -> DataFrame:
        segment, state = self.segments, self.states
        return kept(graph.causal_edges(segment, graph.preconditions(segment, state), graph.postconditions(segment, state, self.totals)))

    @cached_property
    def edges(self) -> DataFrame:
        causal = self.causal
        return graph.edges(causal, graph.temporal_edges(self.segments, causal))


@query("SELECT video_id, frame_idx // 3 AS frame_idx, frame_idx AS source_idx, round(t, 6) AS t FROM ev WHERE frame_idx % 3 = 0")
def frames_sampled(spark, sf_dir):
    kept = timeline.sampled(Tables(spark, sf_dir).frames, 30.0, 10.0)
    return kept.select("video_id", "frame_idx", "source_idx", r("t"))


@query("SELECT video_id, num_frames, round(t0, 6) AS t0, round(duration, 6) AS duration FROM tot")
def frames_timeline(spark, sf_dir):
    return timeline.summary(Tables(spark, sf_dir).frames).select("video_id", "num_frames", r("t0"), r("duration"))


@query("""SELECT video_id, min(frame_idx) = 0 AND max(frame_idx) = count(*) - 1 AS contiguous, coalesce(min(d) > -1e-6, true) AS monotonic, coalesce(min(d) > 0, true) AS increasing,
  coalesce(abs(CASE WHEN max(t) > min(t) THEN (count(*) - 1) / (max(t) - min(t)) END - 30) <= 1, true) AS rate_fits FROM (SELECT *, t - lag(t) OVER (PARTITION BY video_id ORDER BY frame_idx) AS d FROM ev) GROUP BY video_id""")
def timeline_validate(spark, sf_dir):
    return timeline.validated(Tables(spark, sf_dir).frames, 30.0)


def shaken(frames: DataFrame) -> DataFrame:
    return frames.withColumn("t", F.when(F.col("event_id") % 7 == 0, F.col("t") - 50000).otherwise(F.col("t")))


@query("""SELECT video_id, frame_idx, round(b, 6) AS t FROM (WITH RECURSIVE s AS (SELECT video_id, frame_idx, CASE WHEN event_id % 7 = 0 THEN t - 50000 ELSE t END AS t FROM ev), f AS (
  SELECT video_id, frame_idx, CAST(NULL AS DOUBLE) AS a, t AS b FROM s WHERE frame_idx = 0 UNION ALL
  SELECT s.video_id, s.frame_idx, f.b, CASE WHEN s.t <= f.b THEN f.b + CASE WHEN f.a IS NULL THEN 1e0 / 30e0 ELSE f.b - f.a END ELSE s.t END FROM f JOIN s ON s.video_id = f.video_id AND s.frame_idx = f.frame_idx + 1) SELECT * FROM f)""")
def timeline_fix_monotonic(spark, sf_dir):
    return timeline.fixed(shaken(Tables(spark, sf_dir).frames).select("video_id", "frame_idx", "t")).select("video_id", "frame_idx", r("t"))


@query("""SELECT q.video_id, q.probe, arg_min(e.frame_idx, (abs(e.t - q.t), e.frame_idx)) AS frame_idx FROM (SELECT video_id, i AS probe, t0 + i / 0.00013e0 AS t FROM (SELECT video_id, t0, unnest(range(CAST(floor(duration * 0.00013e0) AS BIGINT) + 1)) AS i FROM tot)) q JOIN ev e ON e.video_id = q.video_id GROUP BY q.video_id, q.probe""")
def nearest_align(spark, sf_dir):
    t = Tables(spark, sf_dir)
    probes = timeline.resampled(t.frames, 0.00013).withColumnRenamed("frame_idx", "probe")
    return timeline.nearest_frames(probes, t.frames).select("video_id", "probe", "frame_idx")


@query("""SELECT q.video_id, q.probe, round(coalesce(a.value + (b.value - a.value) * CASE WHEN b.t > a.t THEN (q.t - a.t) / (b.t - a.t) ELSE 0 END, a.value, b.value), 6) AS value
  FROM (SELECT video_id, i AS probe, t0 + i / 0.00013e0 AS t FROM (SELECT video_id, t0, unnest(range(CAST(floor(duration * 0.00013e0) AS BIGINT) + 1)) AS i FROM tot)) q ASOF LEFT JOIN ev a ON a.video_id = q.video_id AND a.t <= q.t ASOF LEFT JOIN ev b ON b.video_id = q.video_id AND b.t > q.t""")
def linear_align(spark, sf_dir):
    t = Tables(spark, sf_dir)
    probes = timeline.resampled(t.frames, 0.00013).withColumnRenamed("frame_idx", "probe")
    return timeline.interpolated(probes, t.frames.select("video_id", "t", "value"), "value").select("video_id", "probe", r("value"))


@query("SELECT video_id, i AS frame_idx, round(t0 + i / 0.0001e0, 6) AS t FROM (SELECT video_id, t0, unnest(range(CAST(floor(duration * 0.0001e0) AS BIGINT) + 1)) AS i FROM tot)")
def resample_timeline(spark, sf_dir):
    return timeline.resampled(Tables(spark, sf_dir).frames, 0.0001).select("video_id", "frame_idx", r("t"))


@query("SELECT q.video_id, q.frame_idx, round(coalesce(e.t, t0 + q.frame_idx / 30e0), 6) AS t FROM (SELECT video_id, t0, unnest(range(num_frames + 10)) AS frame_idx FROM tot) q LEFT JOIN ev e ON e.video_id = q.video_id AND e.frame_idx = q.frame_idx")
def frame_times(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = timeline.summary(t.frames).select("video_id", F.explode(F.expr("sequence(0L, num_frames + 9)")).alias("frame_idx"))  # some beyond the end
    return timeline.times_of(rows, t.frames, 30.0).select("video_id", "frame_idx", r("t"))


@query("SELECT video_id, frame_idx, object_id, round(conf, 6) AS conf FROM obj WHERE conf >= 0.65e0")
def det_filter(spark, sf_dir):
    return objects.confident(Tables(spark, sf_dir).tracks, 0.65).select("video_id", "frame_idx", "object_id", r("conf"))


IOU_SQL = """SELECT video_id, frame_idx, class_name, a_id, b_id, round(CASE WHEN ax1 IS NULL OR bx1 IS NULL THEN NULL WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou FROM (SELECT *, (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - i AS u FROM (
  SELECT a.video_id, a.frame_idx, a.class_name, a.object_id AS a_id, b.object_id AS b_id, a.x1 AS ax1, a.x2 AS ax2, a.y1 AS ay1, a.y2 AS ay2, b.x1 AS bx1, b.x2 AS bx2, b.y1 AS by1, b.y2 AS by2,
  CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) THEN (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) ELSE 0 END AS i
  FROM obj a JOIN (SELECT video_id, object_id, class_name, frame_idx + 1 AS frame_idx, x1, y1, x2, y2 FROM obj) b ON a.video_id = b.video_id AND a.frame_idx = b.frame_idx AND a.class_name = b.class_name))"""


@query(IOU_SQL, once=("obj",))
def box_iou_pairs(spark, sf_dir):
    tracks = Tables(spark, sf_dir).tracks
    return objects.iou_pairs(tracks, tracks.withColumn("frame_idx", F.col("frame_idx") + 1)).select("video_id", "frame_idx", "class_name", "a_id", "b_id", r("iou"))


def detections(t: Tables) -> DataFrame:
    return t.tracks.where("x1 is not null").withColumn("det_idx", F.col("object_id"))


@query()
def track_iou(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return objects.tracked(detections(t), t.frames).select("video_id", "track_id", "frame_idx", "det_idx")


@query()
def track_trajectories(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = detections(t)
    emitted = objects.tracked(found, t.frames).join(found.drop("object_id"), ["video_id", "frame_idx", "det_idx"]).withColumnRenamed("track_id", "object_id")
    return objects.trajectories(emitted, t.frames).select("video_id", "object_id", "frame_idx", "class_name", r("conf"), "x1", "y1", "x2", "y2")


GAP_SQL = f"""SELECT video_id, object_id, frame_idx, {", ".join(f"round(CASE WHEN fill THEN p{c} + (n{c} - p{c}) * (frame_idx - pf) / (nf - pf) ELSE {c} END, 6) AS {c}" for c in objects.BOX)}, round(CASE WHEN fill THEN (pc + (nc - pc) * (frame_idx - pf) / (nf - pf)) * 0.5e0 ELSE conf END, 6) AS conf, fill AS filled
  FROM (SELECT *, x1 IS NULL AND pf IS NOT NULL AND nf IS NOT NULL AND coalesce(nf - pf - 1 <= 10, false) AS fill FROM (SELECT *,
  {", ".join(f"last_value({c} IGNORE NULLS) OVER p AS p{c}, first_value({c} IGNORE NULLS) OVER q AS n{c}" for c in objects.BOX)}, last_value(pcf IGNORE NULLS) OVER p AS pc, last_value(pi IGNORE NULLS) OVER p AS pf, first_value(pcf IGNORE NULLS) OVER q AS nc, first_value(pi IGNORE NULLS) OVER q AS nf
  FROM (SELECT *, CASE WHEN x1 IS NOT NULL THEN conf END AS pcf, CASE WHEN x1 IS NOT NULL THEN frame_idx END AS pi FROM obj)
  WINDOW p AS (PARTITION BY video_id, object_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY video_id, object_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))"""


@query(GAP_SQL)
def track_gap_fill(spark, sf_dir):
    return objects.interpolated(Tables(spark, sf_dir).tracks).select("video_id", "object_id", "frame_idx", *map(r, objects.BOX), r("conf"), "filled")


@query("""SELECT video_id, object_id, frame_idx, round(CASE WHEN conf > 0 AND lag(conf) OVER w > 0 THEN sqrt(((x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w) ** 2 + ((y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w) ** 2) * 30 ELSE 0 END, 6) AS speed
  FROM obj WINDOW w AS (PARTITION BY video_id, object_id ORDER BY frame_idx)""")
def object_velocity(spark, sf_dir):
    return objects.speeds(Tables(spark, sf_dir).tracks, 30.0).select("video_id", "object_id", "frame_idx", r("speed"))


@query("SELECT video_id, object_id, frame_idx, motion_state FROM mot")
def motion_state(spark, sf_dir):
    return states.motion(Tables(spark, sf_dir).tracks).select("video_id", "object_id", "frame_idx", "motion_state")


@query("SELECT video_id, object_id, frame_idx, support FROM sup")
def support_state(spark, sf_dir):
    return states.supported(Tables(spark, sf_dir).tracks).select("video_id", "object_id", "frame_idx", "support")


@query("SELECT video_id, object_id, frame_idx, containment FROM cnt")
def containment_state(spark, sf_dir):
    return states.contained(Tables(spark, sf_dir).tracks).select("video_id", "object_id", "frame_idx", "containment")


@query("SELECT video_id, object_id, frame_idx, motion_state, support_relation, interaction_state, containment FROM st")
def object_states_full(spark, sf_dir):
    return Tables(spark, sf_dir).states.select("video_id", "object_id", "frame_idx", *states.DIMENSIONS)


@query('SELECT video_id, object_id, frame_idx, dimension, "from" AS before, "to" AS after FROM chg')
def state_changes(spark, sf_dir):
    return states.changes(Tables(spark, sf_dir).states).select("video_id", "object_id", "frame_idx", "dimension", F.col("from").alias("before"), F.col("to").alias("after"))


@query("SELECT video_id, frame_idx, hand, round(hx, 6) AS hx, round(hy, 6) AS hy FROM hp")
def hand_positions(spark, sf_dir):
    return contacts.hand_positions(Tables(spark, sf_dir).joints).select("video_id", "frame_idx", "hand", r("hx"), r("hy"))


@query("SELECT video_id, hand, object_id, frame_idx, round(distance, 6) AS distance FROM near")
def hand_object_distance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return contacts.distances(contacts.hand_positions(t.joints), t.tracks).select("video_id", "hand", "object_id", "frame_idx", r("distance"))


@query("SELECT video_id, hand, object_id, frame_idx, is_contact FROM con")
def contact_hysteresis(spark, sf_dir):
    return Tables(spark, sf_dir).contact.select("video_id", "hand", "object_id", "frame_idx", "is_contact")


@query("SELECT DISTINCT video_id, object_id, frame_idx FROM con WHERE is_contact")
def contact_frames(spark, sf_dir):
    return contacts.contact_frames(Tables(spark, sf_dir).contact)


@query("SELECT video_id, hand, object_id, frame_start, frame_end, n FROM seg")
def contact_segments(spark, sf_dir):
    return contacts.segments(Tables(spark, sf_dir).contact)


@query("SELECT video_id, hand, object_id, frame_start, frame_end, duration, round(hand_motion, 6) AS hand_motion, round(object_motion, 6) AS object_motion, round(correlation, 4) AS correlation FROM feat")
def interaction_features(spark, sf_dir):
    return Tables(spark, sf_dir).features.select("video_id", "hand", "object_id", "frame_start", "frame_end", "duration", r("hand_motion"), r("object_motion"), F.round("correlation", 4).alias("correlation"))


@query("SELECT video_id, hand, object_id, frame_start, frame_end, label, round(confidence, 4) AS confidence FROM inter")
def interaction_labels(spark, sf_dir):
    return Tables(spark, sf_dir).interactions.select("video_id", "hand", "object_id", "frame_start", "frame_end", "label", F.round("confidence", 4).alias("confidence"))


@query("""SELECT e.video_id, e.event_id, hand, object_id, label, frame_start, frame_end, parts, round(confidence, 4) AS confidence, round(a.t, 6) AS t_start, round(b.t, 6) AS t_end, first_duration AS duration_frames, round(first_hand, 6) AS hand_motion,
  round(first_object, 6) AS object_motion, round(first_corr, 4) AS motion_correlation, CASE WHEN parts > 1 THEN true END AS merged FROM evt e JOIN ev a ON a.video_id = e.video_id AND a.frame_idx = frame_start JOIN ev b ON b.video_id = e.video_id AND b.frame_idx = frame_end""")
def contact_events(spark, sf_dir):
    t = Tables(spark, sf_dir)
    proof = [r("evidence.hand_motion", "hand_motion"), r("evidence.object_motion", "object_motion"), F.round("evidence.motion_correlation", 4).alias("motion_correlation"), "evidence.merged"]
    found = contacts.timed(t.events, t.frames)
    return found.select("video_id", "event_id", "hand", "object_id", "label", "frame_start", "frame_end", "parts", F.round("confidence", 4).alias("confidence"), r("t_start"), r("t_end"), "evidence.duration_frames", *proof)


@query("SELECT video_id, hand, object_id, frame_start, frame_end, round(greatest(0.3e0, 1 - mean_distance / 100), 6) AS confidence, round(mean_distance, 6) AS avg_distance FROM seg WHERE frame_end - frame_start + 1 >= 3")
def raw_contact_events(spark, sf_dir):
    return contacts.raw_events(Tables(spark, sf_dir).contact).select("video_id", "hand", "object_id", "frame_start", "frame_end", r("confidence"), r("evidence.avg_distance", "avg_distance"))


@query("SELECT video_id, object_id, frame_idx FROM grasp")
def grasp_frames(spark, sf_dir):
    return contacts.grasp_frames(Tables(spark, sf_dir).events)


HAND_SQL = """SELECT *, spread > 50 AS is_open, pinch < 40 AS is_grabbing FROM (SELECT video_id, frame_idx, side, wrist_x, wrist_y, palm_x, palm_y, pinch, round((SELECT avg(sqrt((l.x - px) ** 2 + (l.y - py) ** 2)) FROM lm l WHERE l.video_id = g.video_id AND l.frame_idx = g.frame_idx AND l.side = g.side AND l.landmark IN (4, 8, 12, 16, 20)), 6) AS spread FROM (
  SELECT video_id, frame_idx, side, max(CASE WHEN landmark = 0 THEN x END) AS wrist_x, max(CASE WHEN landmark = 0 THEN y END) AS wrist_y, avg(CASE WHEN landmark IN (0, 1, 5, 9, 13, 17) THEN x END) AS px, avg(CASE WHEN landmark IN (0, 1, 5, 9, 13, 17) THEN y END) AS py, round(avg(CASE WHEN landmark IN (0, 1, 5, 9, 13, 17) THEN x END), 6) AS palm_x, round(avg(CASE WHEN landmark IN (0, 1, 5, 9, 13, 17) THEN y END), 6) AS palm_y,
  round(sqrt((max(CASE WHEN landmark = 4 THEN x END) - max(CASE WHEN landmark = 8 THEN x END)) ** 2 + (max(CASE WHEN landmark = 4 THEN y END) - max(CASE WHEN landmark = 8 THEN y END)) ** 2), 6) AS pinch FROM lm GROUP BY video_id, frame_idx, side) g)"""


@query(HAND_SQL)
def hand_geometry(spark, sf_dir):
    return contacts.hand_geometry(Tables(spark, sf_dir).landmarks).select("video_id", "frame_idx", "side", "wrist_x", "wrist_y", r("palm_x"), r("palm_y"), r("pinch"), r("spread"), "is_open", "is_grabbing")


@query("SELECT video_id, frame_idx, side, object_id, is_contact, is_grab, grab_confidence, touch_x, touch_y FROM tip")
def fingertip_grab(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return contacts.fingertip_contacts(t.landmarks, t.tracks).select("video_id", "frame_idx", "side", "object_id", "is_contact", "is_grab", r("grab_confidence"), r("touch_x"), r("touch_y"))


SMOOTH_SQL = "SELECT video_id, frame_idx, side, object_id, contact, grabs, round(grab_confidence, 6) AS grab_confidence, round(contact_x, 6) AS contact_x, round(contact_y, 6) AS contact_y FROM smo"


@query(SMOOTH_SQL)
def fingertip_smoothed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = contacts.smoothed_contacts(contacts.fingertip_contacts(t.landmarks, t.tracks), t.landmarks)
    return found.select("video_id", "frame_idx", "side", "object_id", "contact", "grabs", r("grab_confidence"), r("contact_x"), r("contact_y"))


@query("""SELECT video_id, frame_idx, side AS handedness, count(*) AS num_landmarks, string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y AS BIGINT) AS VARCHAR), ';' ORDER BY landmark) AS points, round(sum(conf * landmark), 4) AS conf, round(avg(conf), 6) AS overall_confidence, true AS is_detected
  FROM lm GROUP BY video_id, frame_idx, side""")
def hand_frames(spark, sf_dir):
    """The lists of each hand: all points, which are whole numbers here, as text, and the sum of the confidences times their places."""
    found = contacts.hand_frames(Tables(spark, sf_dir).landmarks)
    points = F.array_join(F.transform("landmarks_2d", lambda p: F.concat_ws(" ", p[0].cast("long"), p[1].cast("long"))), ";")
    total = F.aggregate(F.transform("conf", lambda c, i: c * i), F.lit(0.0), lambda a, c: a + c)
    return found.select("video_id", "frame_idx", "handedness", F.size("landmarks_2d").cast("long").alias("num_landmarks"), points.alias("points"), F.round(total, 4).alias("conf"), r("overall_confidence"), "is_detected")


@query("""SELECT s.video_id, s.frame_idx, source_frame, object_id, x1, y1, x2, y2 FROM (SELECT video_id, frame_idx, max(CASE WHEN frame_idx % 4 = 0 THEN frame_idx END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS source_frame FROM ev) s
  JOIN obj o ON o.video_id = s.video_id AND o.frame_idx = source_frame WHERE x1 IS NOT NULL""")
def detections_cached(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = recorder.cached(t.frames, t.tracks.where("x1 is not null"), skip=3)
    return found.select("video_id", "frame_idx", "source_frame", "object_id", "x1", "y1", "x2", "y2")


@query("""SELECT video_id, joint, frame_idx, count(*) OVER b AS num_held, min(frame_idx) OVER b AS oldest, round(sum(conf) OVER b, 4) AS conf FROM pj
  WINDOW b AS (PARTITION BY video_id, joint ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def pose_history(spark, sf_dir):
    found = recorder.held_poses(Tables(spark, sf_dir).joints, ["conf"])
    total = F.aggregate("held", F.lit(0.0), lambda a, x: a + x["conf"])
    return found.select("video_id", n("joint"), "frame_idx", F.size("held").cast("long").alias("num_held"), F.col("held")[0]["frame_idx"].alias("oldest"), F.round(total, 4).alias("conf"))


#: Events as commands: signup clears, error stops, view records, click starts an action, purchase ends it.
COMMANDS = {"signup": "clear", "error": "stop", "view": "record", "click": "start", "purchase": "end"}


@query("""SELECT video_id, take, action, object_id, n AS frame_start, coalesce(after, total) AS frame_end FROM (SELECT *, lead(n) OVER (PARTITION BY video_id, take ORDER BY t, kind, frame_idx) AS after FROM (
  SELECT *, max(n) OVER (PARTITION BY video_id, take) AS total FROM (SELECT *, count(*) FILTER (taken) OVER (PARTITION BY video_id, take ORDER BY t, kind, frame_idx) AS n FROM (
  SELECT video_id, frame_idx, t, kind, command, 'a' || event_id % 7 AS action, event_id % 3 AS object_id, count(*) FILTER (kind = 1 AND command = 'clear') OVER w AS take,
  kind = 0 AND coalesce(last_value(CASE WHEN kind = 1 AND command IN ('record', 'stop') THEN command = 'record' END IGNORE NULLS) OVER w, true) AS taken
  FROM (SELECT video_id, frame_idx, t, event_id, unnest([0, 1]) AS kind, CASE event_type WHEN 'signup' THEN 'clear' WHEN 'error' THEN 'stop' WHEN 'view' THEN 'record' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'end' END AS command FROM ev)
  WINDOW w AS (PARTITION BY video_id ORDER BY t, kind, frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))) WHERE kind = 1 AND command IN ('start', 'end')) WHERE command = 'start'""")
def recorder_actions(spark, sf_dir):
    frames = Tables(spark, sf_dir).frames
    command = F.create_map(*(F.lit(x) for pair in COMMANDS.items() for x in pair))[F.col("event_type")]
    given = frames.select("video_id", "t", F.col("frame_idx").alias("seq"), command.alias("command"), F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("action"), (F.col("event_id") % 3).alias("object_id"))
    return recorder.annotated(frames, given)


#: Evidence of boundaries.
BOUNDARY = ["event_id", "label", "hand", "object_id", "prev_state", "curr_state", "prev_support", "curr_support", "prev_containment", "curr_containment"]
BOUNDARY_SQL = ", ".join(BOUNDARY)


@query(f"SELECT video_id, frame_idx, trigger, round(confidence, 4) AS confidence, len(objects) AS num_objects, objects[1] AS first_object, {BOUNDARY_SQL} FROM bnd")
def action_boundaries(spark, sf_dir):
    b = Tables(spark, sf_dir).boundaries
    return b.select("video_id", "frame_idx", "trigger", F.round("confidence", 4).alias("confidence"), F.size("objects").cast("long").alias("num_objects"), F.element_at("objects", 1).alias("first_object"), *(f"evidence.{c}" for c in BOUNDARY))


@query("""SELECT video_id, kf AS frame_idx, kt AS trigger, kc AS confidence FROM (WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS i, count(*) OVER (PARTITION BY video_id) AS n FROM bnd), w AS (
  SELECT video_id, i, n, frame_idx AS kf, trigger AS kt, confidence AS kc, CAST(NULL AS BIGINT) AS df, CAST(NULL AS VARCHAR) AS dt, CAST(NULL AS DOUBLE) AS dc FROM o WHERE i = 1
  UNION ALL SELECT w.video_id, o.i, w.n, CASE WHEN far OR o.confidence > kc THEN o.frame_idx ELSE kf END, CASE WHEN far OR o.confidence > kc THEN o.trigger ELSE kt END, CASE WHEN far OR o.confidence > kc THEN o.confidence ELSE kc END, CASE WHEN far THEN kf END, CASE WHEN far THEN kt END, CASE WHEN far THEN kc END
  FROM w JOIN o ON o.video_id = w.video_id AND o.i = w.i + 1, LATERAL (SELECT o.frame_idx - kf >= 3 AS far) f)
  SELECT video_id, kf, kt, kc FROM w WHERE i = n UNION ALL SELECT video_id, df, dt, dc FROM w WHERE df IS NOT NULL)""")
def boundaries_refined(spark, sf_dir):
    return actions.refined_boundaries(Tables(spark, sf_dir).boundaries)


@query(f"""SELECT sg.video_id, seg_id, frame_start, frame_end, sg.trigger, len(sg.objects) AS num_objects, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, {BOUNDARY_SQL},
  CASE WHEN sg.trigger = 'video_start' THEN true END AS pre_first_boundary, CASE WHEN sg.trigger = 'no_boundaries' THEN true END AS no_boundaries FROM sg LEFT JOIN bnd ON bnd.video_id = sg.video_id AND bnd.frame_idx = sg.frame_start""")
def segments_raw(spark, sf_dir):
    return Tables(spark, sf_dir).raw_segments.select("video_id", "seg_id", "frame_start", "frame_end", "trigger", F.size("objects").cast("long").alias("num_objects"), r("t_start"), r("t_end"), *(f"evidence.{c}" for c in [*BOUNDARY, "pre_first_boundary", "no_boundaries"]))


@query("SELECT video_id, seg_id, frame_start, frame_end, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM cl")
def segments_refined(spark, sf_dir):
    return Tables(spark, sf_dir).segments.select("video_id", "seg_id", "frame_start", "frame_end", r("t_start"), r("t_end"))


@query("""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY a) - 1 AS seg_id, a AS frame_start, b AS frame_end, round(c, 6) AS confidence, 'unknown' AS label, len(list_distinct(o)) AS num_objects FROM (WITH RECURSIVE s AS (SELECT video_id, seg_id AS i, frame_start, frame_end, confidence, objects, count(*) OVER (PARTITION BY video_id) AS n FROM sg), w AS (
  SELECT video_id, i, n, frame_start AS a, frame_end AS b, confidence AS c, CAST(objects AS BIGINT[]) AS o, frame_end - frame_start + 1 < 8 AS fresh, CAST(NULL AS BIGINT) AS da, CAST(NULL AS BIGINT) AS db, CAST(NULL AS DOUBLE) AS dc, CAST(NULL AS BIGINT[]) AS dd FROM s WHERE i = 0
  UNION ALL SELECT w.video_id, s.i, w.n, CASE WHEN one THEN a ELSE s.frame_start END, s.frame_end, CASE WHEN one THEN (c + s.confidence) / 2 ELSE s.confidence END, CASE WHEN one THEN list_concat(o, s.objects) ELSE CAST(s.objects AS BIGINT[]) END, false, CASE WHEN NOT one THEN a END, CASE WHEN NOT one THEN b END, CASE WHEN NOT one THEN c END, CASE WHEN NOT one THEN o END
  FROM w JOIN s ON s.video_id = w.video_id AND s.i = w.i + 1, LATERAL (SELECT fresh OR s.frame_end - s.frame_start + 1 < 8 AS one) f)
  SELECT video_id, a, b, c, o FROM w WHERE i = n - 1 UNION ALL SELECT video_id, da, db, dc, dd FROM w WHERE da IS NOT NULL)""")
def segment_merge_short(spark, sf_dir):
    return actions.merged_short(Tables(spark, sf_dir).raw_segments, 8).select("video_id", "seg_id", "frame_start", "frame_end", r("confidence"), "label", F.size("objects").cast("long").alias("num_objects"))


@query()
def segment_limit(spark, sf_dir):
    return actions.limited(Tables(spark, sf_dir).raw_segments, 4).select("video_id", "seg_id", "frame_start", "frame_end", r("confidence"), "label", F.size("objects").alias("num_objects"))


@query("SELECT video_id, seg_id, event_id, event_label FROM sev")
def event_segment_overlap(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return actions.events_in(t.segments, t.events)


@query("SELECT e.video_id, e.frame_idx, min(seg_id) AS seg_id FROM ev e JOIN cl s ON s.video_id = e.video_id AND e.frame_idx BETWEEN s.frame_start AND s.frame_end GROUP BY ALL")
def current_segment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return actions.current(t.frames.select("video_id", "frame_idx"), t.segments)


@query('SELECT video_id, seg_id, object_id, dimension, "from" AS before, "to" AS after FROM sch')
def segment_state_changes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return actions.changes_in(t.segments, t.states).select("video_id", "seg_id", "object_id", "dimension", F.col("from").alias("before"), F.col("to").alias("after"))


LABEL_SQL = """SELECT video_id, seg_id, num_events, num_changes, label, label AS rule_matched, CASE label WHEN 'pick' THEN 0.9e0 WHEN 'place' THEN 0.9e0 WHEN 'insert' THEN 0.85e0 WHEN 'remove' THEN 0.85e0 WHEN 'push' THEN 0.7e0 WHEN 'pull' THEN 0.7e0 WHEN 'inspect' THEN 0.6e0
  WHEN 'reach' THEN 0.5e0 WHEN 'retract' THEN 0.5e0 WHEN 'idle' THEN 0.8e0 WHEN 'unknown' THEN 0.3e0 ELSE CASE WHEN list_contains(e, 'grasp') AND list_has_any(c, ['motion_state:static:moving', 'motion_state:moving:static'])
  AND len(list_filter(c, lambda x: starts_with(x, 'support_relation'))) = 0 THEN 0.6e0 ELSE 0.4e0 END END AS label_confidence, coalesce(said, '') AS state_changes FROM lab LEFT JOIN (SELECT video_id AS v, seg_id AS s,
  string_agg('{''object_id'': ' || object_id || ', ''type'': ''' || dimension || ''', ''from'': ''' || "from" || ''', ''to'': ''' || "to" || '''}', '; ' ORDER BY object_id, list_position(['support_relation', 'motion_state', 'containment', 'interaction_state'], dimension)) AS said
  FROM sch GROUP BY ALL) x ON v = video_id AND s = seg_id"""


@query(LABEL_SQL)
def action_labels(spark, sf_dir):
    """Labels and their evidence."""
    found = Tables(spark, sf_dir).labelled
    return found.select("video_id", "seg_id", n("num_events"), n("num_changes"), "label", "evidence.rule_matched", "label_confidence", F.array_join("evidence.state_changes", "; ").alias("state_changes"))


@query("SELECT video_id, seg_id, object_id, motion_state, support_relation, interaction_state, containment FROM pre")
def preconditions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.preconditions(t.segments, t.states).select("video_id", "seg_id", "object_id", *states.DIMENSIONS)


@query("SELECT video_id, seg_id, object_id, motion_state, support_relation, interaction_state, containment, num_changes FROM post")
def postconditions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.postconditions(t.segments, t.states, t.totals).select("video_id", "seg_id", "object_id", *states.DIMENSIONS, F.size("changes").cast("long").alias("num_changes"))


@query("SELECT video_id, source, target, len(shared) AS num_shared FROM prs")
def candidate_pairs(spark, sf_dir):
    return graph.candidate_pairs(Tables(spark, sf_dir).segments).select("video_id", "source", "target", F.size("shared").cast("long").alias("num_shared"))


@query("SELECT video_id, source, target, round(confidence, 6) AS confidence, num_matched, num_shared FROM cau")
def causal_edges(spark, sf_dir):
    sizes = [F.size(f"{c}_objects").cast("long").alias(f"num_{c}") for c in ("matched", "shared")]
    return Tables(spark, sf_dir).causal.select("video_id", "source", "target", r("confidence"), *sizes)


@query("SELECT video_id, source, target, gap_frames FROM tmp")
def temporal_edges(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.temporal_edges(t.segments, t.causal).select("video_id", "source", "target", "gap_frames")


@query("SELECT video_id, seg_id, 'root' AS kind FROM cl c WHERE NOT EXISTS (SELECT 1 FROM edg e WHERE e.video_id = c.video_id AND e.target = c.seg_id) UNION ALL SELECT video_id, seg_id, 'leaf' FROM cl c WHERE NOT EXISTS (SELECT 1 FROM edg e WHERE e.video_id = c.video_id AND e.source = c.seg_id)")
def graph_roots_leaves(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nodes, edges = t.segments, t.edges
    return graph.roots(nodes, edges).withColumn("kind", F.lit("root")).unionByName(graph.leaves(nodes, edges).withColumn("kind", F.lit("leaf")))


@query("""SELECT s.video_id, s.n AS num_nodes, coalesce(e, 0) AS num_edges, coalesce(c, 0) AS num_causal, coalesce(t, 0) AS num_temporal, true AS is_dag FROM (SELECT video_id, count(*) AS n FROM cl GROUP BY 1) s LEFT JOIN (SELECT video_id, count(*) AS e, count(*) FILTER (edge_type = 'causal') AS c, count(*) FILTER (edge_type = 'temporal') AS t FROM edg GROUP BY 1) g ON g.video_id = s.video_id""")
def graph_metadata(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.metadata(t.segments, t.edges)


@query("""SELECT video_id, path_length, CAST(sum(n) AS DECIMAL(38, 0)) AS num_paths FROM (WITH RECURSIVE p AS (
  SELECT DISTINCT c.video_id, c.source AS at, CAST(1 AS BIGINT) AS path_length, CAST(1 AS HUGEINT) AS n FROM cau c WHERE NOT EXISTS (SELECT 1 FROM cau g WHERE g.video_id = c.video_id AND g.target = c.source)
  UNION ALL SELECT p.video_id, c.target, path_length + 1, CAST(sum(n) AS HUGEINT) FROM p JOIN cau c ON c.video_id = p.video_id AND c.source = p.at GROUP BY ALL)
  SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM cau g WHERE g.video_id = p.video_id AND g.source = p.at)) GROUP BY ALL""")
def causal_chains(spark, sf_dir):
    """Chains over all causal edges, of any length, counted by length."""
    return graph.chain_counts(Tables(spark, sf_dir).causal)


@query("""SELECT video_id, path, row_number() OVER (PARTITION BY video_id ORDER BY nodes) - 1 AS rank FROM (SELECT video_id, array_to_string(nodes, '>') AS path, nodes FROM (WITH RECURSIVE p AS (
  SELECT DISTINCT c.video_id, c.source AS here, [c.source] AS nodes FROM cau c WHERE NOT EXISTS (SELECT 1 FROM cau g WHERE g.video_id = c.video_id AND g.target = c.source)
  UNION ALL SELECT p.video_id, c.target, list_append(nodes, c.target) FROM p JOIN cau c ON c.video_id = p.video_id AND c.source = p.here)
  SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM cau g WHERE g.video_id = p.video_id AND g.source = p.here)))""")
def causal_paths(spark, sf_dir):
    """The chains themselves, of any length, decoded from their ranks."""
    found = graph.chains(Tables(spark, sf_dir).causal)
    return found.select("video_id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.col("rank").cast("long").alias("rank"))


@query("SELECT video_id, seg_id, row_number() OVER (PARTITION BY video_id ORDER BY level, seg_id) - 1 AS position, level FROM (SELECT c.video_id, c.seg_id, coalesce(max(n), 0) AS level FROM cl c LEFT JOIN (WITH RECURSIVE w AS (SELECT video_id, target AS seg_id, CAST(1 AS BIGINT) AS n FROM edg UNION SELECT w.video_id, e.target, n + 1 FROM w JOIN edg e ON e.video_id = w.video_id AND e.source = w.seg_id) SELECT * FROM w) x ON x.video_id = c.video_id AND x.seg_id = c.seg_id GROUP BY ALL)")
def graph_order(spark, sf_dir):
    """Nodes in topological order, and the longest path to each."""
    t = Tables(spark, sf_dir)
    nodes, edges = t.segments, kept(t.edges)
    return graph.ordered(nodes, edges).join(graph.topological(nodes, edges), ["video_id", "seg_id"]).select("video_id", "seg_id", "position", n("level"))


JOINT_GAP = """SELECT video_id, frame_idx, joint, round(CASE WHEN fill THEN px + (nx - px) * (frame_idx - pf) / (nf - pf) ELSE x END, 6) AS x, round(CASE WHEN fill THEN py + (ny - py) * (frame_idx - pf) / (nf - pf) ELSE y END, 6) AS y, fill AS filled FROM (SELECT *, x IS NULL AND coalesce(nf - pf - 1 <= 5, false) AS fill FROM (SELECT *,
  last_value(x IGNORE NULLS) OVER p AS px, last_value(y IGNORE NULLS) OVER p AS py, first_value(y IGNORE NULLS) OVER q AS ny, last_value(i IGNORE NULLS) OVER p AS pf, first_value(x IGNORE NULLS) OVER q AS nx, first_value(i IGNORE NULLS) OVER q AS nf FROM (SELECT *, CASE WHEN x IS NOT NULL THEN frame_idx END AS i FROM pj)
  WINDOW p AS (PARTITION BY video_id, joint ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY video_id, joint ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))"""


@query(JOINT_GAP)
def pose_gap_fill(spark, sf_dir):
    return pose.filled(Tables(spark, sf_dir).joints, ["x", "y"]).select("video_id", "frame_idx", "joint", r("x"), r("y"), "filled")


@query(f"SELECT g.video_id, g.frame_idx, g.joint, round(CASE WHEN p.x IS NOT NULL THEN avg(p.x) OVER (PARTITION BY p.video_id, p.joint ORDER BY p.frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE g.x END, 6) AS x, round(CASE WHEN p.x IS NOT NULL THEN avg(p.y) OVER (PARTITION BY p.video_id, p.joint ORDER BY p.frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE g.y END, 6) AS y FROM ({JOINT_GAP}) g JOIN pj p ON p.video_id = g.video_id AND p.frame_idx = g.frame_idx AND p.joint = g.joint")
def pose_moving_avg(spark, sf_dir):
    return pose.moving_average(Tables(spark, sf_dir).joints, ["x", "y"]).select("video_id", "frame_idx", "joint", r("x"), r("y"))


@query(f"""SELECT g.video_id, g.frame_idx, g.joint, round(CASE WHEN e.s IS NOT NULL THEN e.s ELSE g.x END, 6) AS x, round(CASE WHEN e.s IS NOT NULL THEN e.sy ELSE g.y END, 6) AS y FROM ({JOINT_GAP}) g LEFT JOIN (WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY video_id, joint ORDER BY frame_idx) AS k FROM pj WHERE x IS NOT NULL), f AS (
  SELECT video_id, joint, k, frame_idx, x AS s, y AS sy FROM v WHERE k = 1 UNION ALL SELECT v.video_id, v.joint, v.k, v.frame_idx, 0.5e0 * v.x + 0.5e0 * f.s, 0.5e0 * v.y + 0.5e0 * f.sy FROM f JOIN v ON v.video_id = f.video_id AND v.joint = f.joint AND v.k = f.k + 1) SELECT * FROM f) e
  ON e.video_id = g.video_id AND e.joint = g.joint AND e.frame_idx = g.frame_idx""")
def pose_ema(spark, sf_dir):
    return pose.exponential(Tables(spark, sf_dir).joints, ["x", "y"]).select("video_id", "frame_idx", "joint", r("x"), r("y"))


def _euro(c: str) -> str:
    """The filter over one coordinate."""
    return f"""(WITH RECURSIVE v AS (SELECT *, CASE WHEN lag(frame_idx) OVER (PARTITION BY video_id, joint ORDER BY frame_idx) = frame_idx - 1 THEN 1 ELSE 0 END AS follows FROM pj WHERE x IS NOT NULL), f AS (
  SELECT video_id, joint, frame_idx, {c} AS s, 0e0 AS d FROM v WHERE follows = 0 UNION ALL SELECT v.video_id, v.joint, v.frame_idx, a * v.{c} + (1 - a) * f.s, nd FROM f JOIN v ON v.video_id = f.video_id AND v.joint = f.joint AND v.frame_idx = f.frame_idx + 1 AND v.follows = 1,
  LATERAL (SELECT (2 * pi() / 30e0) / (2 * pi() / 30e0 + 1) * ((v.{c} - f.s) / (1e0 / 30e0)) + (1 - (2 * pi() / 30e0) / (2 * pi() / 30e0 + 1)) * f.d AS nd) n, LATERAL (SELECT 2 * pi() * (1 + 0.007e0 * abs(nd)) * (1e0 / 30e0) AS rr) q, LATERAL (SELECT rr / (rr + 1) AS a) al) SELECT * FROM f)"""


@query(f"""SELECT g.video_id, g.frame_idx, g.joint, round(coalesce(ex.s, g.x), 4) AS x, round(coalesce(ey.s, g.y), 4) AS y FROM ({JOINT_GAP}) g LEFT JOIN {_euro("x")} ex ON ex.video_id = g.video_id AND ex.joint = g.joint AND ex.frame_idx = g.frame_idx
  LEFT JOIN {_euro("y")} ey ON ey.video_id = g.video_id AND ey.joint = g.joint AND ey.frame_idx = g.frame_idx""")
def pose_one_euro(spark, sf_dir):
    return pose.one_euro(Tables(spark, sf_dir).joints, ["x", "y"], 30.0).select("video_id", "frame_idx", "joint", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""SELECT video_id, frame_idx, round(CASE WHEN lx IS NOT NULL AND rx IS NOT NULL THEN (lx + rx) / 2 ELSE coalesce(lx, rx) END, 6) AS x, round(coalesce(CASE WHEN lx IS NOT NULL AND rx IS NOT NULL THEN (lc + rc) / 2 ELSE coalesce(lc, rc) END, 0), 6) AS conf, lx IS NOT NULL OR rx IS NOT NULL AS valid
  FROM (SELECT video_id, frame_idx, max(CASE WHEN joint = 11 AND conf >= 0.2e0 THEN x END) AS lx, max(CASE WHEN joint = 12 AND conf >= 0.2e0 THEN x END) AS rx, max(CASE WHEN joint = 11 AND conf >= 0.2e0 THEN conf END) AS lc, max(CASE WHEN joint = 12 AND conf >= 0.2e0 THEN conf END) AS rc FROM pj GROUP BY ALL)""")
def virtual_root(spark, sf_dir):
    return pose.pelvis(Tables(spark, sf_dir).joints).select("video_id", "frame_idx", r("x"), r("conf"), "valid")


@query("SELECT video_id, frame_idx, joint, coalesce(x >= 0 AND x < 300 AND y >= 0 AND y < 280 AND conf >= 0.2e0, false) AS in_frame, coalesce(x >= 0 AND x < 300 AND y >= 0 AND y < 280 AND conf >= 0.2e0 AND conf >= 0.5e0, false) AS visible FROM pj")
def joint_visibility(spark, sf_dir):
    return pose.visibility(Tables(spark, sf_dir).joints, 300, 280).select("video_id", "frame_idx", "joint", "in_frame", "visible")


@query("""SELECT video_id, frame_idx, joint, round(x3 - CASE WHEN both_ = 2 THEN hx ELSE kx END, 6) AS x3 FROM (SELECT video_id, frame_idx, joint, CASE WHEN known THEN x3 END AS x3, sum(CASE WHEN hip THEN 1 ELSE 0 END) OVER f AS both_, avg(CASE WHEN hip THEN x3 END) OVER f AS hx, avg(CASE WHEN known THEN x3 END) OVER f AS kx
  FROM (SELECT *, conf > 0.2e0 AND x3 IS NOT NULL AS known, joint IN (11, 12) AND conf > 0.2e0 AND x3 IS NOT NULL AS hip FROM pj) WINDOW f AS (PARTITION BY video_id, frame_idx))""")
def pose_centred(spark, sf_dir):
    return pose.centred(Tables(spark, sf_dir).joints).select("video_id", "frame_idx", "joint", r("x3"))


def _speed(c: str) -> str:
    return f"""CASE WHEN conf >= 0.2e0 AND x3 IS NOT NULL THEN CASE WHEN i = 1 THEN (lead(coalesce({c}, -1e0)) OVER w - coalesce({c}, -1e0)) * 30 WHEN i = n THEN (coalesce({c}, -1e0) - lag(coalesce({c}, -1e0)) OVER w) * 30
      ELSE (lead(coalesce({c}, -1e0)) OVER w - lag(coalesce({c}, -1e0)) OVER w) * 30 / 2 END ELSE 0 END AS r{c}"""


SPEED_SQL = f"""SELECT video_id, frame_idx, joint, round(vx, 6) AS vx, round(vy, 6) AS vy, round(vz, 6) AS vz, round(sqrt(vx * vx + vy * vy + vz * vz), 6) AS speed FROM (SELECT video_id, frame_idx, joint, {", ".join(f"CASE WHEN n > 1 THEN sum(r{c}) OVER b / 3e0 END AS v{c[0]}" for c in ("x3", "y3", "z3"))}
  FROM (SELECT *, {", ".join(map(_speed, ("x3", "y3", "z3")))} FROM (SELECT *, row_number() OVER (PARTITION BY video_id, joint ORDER BY frame_idx) AS i, count(*) OVER (PARTITION BY video_id, joint) AS n FROM pj) WINDOW w AS (PARTITION BY video_id, joint ORDER BY frame_idx))
  WINDOW b AS (PARTITION BY video_id, joint ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query(SPEED_SQL)
def joint_velocity(spark, sf_dir):
    return pose.velocities(Tables(spark, sf_dir).joints, 30.0).select("video_id", "frame_idx", "joint", r("vx"), r("vy"), r("vz"), r("speed"))


@query(f"""SELECT p.video_id, p.frame_idx, CASE p.joint WHEN 9 THEN 'left' ELSE 'right' END AS side, round(p.x3, 6) AS x, round(p.y3, 6) AS y, round(p.z3, 6) AS z, p.conf, s.speed FROM pj p JOIN ({SPEED_SQL}) s ON s.video_id = p.video_id AND s.frame_idx = p.frame_idx AND s.joint = p.joint WHERE p.joint IN (9, 10)""")
def wrist_speeds(spark, sf_dir):
    return pose.wrist_speeds(Tables(spark, sf_dir).joints, 30.0).select("video_id", "frame_idx", "side", r("x3", "x"), r("y3", "y"), r("z3", "z"), "conf", r("speed"))


def _angles() -> str:
    parts = []
    for name, (j, a, b) in pose.ANGLES.items():
        j, a, b = pose.J[j], pose.J[a], pose.J[b]
        parts.append(f"""SELECT j.video_id, j.frame_idx, '{name}' AS name, CASE WHEN na < 1e-6 OR nb < 1e-6 THEN 0e0 ELSE degrees(acos(greatest(-1e0, least(1e0, d / (na * nb))))) END AS deg FROM k j JOIN k a ON a.video_id = j.video_id AND a.frame_idx = j.frame_idx AND a.joint = {a}
          JOIN k b ON b.video_id = j.video_id AND b.frame_idx = j.frame_idx AND b.joint = {b}, LATERAL (SELECT sqrt((a.x3 - j.x3) ** 2 + (a.y3 - j.y3) ** 2 + (a.z3 - j.z3) ** 2) AS na, sqrt((b.x3 - j.x3) ** 2 + (b.y3 - j.y3) ** 2 + (b.z3 - j.z3) ** 2) AS nb,
          (a.x3 - j.x3) * (b.x3 - j.x3) + (a.y3 - j.y3) * (b.y3 - j.y3) + (a.z3 - j.z3) * (b.z3 - j.z3) AS d) WHERE j.joint = {j}""")
    return "SELECT video_id, frame_idx, name, round(deg, 4) AS degrees FROM (WITH k AS (SELECT * FROM pj WHERE conf >= 0.2e0 AND x3 IS NOT NULL) " + " UNION ALL ".join(parts) + ")"


@query(_angles())
def joint_angles(spark, sf_dir):
    return pose.joint_angles(Tables(spark, sf_dir).joints).select("video_id", "frame_idx", "name", F.round("degrees", 4).alias("degrees"))


_PAIRS = ", ".join(f"('{a}_{b}', {pose.J[a]}, {pose.J[b]})" for a, b in pose.BONES)


@query(f"""SELECT a.video_id, a.frame_idx, name, round(sqrt((a.x3 - b.x3) ** 2 + (a.y3 - b.y3) ** 2 + (a.z3 - b.z3) ** 2), 6) AS length FROM pj a JOIN (VALUES {_PAIRS}) v(name, i, j) ON a.joint = i JOIN pj b ON b.video_id = a.video_id AND b.frame_idx = a.frame_idx AND b.joint = j
  WHERE a.conf >= 0.2e0 AND b.conf >= 0.2e0 AND a.x3 IS NOT NULL AND b.x3 IS NOT NULL""")
def bone_lengths(spark, sf_dir):
    return pose.bone_lengths(Tables(spark, sf_dir).joints).select("video_id", "frame_idx", "name", r("length"))


@query("SELECT video_id, frame_idx, round(scale, 6) AS scale, round(tx, 6) AS tx, round(ty, 6) AS ty, round(z_plane, 6) AS z_plane FROM fit")
def image_pose_fit(spark, sf_dir):
    return ego.image_fit(Tables(spark, sf_dir).joints).select("video_id", "frame_idx", r("scale"), r("tx"), r("ty"), r("z_plane"))


@query("SELECT video_id, frame_idx, " + ", ".join(f"round({v}_{c}, 6) AS {v}_{c}" for v in ("eye", "forward", "up", "right") for c in "xyz") + ", round(confidence, 6) AS confidence FROM head")
def head_pose(spark, sf_dir):
    return ego.head_pose(Tables(spark, sf_dir).joints).select("video_id", "frame_idx", *(r(f"{v}_{c}") for v in ("eye", "forward", "up", "right") for c in "xyz"), r("confidence"))


@query("SELECT video_id, frame_idx, max(conf) > 0.2e0 AS has_pose FROM pj GROUP BY video_id, frame_idx")
def ego_has_pose(spark, sf_dir):
    return ego.has_pose(Tables(spark, sf_dir).joints)


def seen_objects(t: Tables, fit: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    cx, cy = center()
    place = t.tracks.where("x1 is not null").select("video_id", "frame_idx", "object_id", cx.alias("cx"), cy.alias("cy"))
    return ego.in_head_frame(ego.placed(place, fit or ego.image_fit(t.joints), "cx", "cy"), heads or ego.head_pose(t.joints))


@query("SELECT video_id, frame_idx, object_id, round(ex, 6) AS ex, round(ey, 6) AS ey, round(ez, 6) AS ez FROM eo")
def ego_points(spark, sf_dir):
    return seen_objects(Tables(spark, sf_dir)).select("video_id", "frame_idx", "object_id", r("ex"), r("ey"), r("ez"))


@query("""SELECT video_id, frame_idx, object_id, round(u, 3) AS u, round(v, 3) AS v, coalesce(u >= 0 AND u < 960 AND v >= 0 AND v < 720, false) AS shown FROM (SELECT *, CASE WHEN ez > 0.01e0 THEN 480 + ex * 480 / (ez + 0.5e0) END AS u, CASE WHEN ez > 0.01e0 THEN 360 + ey * 360 / (ez + 0.5e0) END AS v FROM eo)""")
def ego_project(spark, sf_dir):
    return ego.projected(seen_objects(Tables(spark, sf_dir))).select("video_id", "frame_idx", "object_id", F.round("u", 3).alias("u"), F.round("v", 3).alias("v"), "shown")


def marked(t: Tables) -> DataFrame:
    return t.landmarks.withColumn("det_idx", F.lit(0)).withColumn("z", F.lit(0.0))


def anchored(t: Tables, fit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    marks = marked(t)
    fit = fit or ego.image_fit(t.joints)
    hands = ego.anchored_hands(marks.where("landmark = 0").select("video_id", "frame_idx", "det_idx", "x", "y"), t.joints, fit)
    return hands, ego.hand_landmarks(hands, marks, adapter.WIDTH)


@query("""SELECT video_id, frame_idx, side, round(d, 6) AS pinch_distance, d < 0.05e0 AS pinching FROM (SELECT a.video_id, a.frame_idx, a.side, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) AS d
  FROM mrk a JOIN mrk b ON b.video_id = a.video_id AND b.frame_idx = a.frame_idx AND b.side = a.side WHERE a.landmark = 4 AND b.landmark = 8)""")
def ego_hands(spark, sf_dir):
    return ego.pinches(anchored(Tables(spark, sf_dir))[1]).select("video_id", "frame_idx", "side", r("pinch_distance"), "pinching")


@query("""SELECT h.video_id, h.frames, h.with_head, coalesce(l, 0) AS with_left_hand, coalesce(rt, 0) AS with_right_hand, coalesce(o, 0) AS with_objects, coalesce(a, 0) AS with_arms FROM (SELECT video_id, count(*) AS frames, count(*) FILTER (confidence > 0) AS with_head FROM head GROUP BY 1) h
  LEFT JOIN (SELECT video_id, count(*) FILTER (side = 'left') AS l, count(*) FILTER (side = 'right') AS rt FROM anc WHERE r = 1 GROUP BY 1) x ON x.video_id = h.video_id LEFT JOIN (SELECT video_id, count(DISTINCT frame_idx) AS o FROM obj WHERE x1 IS NOT NULL GROUP BY 1) y ON y.video_id = h.video_id
  LEFT JOIN (SELECT video_id, count(DISTINCT frame_idx) AS a FROM arm GROUP BY 1) z ON z.video_id = h.video_id""")
def ego_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    heads = ego.head_pose(t.joints)
    return ego.summary(heads, anchored(t)[0], t.tracks.where("x1 is not null"), ego.arms(t.joints, heads))


@query("""SELECT s.video_id, s.seg_id, label, s.frame_idx, o AS object_id, round(coalesce(h.ex, 0), 6) AS hand_x, round(coalesce(h.ey, 0), 6) AS hand_y, round(coalesce(h.ez, 0), 6) AS hand_z, CASE WHEN o IS NOT NULL THEN round(coalesce(p.ex, 0), 6) END AS object_x,
  CASE WHEN o IS NOT NULL THEN round(coalesce(p.ey, 0), 6) END AS object_y, CASE WHEN o IS NOT NULL THEN round(coalesce(p.ez, 0), 6) END AS object_z FROM (SELECT c.video_id, c.seg_id, label, nullif(objects[1], 0) AS o, unnest(range(frame_start, frame_end)) AS frame_idx FROM cl c JOIN lab l ON l.video_id = c.video_id AND l.seg_id = c.seg_id) s
  LEFT JOIN em h ON h.video_id = s.video_id AND h.frame_idx = s.frame_idx AND landmark = 0 LEFT JOIN eo p ON p.video_id = s.video_id AND p.frame_idx = s.frame_idx AND p.object_id = o""")
def action_dataset(spark, sf_dir):
    t = Tables(spark, sf_dir, shared=True)
    heads, fit = large(by_recording(ego.head_pose(t.joints))), large(by_recording(ego.image_fit(t.joints)))
    hands = ego.in_head_frame(anchored(t, fit)[1].where("landmark = 0"), heads)
    return kept(files.action_dataset(t.labelled, hands, seen_objects(t, fit, heads)).select("video_id", "seg_id", "label", "frame_idx", "object_id", r("hand_x"), r("hand_y"), r("hand_z"), r("object_x"), r("object_y"), r("object_z")))


@query("SELECT label, count(*) AS rows, row_number() OVER (ORDER BY label) - 1 AS code FROM lab GROUP BY label")
def action_vocabulary(spark, sf_dir):
    """Codes of the labels, as a data set of actions has them."""
    return codes.coded(Tables(spark, sf_dir).labelled, "label")


@query("SELECT video_id, frame_idx, side, part, round(ex, 6) AS ex, round(ey, 6) AS ey, round(ez, 6) AS ez FROM ea")
def ego_arms(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ego.arms(t.joints, ego.head_pose(t.joints)).select("video_id", "frame_idx", "side", n("part"), r("ex"), r("ey"), r("ez"))


def _view() -> str:
    """The live view in SQL: arms, landmarks of hands and objects as rows."""
    x = "((p.x - cx) * rx + (p.y - cy) * ry) / wide"
    arm = f"""SELECT b.video_id, b.frame_idx, CASE WHEN p.joint % 2 = 1 THEN 'left_arm' ELSE 'right_arm' END AS kind, CAST((p.joint - 5) // 2 AS BIGINT) AS item, CASE WHEN p.joint % 2 = 1 THEN -1 ELSE 1 END * (0.6e0 + 0.3e0 * (1 - ((p.joint - 5) // 2) / 2e0)) + {x} * 0.3e0 AS x,
      0.3e0 + ((p.joint - 5) // 2) * 0.15e0 + (p.y - cy) / 480e0 * 0.5e0 AS y, 0.4e0 + ((p.joint - 5) // 2) * 0.1e0 + abs(((p.x - cx) * fx + (p.y - cy) * fy) / wide) * 0.2e0 AS z FROM bod b
      JOIN (SELECT *, count(*) OVER (PARTITION BY video_id, frame_idx, joint % 2) AS k FROM pj WHERE joint BETWEEN 5 AND 10 AND conf > 0.3e0 AND x IS NOT NULL) p ON p.video_id = b.video_id AND p.frame_idx = b.frame_idx WHERE k = 3"""
    hand = """SELECT b.video_id, b.frame_idx, CASE WHEN lft THEN 'left_hand' ELSE 'right_hand' END, l.landmark, CASE WHEN lft THEN -0.5e0 ELSE 0.5e0 END + (l.x - mx) / size * 0.4e0, 0.4e0 + (l.y - my) / size * 0.4e0, 0.5e0 FROM (
      SELECT c.*, ((wx - cx) * rx + (wy - cy) * ry) / wide < 0 AS lft, size, mx, my FROM bod c JOIN (SELECT video_id, frame_idx, max(CASE WHEN landmark = 0 THEN x END) AS wx, max(CASE WHEN landmark = 0 THEN y END) AS wy, greatest(max(x) - min(x), max(y) - min(y), 1e0) AS size, (max(x) + min(x)) / 2 AS mx, (max(y) + min(y)) / 2 AS my
      FROM lm GROUP BY video_id, frame_idx) h ON h.video_id = c.video_id AND h.frame_idx = c.frame_idx) b JOIN lm l ON l.video_id = b.video_id AND l.frame_idx = b.frame_idx"""
    pinch = hand.replace("l.landmark,", "100,").replace("(l.x - mx) / size * 0.4e0", "0").replace("CASE WHEN lft THEN -0.5e0 ELSE 0.5e0 END + 0", "sqrt((l.x - m.x) ** 2 + (l.y - m.y) ** 2) / size").replace("0.4e0 + (l.y - my) / size * 0.4e0", "CASE WHEN sqrt((l.x - m.x) ** 2 + (l.y - m.y) ** 2) / size < 0.3e0 THEN 1e0 ELSE 0e0 END")
    pinch += " JOIN lm m ON m.video_id = b.video_id AND m.frame_idx = b.frame_idx WHERE l.landmark = 4 AND m.landmark = 8"
    thing = f"""SELECT b.video_id, b.frame_idx, 'object', o.object_id, {x} * 0.8e0, (p.y - cy) / 480e0, greatest(0.4e0, 1.2e0 - greatest(x2 - x1, y2 - y1) / 640e0 * 1.5e0) FROM bod b JOIN obj o ON o.video_id = b.video_id AND o.frame_idx = b.frame_idx, LATERAL (SELECT (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y) p WHERE x1 IS NOT NULL"""
    return f"SELECT video_id, frame_idx, kind, item, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ({arm} UNION ALL {hand} UNION ALL {pinch} UNION ALL {thing})"


@query(_view())
def body_view(spark, sf_dir):
    """The live view of every frame; item 100 of a hand has its pinch distance and whether it pinches."""
    t = Tables(spark, sf_dir)
    found = kept(body_view_.seen(body_view_.nested(t.frames, t.joints, t.landmarks, t.tracks), adapter.WIDTH, adapter.HEIGHT))
    key, parts = ["video_id", "frame_idx"], []
    for side in ("left", "right"):
        for kind, points in ((f"{side}_arm", F.col(f"{side}_arm")), (f"{side}_hand", F.col(f"{side}_hand.points"))):
            parts.append(found.select(*key, F.lit(kind).alias("kind"), F.posexplode(points).alias("item", "p")).select(*key, "kind", n("item"), r("p.x", "x"), r("p.y", "y"), r("p.z", "z")))
        held = found.where(f"{side}_hand is not null").select(*key, F.lit(f"{side}_hand").alias("kind"), F.lit(100).cast("long").alias("item"), r(f"{side}_hand.pinch_distance", "x"), F.col(f"{side}_hand.pinching").cast("double").alias("y"), F.lit(0.5).alias("z"))
        parts.append(held)
    parts.append(found.select(*key, F.lit("object").alias("kind"), F.explode("objects").alias("p")).select(*key, "kind", F.col("p.object_id").alias("item"), r("p.x", "x"), r("p.y", "y"), r("p.z", "z")))
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT video_id, frame_idx, round(sum(CASE WHEN d IS NULL THEN 0 ELSE 0.1e0 / greatest(d, 0.001e0) * w END), 6) AS rate FROM (SELECT a.video_id, a.frame_idx, b.d, 0.9e0 ** (a.frame_idx - b.frame_idx) AS w FROM ev a
  JOIN (SELECT video_id, frame_idx, t - lag(t) OVER (PARTITION BY video_id ORDER BY frame_idx) AS d FROM ev) b ON b.video_id = a.video_id AND b.frame_idx <= a.frame_idx) GROUP BY video_id, frame_idx""")
def frame_rates(spark, sf_dir):
    """The live meter's rate after each frame."""
    return recording.metred(Tables(spark, sf_dir).frames).select("video_id", "frame_idx", r("rate"))


@query()
def export_ego(spark, sf_dir):
    t = Tables(spark, sf_dir, shared=True)
    heads, fit = large(by_recording(ego.head_pose(t.joints))), large(by_recording(ego.image_fit(t.joints)))
    marks = large(by_recording(anchored(t, fit)[1]))
    labels = t.labelled.select("video_id", "seg_id", "frame_start", "frame_end", "label", "confidence")
    # written where the frames lie: nothing that is made of them is shuffled
    return kept(files.ego_json(t.frames, heads, ego.in_head_frame(marks, heads), ego.pinches(marks), ego.arms(t.joints, heads), seen_objects(t, fit, heads), labels))


@query("""SELECT c.video_id, c.seg_id, a.l AS predecessors, b.l AS successors FROM cl c LEFT JOIN (SELECT video_id, target, string_agg(source, ',' ORDER BY source) AS l FROM edg GROUP BY ALL) a ON a.video_id = c.video_id AND a.target = c.seg_id
  LEFT JOIN (SELECT video_id, source, string_agg(target, ',' ORDER BY target) AS l FROM edg GROUP BY ALL) b ON b.video_id = c.video_id AND b.source = c.seg_id""")
def graph_neighbours(spark, sf_dir):
    t = Tables(spark, sf_dir)
    key = ["video_id", "seg_id"]
    rows = t.segments.select(*key).join(graph.predecessors(t.edges), key, "left").join(graph.successors(t.edges), key, "left")
    return rows.select(*key, *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("predecessors", "successors")))


@query("""SELECT s.video_id, part, object_id, found, num_frames FROM (SELECT video_id, 'pose' AS part, CAST(NULL AS BIGINT) AS object_id, count(DISTINCT frame_idx) AS found FROM pj WHERE event_id % 40 > 0 GROUP BY video_id
  UNION ALL SELECT video_id, 'object', object_id, count(*) FROM obj WHERE x1 IS NOT NULL GROUP BY video_id, object_id) s JOIN tot ON tot.video_id = s.video_id WHERE found <> num_frames""")
def series_aligned(spark, sf_dir):
    """Poses without those of some frames, and objects where they are seen, against the recordings' lengths."""
    t = Tables(spark, sf_dir)
    some = t.joints.join(t.frames.where("event_id % 40 > 0").select("video_id", "frame_idx"), ["video_id", "frame_idx"])
    return timeline.misaligned(t.totals, some, t.tracks.where("x1 is not null"))


@query()
def engine_tables(spark, sf_dir):
    """Rows of every table that a run over detections and joints gives, by recording."""
    t = Tables(spark, sf_dir, shared=True)
    some = Settings(segments=Segments(min_duration=2))  # segments are short here
    tables = engine.Engine(some).run(t.frames, t.joints, detections=detections(t), landmarks=marked(t))
    # counted one after the other: the driver plans one table at a time and not all in one query
    parts = [kept(df.groupBy("video_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "video_id", "rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


@query()
def export_graph(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nodes, edges = t.labelled.select("video_id", "seg_id", "frame_start", "frame_end", "label"), t.edges
    return files.graph_json(graph.metadata(t.segments, edges), nodes, edges)


@query()
def export_contacts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return files.contacts_json(t.totals, t.events)


#: Frames of a recording lie days apart here, so live queries keep their state for ten years.
STRETCHED = 3650 * 86_400_000


def stream(spark: SparkSession, rows: DataFrame, order: str) -> DataFrame:
    """The rows as a stream over files in the session's shared folder: a batch for each quarter of the times, each written by all tasks, and a closing row of nulls four days
    after the last, which moves the watermark past all others.  Rows without a time come first."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows, parts = kept(rows), spark.sparkContext.defaultParallelism
    at, kind = F.col(order).cast("double"), rows.schema[order].dataType
    cuts = rows.select(at.alias("at")).agg(F.percentile_approx("at", [0.25, 0.5, 0.75])).first()[0] or []
    quarter = F.lit(0)
    for cut in sorted(set(cuts)):
        quarter = quarter + F.coalesce((at >= cut).cast("int"), F.lit(0))
    for i in range(len(set(cuts)) + 1):
        rows.where(quarter == i).repartition(parts).write.mode("append").parquet(path)
    last = rows.agg(F.coalesce(F.max(order), F.lit(0).cast(kind)).alias(order))
    later = (F.col(order).cast("double") + 4 * 86_400).cast(kind)
    last.select(*(later.alias(f.name) if f.name == order else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(path)


@query("SELECT video_id, hand, object_id, frame_idx, is_contact FROM con")
def stream_contacts(spark, sf_dir):
    from taskloom.streaming import live

    t = Tables(spark, sf_dir)
    near = t.contact.select("video_id", "hand", "object_id", "frame_idx", "distance").join(t.frames.select("video_id", "frame_idx", "t"), ["video_id", "frame_idx"])
    found = live.live_contacts(live.stamped(stream(spark, near, "t")), keep=STRETCHED)
    return live.run_to_end(found)


@query()
def stream_track(spark, sf_dir):
    from taskloom.streaming import live

    t = Tables(spark, sf_dir)
    rows = t.frames.select("video_id", "frame_idx", "t").join(detections(t).drop("object_id"), ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", "t", "det_idx", "class_name", "conf", *objects.BOX)
    return live.run_to_end(live.live_tracks(live.stamped(stream(spark, rows, "t")), keep=STRETCHED))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    from taskloom.streaming import live

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    found = live.windowed_counts(stream(spark, events, "ts").withWatermark("ts", "1 hour"), "1 day")
    return live.run_to_end(found).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT video_id, joint, frame_idx, count(*) OVER b AS num_held, min(frame_idx) OVER b AS oldest, round(sum(conf) OVER b, 4) AS conf FROM pj
  WINDOW b AS (PARTITION BY video_id, joint ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def stream_pose_history(spark, sf_dir):
    from taskloom.streaming import live

    rows = adapter.pose_joints(Tables(spark, sf_dir).frames, "t").select("video_id", "joint", "frame_idx", "x", "y", "conf", "t")
    found = live.run_to_end(live.live_poses(live.stamped(stream(spark, rows, "t")), keep=STRETCHED, numbers=True))
    return found.select("video_id", n("joint"), "frame_idx", "num_held", "oldest", F.round("conf", 4).alias("conf"))


@query("SELECT video_id, frame_idx, side, object_id, contact, grabs, round(grab_confidence, 6) AS grab_confidence FROM smo")
def stream_fingertips(spark, sf_dir):
    from taskloom.streaming import live

    t = Tables(spark, sf_dir)
    found = t.landmarks.select("video_id", "frame_idx", "side").distinct().join(contacts.fingertip_contacts(t.landmarks, t.tracks).drop("cx", "cy", "touch_x", "touch_y"), ["video_id", "frame_idx", "side"], "left")
    rows = found.join(t.frames.select("video_id", "frame_idx", "t"), ["video_id", "frame_idx"])
    return live.run_to_end(live.live_fingertips(live.stamped(stream(spark, rows, "t")), keep=STRETCHED)).withColumn("grab_confidence", F.round("grab_confidence", 6))
