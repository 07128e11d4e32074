"""The whole analysis of recordings, as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions.lineage import kept, large
from taskloom.operators import actions, contacts, ego, graph, objects, pose, states, timeline
from taskloom.sources import files
from taskloom.sources.config import Settings


def by_recording(rows: DataFrame) -> DataFrame:
    return large(kept(rows, by="video_id"))


@dataclass
class Engine:
    """``run`` takes ``frames`` (video_id, frame_idx, t), ``detections`` (video_id, frame_idx, det_idx, class_name, conf, box) or
    finished ``tracks``, ``joints`` (see ``pose``) and, if hands were detected, their ``landmarks`` (video_id, frame_idx, det_idx, landmark, x, y, z), and gives one DataFrame for each table.  Tables that others
    are built on are written once to the shared folder, in buckets by recording, and read where they lie; the others are computed when they are used.  All are keyed by video_id, so
    any number of recordings run together.  Frames and joints that lie by recording too (``kept(.., by="video_id")``, or made of such) are not shuffled."""

    settings: Settings = field(default_factory=Settings)

    def run(self, frames: DataFrame, joints: DataFrame, detections: DataFrame | None = None, tracks: DataFrame | None = None, landmarks: DataFrame | None = None) -> dict[str, DataFrame]:
        frames, joints = large(frames), large(joints)  # rows of frames look small by their files
        s, out = self.settings, {"frames": frames}
        out["timelines"] = timeline.summary(frames)
        totals = out["timelines"].select("video_id", "num_frames")
        if tracks is None:
            tracks = objects.interpolated(self.tracks(frames, detections), s.tracking.max_gap)
        tracks = by_recording(states.motion(tracks, s.states.window, s.states.threshold))
        out["joints"] = smooth = by_recording(self.smoothed(joints))
        near = contacts.distances(contacts.hand_positions(smooth, s.contacts.use_hand_center, s.pose.min_confidence), tracks)
        contact = by_recording(contacts.contacts(near, s.contacts.distance, s.contacts.on, s.contacts.off))
        out["contact_frames"] = contact
        # as in the order of stages that is analysed, interactions see support and containment as unknown
        feature = contacts.features(contact).withColumns({c: F.lit("unknown") for c in contacts.ENDS})
        found = by_recording(contacts.interactions(feature, None, s.contacts.motion, s.contacts.correlation, s.contacts.min_grasp, s.contacts.min_push))
        out["interactions"] = found
        event = by_recording(contacts.events(found, s.contacts.min_confidence, s.contacts.min_duration, s.contacts.merge_gap))
        out["contact_events"] = event
        state = by_recording(states.refined(tracks, contacts.contact_frames(contact), contacts.grasp_frames(event), s.states.fixture_classes, s.states.container_classes))
        out["object_frames"] = state
        g = s.segments
        watched = tuple(d for d, on in (("motion_state", g.detect_motion), ("support_relation", g.detect_support), ("containment", g.detect_containment)) if on)
        found_at = actions.contact_boundaries(event).where(F.lit(g.detect_contact))
        if watched:
            found_at = found_at.unionByName(actions.state_boundaries(state, watched))
        out["boundaries"] = by_recording(actions.merged_boundaries(found_at))
        segment = actions.timed(actions.segments(out["boundaries"], totals, s.segments.min_duration), frames)
        segment = actions.long_enough(segment, s.segments.min_duration)
        if s.segments.merge > s.segments.min_duration:
            segment = actions.timed(actions.merged_short(segment, s.segments.merge), frames)
        if s.segments.max_segments:
            segment = actions.timed(actions.limited(segment, s.segments.max_segments), frames)
        segment = by_recording(actions.labelled(actions.closed(segment), event, state))
        out["action_segments"] = segment
        out["preconditions"] = pre = by_recording(graph.preconditions(segment, state, s.graph.lookback))
        out["postconditions"] = post = by_recording(graph.postconditions(segment, state, totals, s.graph.lookahead))
        causal = by_recording(graph.causal_edges(segment, pre, post, s.graph.min_confidence))
        between = graph.temporal_edges(segment, causal)
        out["graph_edges"] = graph.edges(causal, between if s.graph.add_temporal_fallback else between.limit(0))
        out["graph_metadata"] = graph.metadata(segment, out["graph_edges"])
        if s.ego.enabled:
            fit, heads = ego.image_fit(smooth), ego.head_pose(smooth, s.ego.gaze_down, s.ego.offset)
            out["ego_frames"] = heads
            place = objects.centers(tracks).where("cx is not null")
            out["ego_objects"] = ego.in_head_frame(ego.placed(place, fit, "cx", "cy"), heads)
            out["ego_arms"] = ego.arms(smooth, heads)
            if landmarks is not None:
                base = landmarks.where("landmark = 0").select("video_id", "frame_idx", "det_idx", "x", "y", *(c for c in ("conf",) if c in landmarks.columns))
                out["ego_hands"] = marks = by_recording(ego.hand_landmarks(ego.anchored_hands(base, smooth, fit), landmarks, s.width))
                out["ego_landmarks"] = ego.in_head_frame(marks, heads)
                out["ego_pinches"] = ego.pinches(marks, s.ego.pinch)
        return out

    def files(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Every file of a run, as ``video_id, json`` for each recording."""
        totals, frames = tables["timelines"], tables["frames"]
        nodes, edges = tables["action_segments"], tables["graph_edges"]
        out = {
            "timeline": files.timeline_json(totals, frames), "pose": files.pose_json(totals, tables["joints"]), "objects": files.objects_json(totals, tables["object_frames"]),
            "contacts": files.contacts_json(totals, contacts.timed(tables["contact_events"], frames)), "actions": files.actions_json(totals, nodes),
            "task_graph": files.graph_json(tables["graph_metadata"], nodes.select("video_id", "seg_id", "frame_start", "frame_end", "label"), edges), "bare_graph": files.bare_graph_json(totals, nodes.select("video_id", "seg_id", "label"), edges.select("video_id", "source", "target", "edge_type")),
        }
        if "ego_frames" in tables:
            none = lambda kind: frames.sparkSession.createDataFrame([], kind)
            hands = tables.get("ego_landmarks", none("video_id long, frame_idx long, side string, landmark long, ex double, ey double, ez double"))
            pinches = tables.get("ego_pinches", none("video_id long, frame_idx long, side string, pinch_distance double, pinching boolean"))
            labels = nodes.select("video_id", "seg_id", "frame_start", "frame_end", "label", "confidence")
            out["egocentric"] = files.ego_json(frames, tables["ego_frames"], hands, pinches, tables["ego_arms"], tables["ego_objects"], labels)
        return out

    def tracks(self, frames: DataFrame, detections: DataFrame) -> DataFrame:
        t = self.settings.tracking
        sure = objects.confident(detections, t.confidence)
        found = by_recording(objects.tracked(sure, frames, t.iou, t.max_age, t.min_hits))
        own = sure.select("video_id", "frame_idx", "det_idx", "class_name", "conf", *objects.BOX)
        emitted = found.join(own, ["video_id", "frame_idx", "det_idx"]).withColumnRenamed("track_id", "object_id")
        return objects.trajectories(emitted, frames)

    def smoothed(self, joints: DataFrame) -> DataFrame:
        p, out = self.settings.pose, joints
        flat, deep = ["x", "y"], ["x3", "y3", "z3"]
        if p.smoothing == "none":
            return out
        if p.smoothing == "moving_average":
            for columns in (flat, deep):
                out = pose.moving_average(out, columns, p.window, p.max_gap).drop("filled")
        elif p.smoothing == "exponential":
            out = pose.exponential(out, [flat, deep], p.alpha, p.max_gap)
        elif p.smoothing == "one_euro":
            out = pose.one_euro(out, [flat, deep], self.settings.fps, p.min_cutoff, p.beta, p.d_cutoff, p.max_gap)
        else:
            raise ValueError(f"no such smoothing: {p.smoothing}")
        return out.select("video_id", "frame_idx", "joint", "conf", *flat, *deep)
