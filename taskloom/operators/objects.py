"""Objects: detections, tracks and dense trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions.geometry import center, distance, iou
from taskloom.functions.temporal import batched, by_frame, folded, gap_filled, over
from taskloom.operators.pose import overlap

KEY = ["video_id", "object_id"]
BOX = ["x1", "y1", "x2", "y2"]


def confident(detections: DataFrame, least: float = 0.5) -> DataFrame:
    return detections.where(F.col("conf") >= least)


def iou_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap of boxes of one class in the same frame of two sets; 0 if they don't meet."""
    left = a.select("video_id", "frame_idx", "class_name", F.col("object_id").alias("a_id"), *(F.col(c).alias(f"a_{c}") for c in BOX))
    right = b.select("video_id", "frame_idx", "class_name", F.col("object_id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in BOX))
    return left.join(right, ["video_id", "frame_idx", "class_name"]).select("video_id", "frame_idx", "class_name", "a_id", "b_id", iou().alias("iou"))


class Tracker:
    """Greedy overlap tracking of one recording, frame by frame; also the state of the live query."""

    def __init__(self, least: float = 0.3, max_age: int = 30, min_hits: int = 3):
        self.least, self.max_age, self.min_hits, self.next = least, max_age, min_hits, 0
        self.tracks: dict[int, list] = {}  # id: class, box, frame last seen, age

    def update(self, frame: int, found: list[tuple[str, float, tuple]]) -> list[tuple[int, int]]:
        """(track, detection) pairs that the frame emits."""
        if not found:
            for track in self.tracks.values():
                track[3] += 1
            return []
        ids = list(self.tracks)
        pairs = [(overlap(self.tracks[i][1], box), -a, -d) for a, i in enumerate(ids) for d, (name, _, box) in enumerate(found) if self.tracks[i][0] == name]
        out, used, taken = [], set(), set()
        for score, a, d in sorted(pairs, reverse=True):
            if score < self.least:
                break
            if a in used or d in taken:
                continue
            used.add(a)
            taken.add(d)
            track = self.tracks[ids[-a]]
            track[1], track[2], track[3] = found[-d][2], frame, 0
            out.append((ids[-a], -d))
        for d, (name, _, box) in enumerate(found):
            if -d not in taken:
                self.tracks[self.next] = [name, box, frame, 0]
                if self.min_hits <= 1:
                    out.append((self.next, d))
                self.next += 1
        self.tracks = {i: t for i, t in self.tracks.items() if frame - t[2] <= self.max_age}
        return out


def tracked(detections: DataFrame, frames: DataFrame, least: float = 0.3, max_age: int = 30, min_hits: int = 3) -> DataFrame:
    """``video_id, track_id, frame_idx, det_idx``: tracks of each recording, folded over its frames in order.  ``detections`` has
    video_id, frame_idx, det_idx, class_name, conf and box."""
    rows = frames.select("video_id", "frame_idx").join(detections, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", "det_idx", "class_name", "conf", *BOX)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emitted() -> Iterator[tuple]:
            tracker = Tracker(least, max_age, min_hits)
            for frame, group in by_frame(parts):
                held = [r for r in group if not pd.isna(r.det_idx)]
                for track, d in tracker.update(frame, [(r.class_name, r.conf, (r.x1, r.y1, r.x2, r.y2)) for r in held]):
                    yield held[d].video_id, track, frame, int(held[d].det_idx)

        yield from batched(emitted(), ["video_id", "track_id", "frame_idx", "det_idx"])

    return folded(rows, ["video_id"], ["frame_idx", "det_idx"], fold, "video_id long, track_id long, frame_idx long, det_idx long")


def trajectories(emitted: DataFrame, frames: DataFrame) -> DataFrame:
    """A row for every object and frame: its class at first sight, and box and confidence where it was emitted."""
    objects = emitted.groupBy(*KEY).agg(F.min_by("class_name", "frame_idx").alias("class_name"))
    spine = frames.select("video_id", "frame_idx").join(objects, "video_id")
    rows = emitted.select(*KEY, "frame_idx", "conf", *BOX)
    return spine.join(rows, [*KEY, "frame_idx"], "left").withColumn("conf", F.coalesce("conf", F.lit(0.0)))


def interpolated(tracks: DataFrame, max_gap: int = 10) -> DataFrame:
    """Gaps of at most ``max_gap`` frames filled on a line; the confidence of filled frames is halved."""
    rows = tracks.withColumn("conf", F.when(F.col("x1").isNotNull(), F.col("conf")))
    out = gap_filled(rows, KEY, [*BOX, "conf"], max_gap)
    return out.withColumn("conf", F.when(F.col("filled"), F.col("conf") * 0.5).otherwise(F.coalesce("conf", F.lit(0.0))))


def centers(tracks: DataFrame) -> DataFrame:
    cx, cy = center()
    return tracks.select(*KEY, "frame_idx", "conf", cx.alias("cx"), cy.alias("cy"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))


def speeds(tracks: DataFrame, fps: float) -> DataFrame:
    """Pixels a second since the frame before; 0 at first and next to missing frames."""
    w = over(KEY)
    rows = centers(tracks)
    d = distance(F.col("cx"), F.col("cy"), F.lag("cx").over(w), F.lag("cy").over(w)) * fps
    known = (F.col("conf") > 0) & (F.lag("conf").over(w) > 0)
    return rows.select(*KEY, "frame_idx", F.when(known, d).otherwise(0.0).alias("speed"))
