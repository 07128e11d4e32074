"""Timelines: sampling, checks, alignment and resampling of frames.  Frames have video_id, frame_idx and t."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.temporal import folded, neighbours, over


def sampled(frames: DataFrame, fps: float, target: float | None, max_frames: int | None = None) -> DataFrame:
    """Every n-th frame, n the rounded ratio of the rates (half to even), numbered anew; at most ``max_frames``."""
    step = F.bround(F.lit(float(fps)) / F.lit(float(target))).cast("long") if target and target < fps else F.lit(1)
    kept = frames.where(F.col("frame_idx") % step == 0)
    new = (F.row_number().over(over(["video_id"])) - 1).cast("long")
    kept = kept.withColumn("source_idx", F.col("frame_idx")).withColumn("frame_idx", new)
    return kept.where(F.col("frame_idx") < max_frames) if max_frames else kept


def synthetic(videos: DataFrame) -> DataFrame:
    """Frames ``t0 + i / fps`` for videos with num_frames, fps and t0."""
    some = videos.where("num_frames > 0")
    return some.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_frames") - 1))).withColumn("t", F.col("t0") + F.col("frame_idx") / F.col("fps"))


def summary(frames: DataFrame) -> DataFrame:
    """Number of frames, first time and duration of each video."""
    return frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_frames"), F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("duration"))


def fixed(frames: DataFrame) -> DataFrame:
    """Frames with repaired times: one that isn't above the one before, as repaired, follows it by the step before; the first step is 1/30."""

    def repair(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = last = None
        for part in parts:
            out = []
            for t in part.t:
                if last is not None and t <= last:
                    t = last + (1.0 / 30.0 if before is None else last - before)
                before, last = last, t
                out.append(t)
            yield part.assign(t=out)

    rows = folded(frames.select("video_id", "frame_idx", "t"), ["video_id"], ["frame_idx"], repair, "video_id long, frame_idx long, t double")
    return rows.withColumn("t", F.when(~F.isnan("t"), F.col("t")))


def validated(frames: DataFrame, fps: float) -> DataFrame:
    """Per video: whether indices run from 0 without holes, times never fall, times always rise, and the rate is within 1 of ``fps``."""
    d = F.col("t") - F.lag("t").over(over(["video_id"]))
    per = frames.withColumn("d", d).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"), F.min("d").alias("least"), F.min("t").alias("a"), F.max("t").alias("b")
    )
    rate = F.try_divide(F.col("n") - 1, F.col("b") - F.col("a"))
    return per.select(
        "video_id",
        ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("contiguous"),
        F.coalesce(F.col("least") > -1e-6, F.lit(True)).alias("monotonic"),
        F.coalesce(F.col("least") > 0, F.lit(True)).alias("increasing"),
        F.coalesce(F.abs(rate - fps) <= 1, F.lit(True)).alias("rate_fits"),
    )


def resampled(frames: DataFrame, fps: float) -> DataFrame:
    """Frames at a new rate over each video's duration."""
    per = summary(frames).withColumn("n", F.floor(F.col("duration") * fps).cast("long") + 1)
    return per.select("video_id", "t0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame_idx")).select("video_id", "frame_idx", (F.col("t0") + F.col("frame_idx") / fps).alias("t"))


def times_of(rows: DataFrame, frames: DataFrame, fps: float) -> DataFrame:
    """Adds ``t`` of each row's frame_idx; beyond the video ``t0 + i / fps``."""
    first = summary(frames).select("video_id", "t0")
    joined = rows.join(frames.select("video_id", "frame_idx", "t"), ["video_id", "frame_idx"], "left").join(first, "video_id")
    return joined.withColumn("t", F.coalesce("t", F.col("t0") + F.col("frame_idx") / fps)).drop("t0")


def nearest_frames(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``frame_idx``, the frame nearest to each row's ``t``; the earlier of two equally near ones."""
    near = neighbours(rows, frames, ["video_id"], "t", "frame_idx")
    first = (F.col("n_.t") - F.col("t")) < (F.col("t") - F.col("p_.t"))
    return near.withColumn("frame_idx", F.when(F.col("p_").isNull() | first, F.col("n_.v")).otherwise(F.col("p_.v"))).drop("p_", "n_")


def frames_at(rows: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Adds ``frame_idx`` of each row's ``t``: the nearest frame, or for a video without frames the whole part of ``(t - t0) * fps``, both as in ``videos`` (video_id, t0, fps)."""
    found = nearest_frames(rows, frames)
    plain = ((F.col("t") - F.col("t0_")) * F.col("fps_")).cast("long")  # a cast cuts towards 0
    head = videos.select("video_id", F.col("t0").alias("t0_"), F.col("fps").alias("fps_"))
    return found.join(head, "video_id", "left").withColumn("frame_idx", F.coalesce("frame_idx", plain)).drop("t0_", "fps_")


def interpolated(rows: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """Adds ``value`` of a series at each row's ``t``, linear between neighbours and constant beyond the ends."""
    near = neighbours(rows, series, ["video_id"], "t", value)
    share = F.try_divide(F.col("t") - F.col("p_.t"), F.col("n_.t") - F.col("p_.t"))
    between = F.col("p_.v") + (F.col("n_.v") - F.col("p_.v")) * F.coalesce(share, F.lit(0.0))
    return near.withColumn(value, F.coalesce(between, F.col("p_.v"), F.col("n_.v"))).drop("p_", "n_")


def from_times(videos: DataFrame, times: DataFrame) -> DataFrame:
    """``video_id, frame_idx, t, timestamp_source`` of videos with num_frames, fps and t0: the ``times`` given for a video, repaired if they
    fall somewhere, else synthetic ones.  Another number of times than frames is an error."""
    counted = videos.join(times.groupBy("video_id").agg(F.count(F.lit(1)).alias("given")), "video_id", "left")
    wrong = F.raise_error(F.concat(F.lit("times of another length than the frames of video "), F.col("video_id").cast("string")))
    timed = counted.where("given is not null").select("video_id", F.when(F.col("given") == F.col("num_frames"), True).otherwise(wrong.cast("boolean")).alias("fits"))
    rows = times.select("video_id", "frame_idx", "t").join(timed, "video_id").where("fits").drop("fits")
    falls = validated(rows, 1.0).where("not monotonic").select("video_id")
    own = rows.join(falls, "video_id", "left_anti").unionByName(fixed(rows.join(falls, "video_id", "left_semi"))).withColumn("timestamp_source", F.lit("video"))
    rest = synthetic(counted.where("given is null")).select("video_id", "frame_idx", "t").withColumn("timestamp_source", F.lit("synthetic"))
    return own.unionByName(rest)


def misaligned(totals: DataFrame, joints: DataFrame, tracks: DataFrame) -> DataFrame:
    """``video_id, part, object_id, found, num_frames``: poses and objects with another number of frames than their video."""
    none = F.lit(None).cast("long").alias("object_id")
    pose = joints.groupBy("video_id").agg(F.countDistinct("frame_idx").alias("found")).select("video_id", F.lit("pose").alias("part"), none, "found")
    each = tracks.groupBy("video_id", "object_id").agg(F.countDistinct("frame_idx").alias("found")).select("video_id", F.lit("object").alias("part"), "object_id", "found")
    return pose.unionByName(each).join(totals.select("video_id", "num_frames"), "video_id").where("found != num_frames")
