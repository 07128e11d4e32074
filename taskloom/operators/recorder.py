"""Recording by command: which frames are taken, and the actions that are annotated meanwhile; cached detections and held poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.temporal import over


def followed(frames: DataFrame, commands: DataFrame, on: bool = True) -> DataFrame:
    """Frames (video_id, frame_idx, t) and commands (video_id, t, seq, command, action, object_id) of each recording in order of time; a command
    comes behind the frames of its own time.  ``take`` counts the ``clear`` commands so far, ``taken`` tells frames between ``record`` and ``stop``
    (``on``: also those before the first), and ``n`` is the number of frames in the take so far."""
    a = frames.select("video_id", "t", F.lit(0).alias("kind"), F.col("frame_idx").alias("seq"), *(F.lit(None).cast(k).alias(c) for c, k in (("command", "string"), ("action", "string"), ("object_id", "long"))))
    both = a.unionByName(commands.select("video_id", "t", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), "command", "action", F.col("object_id").cast("long").alias("object_id")))
    order = ["t", "kind", "seq"]
    so_far = Window.partitionBy("video_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    switch = F.last(F.when(F.col("command").isin("record", "stop"), F.col("command") == "record"), True).over(so_far)
    both = both.withColumn("take", F.count(F.when(F.col("command") == "clear", 1)).over(so_far)).withColumn("taken", (F.col("kind") == 0) & F.coalesce(switch, F.lit(on)))
    in_take = Window.partitionBy("video_id", "take").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("n", F.count(F.when(F.col("taken"), 1)).over(in_take))


def recorded(frames: DataFrame, commands: DataFrame, on: bool = True) -> DataFrame:
    """``video_id, take, position, frame_idx`` of the frames that are recorded; a ``clear`` begins a new take, the last take is what a save holds."""
    return followed(frames, commands, on).where("taken").select("video_id", "take", (F.col("n") - 1).alias("position"), F.col("seq").alias("frame_idx"))


def annotated(frames: DataFrame, commands: DataFrame, on: bool = True) -> DataFrame:
    """``video_id, take, action, object_id, frame_start, frame_end``, as numbers of recorded frames.  A ``start`` ends the action before it, as do
    ``end``, ``save`` and the end of the take; an ``end`` without an action does nothing."""
    rows = followed(frames, commands, on)
    rows = rows.withColumn("total", F.max("n").over(Window.partitionBy("video_id", "take"))).where(F.col("command").isin("start", "end", "save"))
    after = F.lead("n").over(Window.partitionBy("video_id", "take").orderBy("t", "kind", "seq"))
    rows = rows.withColumn("frame_end", F.coalesce(after, "total")).where("command = 'start'")
    return rows.select("video_id", "take", "action", "object_id", F.col("n").alias("frame_start"), "frame_end")


def cached(frames: DataFrame, detections: DataFrame, skip: int) -> DataFrame:
    """What is detected in every ``skip`` + 1-th frame, shown again in the frames up to the next: ``detections`` with ``frame_idx``, and in
    ``source_frame`` the frame that they were detected in."""
    run = F.when(F.col("frame_idx") % (skip + 1) == 0, F.col("frame_idx"))
    source = F.max(run).over(over(["video_id"]).rowsBetween(Window.unboundedPreceding, 0))
    shown = frames.select("video_id", "frame_idx", source.alias("source_frame"))
    return shown.join(detections.withColumnRenamed("frame_idx", "source_frame"), ["video_id", "source_frame"])


def held_poses(joints: DataFrame, values: list[str], last: int = 30) -> DataFrame:
    """Adds ``held``, the last ``last`` frames of each joint up to the row's own, oldest first, as structs of frame_idx and ``values``."""
    back = over(["video_id", "joint"]).rowsBetween(1 - last, 0)
    return joints.withColumn("held", F.collect_list(F.struct("frame_idx", *values)).over(back))
