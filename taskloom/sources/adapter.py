"""Recordings derived from the ``events`` table: a deterministic carrier for detections, tracks, poses and hands.

One user is one recording and one event one frame.  Integer waves give positions, so every engine computes
the same numbers; events of type ``error`` lose detections, which makes gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS, WIDTH, HEIGHT = 30.0, 640, 480
#: Class, half width and half height of each object of a recording.
OBJECTS = ((0, "fixture", 60, 20), (1, "bin", 45, 35), (2, "part", 8, 8))
JOINTS = 17


def wave(steps: Column, period: int) -> Column:
    """A triangle between 0 and half the period."""
    return F.abs(steps % period - period // 2).cast("double")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_id, frame_idx, t, event_id, event_type, value``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    mine = Window.partitionBy("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(mine.orderBy("ts", "event_id")) - 1).cast("long").alias("frame_idx"),
        ((micros - F.min(micros).over(mine)) / F.lit(1e6)).alias("t"),
        "event_id", "event_type", "value",
    )


def object_frames(frame: DataFrame) -> DataFrame:
    """``video_id, object_id, frame_idx, class_name, conf, x1, y1, x2, y2``; a missing detection has null box and conf 0."""
    kinds = F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("o"), F.lit(n).alias("class_name"), F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")) for o, n, w, h in OBJECTS)))
    rows = frame.withColumn("k", kinds).select("video_id", "frame_idx", "event_id", "event_type", F.col("k.o").alias("object_id"), "k.class_name", "k.w", "k.h")
    there = ~((F.col("event_type") == "error") & ((F.col("event_id") + F.col("object_id")) % 2 == 0))
    # twelve frames of motion, then twelve of rest
    at = F.col("frame_idx") + F.col("object_id") * 8
    at = F.floor(at / 24) * 12 + F.least(at % 24, F.lit(12))
    cx = 200 + wave(at * 7 + F.col("object_id") * 40, 200)
    cy = 150 + wave(at * 5 + F.col("object_id") * 30, 160)
    sides = {"x1": cx - F.col("w"), "y1": cy - F.col("h"), "x2": cx + F.col("w"), "y2": cy + F.col("h")}
    return rows.select(
        "video_id", "object_id", "frame_idx", "class_name",
        F.when(there, 0.5 + (F.col("event_id") % 5) * 0.1).otherwise(0.0).alias("conf"),
        *(F.when(there, e).alias(c) for c, e in sides.items()),
    )


def pose_joints(frame: DataFrame, *more: str) -> DataFrame:
    """``video_id, frame_idx, joint, x, y, conf, x3, y3, z3``; coordinates are null where conf is 0.  ``more`` columns of the frame go with them."""
    rows = frame.withColumn("joint", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(JOINTS - 1).cast("long"))))
    conf = ((F.col("event_id") + F.col("joint")) % 10) / 10.0
    x = 180 + 6 * F.col("joint") + wave(F.col("frame_idx") * 9 + F.col("joint") * 13, 120)
    y = 100 + 14 * F.col("joint") + wave(F.col("frame_idx") * 4 + F.col("joint") * 7, 60)
    z = ((F.col("joint") * 37) % 11 - 5) * 0.02 + (F.col("frame_idx") % 7) * 0.01
    rows = rows.withColumn("conf", conf).withColumn("x", F.when(conf > 0, x)).withColumn("y", F.when(conf > 0, y))
    return rows.select("video_id", "frame_idx", "joint", "x", "y", "conf", ((F.col("x") - 300) * 0.004).alias("x3"), ((F.col("y") - 250) * 0.004).alias("y3"), F.when(conf > 0, z).alias("z3"), *more)


def landmarks(frame: DataFrame) -> DataFrame:
    """``video_id, frame_idx, side, landmark, x, y, conf`` of the 21 points of one hand; hands are away in ``signup`` frames."""
    rows = frame.where("event_type <> 'signup'").withColumn("landmark", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))))
    x = 190 + wave(F.col("frame_idx") * 8, 200) + (F.col("landmark") % 5) * 6
    y = 150 + wave(F.col("frame_idx") * 6, 160) + (F.col("landmark") % 7) * 5
    conf = 0.5 + ((F.col("event_id") + F.col("landmark")) % 5) * 0.1
    return rows.select("video_id", "frame_idx", F.lit("right").alias("side"), "landmark", x.cast("double").alias("x"), y.cast("double").alias("y"), conf.alias("conf"))
