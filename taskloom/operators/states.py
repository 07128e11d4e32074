"""Object states: motion, support, interaction, containment, and their changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.geometry import center, distance
from taskloom.functions.temporal import over

KEY = ["video_id", "object_id"]
DIMENSIONS = ["motion_state", "support_relation", "interaction_state", "containment"]
#: Fixed values.
FIXTURES, CONTAINERS = ("fixture", "machine", "station"), ("bin", "box", "container")


def motion(tracks: DataFrame, window: int = 3, threshold: float = 5.0) -> DataFrame:
    """Adds ``motion_state``: moving if the mean step of the box centre around a frame is above the threshold."""
    w, (cx, cy) = over(KEY), center()
    step = distance(F.lead(cx).over(w), F.lead(cy).over(w), cx, cy)
    mean = F.avg("step_").over(w.rowsBetween(-window, window - 1))
    moving = F.col("x1").isNotNull() & (mean > threshold)
    return tracks.withColumn("step_", step).withColumn("motion_state", F.when(moving, "moving").otherwise("static")).drop("step_")


def beside(classes: tuple[str, ...]) -> Column:
    """The boxes of those classes in a row's frame, as a list: a frame's rows are few, and meet once for all that is asked of them."""
    there = F.col("class_name").isin(*classes) & F.col("x1").isNotNull()
    box = F.struct(F.col("object_id").alias("id"), F.col("class_name").alias("kind"), "x1", "y1", "x2", "y2")
    return F.collect_list(F.when(there, box)).over(Window.partitionBy("video_id", "frame_idx"))


def supported(tracks: DataFrame, reach: float = 20.0, classes: tuple[str, ...] = FIXTURES) -> DataFrame:
    """``support``: unknown if missing, fixture if its bottom is near another fixture's top and between its sides, else table."""
    cx, _ = center()
    on = F.exists("near_", lambda o: (F.col("object_id") != o["id"]) & (o["x1"] < cx) & (cx < o["x2"]) & (F.abs(F.col("y2") - o["y1"]) < reach))
    rows = tracks.withColumn("near_", beside(classes))
    return rows.withColumn("support", F.when(F.col("x1").isNull(), "unknown").when(on, "fixture").otherwise("table")).drop("near_")


def contained(tracks: DataFrame, classes: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """``containment``: unknown if missing, in_bin or in_box after the first container whose box holds its centre, else none."""
    cx, cy = center()
    around = F.filter("near_", lambda o: (F.col("object_id") != o["id"]) & (o["x1"] < cx) & (cx < o["x2"]) & (o["y1"] < cy) & (cy < o["y2"]))
    first = F.array_min(F.transform(around, lambda o: F.struct(o["id"].alias("id"), o["kind"].alias("kind"))))["kind"]
    kind = F.when(first.isNull(), "none").when(F.lower(first).contains("bin"), "in_bin").otherwise("in_box")
    rows = tracks.withColumn("near_", beside(classes))
    return rows.withColumn("containment", F.when(F.col("x1").isNull(), "unknown").otherwise(kind)).drop("near_")


def refined(tracks: DataFrame, contact: DataFrame, grasp: DataFrame, fixtures: tuple[str, ...] = FIXTURES, containers: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """All four states: grasped objects are in the hand even if unseen, touched ones are in contact.  ``tracks`` has motion_state, and perhaps support
    and containment; ``contact`` and ``grasp`` are sets of (video_id, object_id, frame_idx)."""
    where = [*KEY, "frame_idx"]
    rows = tracks if {"support", "containment"} <= set(tracks.columns) else contained(supported(tracks, classes=fixtures), containers)
    marks = contact.select(*where, F.lit(False).alias("g_")).unionByName(grasp.select(*where, F.lit(True).alias("g_")))
    marks = marks.groupBy(*where).agg(F.max("g_").alias("g_"), F.max(~F.col("g_")).alias("c_"))  # both sets meet the tracks in one join
    rows = rows.join(marks, where, "left")
    state = F.when(F.col("g_"), "grasped").when(F.col("c_"), "in_contact").otherwise("none")
    held = F.when(F.col("g_"), "hand").otherwise(F.col("support"))
    return rows.withColumn("interaction_state", state).withColumn("support_relation", held).drop("c_", "g_", "support")


def changes(states: DataFrame, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """``video_id, object_id, frame_idx, dimension, from, to`` at every change of a state."""
    w = over(KEY)
    each = states.select(*KEY, "frame_idx", *dimensions, *(F.lag(d).over(w).alias(f"{d}_") for d in dimensions))
    each = each.where(reduce(Column.__or__, (F.col(f"{d}_") != F.col(d) for d in dimensions)))
    rows = [F.struct(F.lit(i).alias("rank"), F.lit(d).alias("dimension"), F.col(f"{d}_").alias("from"), F.col(d).alias("to")) for i, d in enumerate(dimensions)]
    each = each.select(*KEY, "frame_idx", F.explode(F.array(*rows)).alias("c"))
    return each.where("c.from <> c.to").select(*KEY, "frame_idx", "c.dimension", "c.from", "c.to")

