"""The live first-person view: arms, hands and objects placed before a fixed eye from what the image shows of the body.

A row is a frame with lists: ``joints`` (joint, x, y, conf), ``hands`` (points: landmark, x, y, z; in order of detection) and ``objects`` (object_id and box).  Everything is an expression over one
row, so the same call serves a table and a stream, without state.  The distances that place arms, hands and objects are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions.lineage import large
from taskloom.operators.ego import ARM
from taskloom.operators.pose import J

KEY = ["video_id", "frame_idx"]
SURE = 0.3


def nested(frames: DataFrame, joints: DataFrame, landmarks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Frames with the lists that ``seen`` takes.  ``landmarks`` has a hand's ``side``, its z if there is one, and ``det_idx`` if several hands can be on one side."""
    z = F.col("z") if "z" in landmarks.columns else F.lit(None).cast("double")
    det = F.col("det_idx") if "det_idx" in landmarks.columns else F.lit(0)
    j = joints.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("joint", "x", "y", "conf"))).alias("joints"))
    hand = landmarks.groupBy(*KEY, det.alias("det_idx"), "side").agg(F.array_sort(F.collect_list(F.struct("landmark", "x", "y", z.alias("z")))).alias("points"))
    h = hand.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("det_idx", "side", "points"))).alias("hands"))
    box = tracks.where("x1 is not null").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("object_id", "x1", "y1", "x2", "y2"))).alias("objects"))
    return frames.select(*KEY).join(large(j), KEY, "left").join(large(h), KEY, "left").join(large(box), KEY, "left")


def named(name: str) -> Column:
    return F.try_element_at(F.filter("joints", lambda j: j["joint"] == J[name]), F.lit(1))


def known(*joints: Column) -> Column:
    out = F.lit(True)
    for j in joints:
        out = out & F.coalesce((j["conf"] > SURE) & j["x"].isNotNull() & j["y"].isNotNull(), F.lit(False))
    return out


def body(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Adds the body's middle ``cx, cy``, its directions to the right and forward, and the width ``wide`` of the shoulders; the image's middle and axes where they aren't sure."""
    rows = once(rows, l_=named("left_shoulder"), r_=named("right_shoulder"))
    dx, dy = F.col("s_.r_.x") - F.col("s_.l_.x"), F.col("s_.r_.y") - F.col("s_.l_.y")
    ok = known(F.col("s_.l_"), F.col("s_.r_"))
    long_ = F.when(ok, F.sqrt(dx * dx + dy * dy)).otherwise(0.0)
    middle = {c: F.when(ok, (F.col(f"s_.l_.{c[1]}") + F.col(f"s_.r_.{c[1]}")) / 2).otherwise(size / 2.0) for c, size in (("cx", width), ("cy", height))}
    rows = once(rows, long_=long_, dx=dx, dy=dy, **middle)
    turned = F.col("s_.long_") > 10
    ahead = {"rx": F.when(turned, F.col("s_.dx") / F.col("s_.long_")).otherwise(1.0), "ry": F.when(turned, F.col("s_.dy") / F.col("s_.long_")).otherwise(0.0)}
    ahead |= {"fx": F.when(turned, -F.col("s_.dy") / F.col("s_.long_")).otherwise(0.0), "fy": F.when(turned, F.col("s_.dx") / F.col("s_.long_")).otherwise(-1.0)}
    rows = once(rows, **ahead, cx=F.col("s_.cx"), cy=F.col("s_.cy"), wide=F.when(F.col("s_.long_") < 10, width * 0.3).otherwise(F.col("s_.long_")))
    return rows.select("*", "s_.*").drop("s_")


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """Values in a struct ``s_`` that later expressions refer to; behind a generator, so they are computed once a row and not anew in each of these."""
    return rows.withColumn("s_", F.explode(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))


def across(x: Column, y: Column) -> Column:
    """How far a point lies to the body's right, in widths of its shoulders."""
    return ((x - F.col("cx")) * F.col("rx") + (y - F.col("cy")) * F.col("ry")) / F.col("wide")


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def arm(side: str, height: int) -> Column:
    """Shoulder, elbow and wrist of an arm in the lower corner of its side; null unless all are sure."""
    joints, sign = [named(f"{side}_{part}") for part in ARM], -1 if side == "left" else 1
    out = []
    for i, j in enumerate(joints):
        forward = ((j["x"] - F.col("cx")) * F.col("fx") + (j["y"] - F.col("cy")) * F.col("fy")) / F.col("wide")
        out.append(point(sign * (0.6 + 0.3 * (1 - i / 2)) + across(j["x"], j["y"]) * 0.3, 0.3 + i * 0.15 + (j["y"] - F.col("cy")) / height * 0.5, 0.4 + i * 0.1 + F.abs(forward) * 0.2))
    return F.when(known(*joints), F.array(*out))


def hand(h: Column) -> Column:
    """A hand's landmarks around the place of its side, and its pinch in parts of its size."""
    xs, ys = F.transform(h["points"], lambda p: p["x"]), F.transform(h["points"], lambda p: p["y"])
    low, high = (F.array_min(xs), F.array_min(ys)), (F.array_max(xs), F.array_max(ys))
    size = F.greatest(high[0] - low[0], high[1] - low[1], F.lit(1.0))
    mid = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    at = lambda i: F.try_element_at(F.filter(h["points"], lambda p: p["landmark"] == i), F.lit(1))
    left = across(at(0)["x"], at(0)["y"]) < 0
    base = F.when(left, -0.5).otherwise(0.5)
    points = F.transform(h["points"], lambda p: point(base + (p["x"] - mid[0]) / size * 0.4, 0.4 + (p["y"] - mid[1]) / size * 0.4, 0.5 + F.coalesce(p["z"], F.lit(0.0)) * 0.3))
    dx, dy = at(4)["x"] - at(8)["x"], at(4)["y"] - at(8)["y"]
    pinch = F.sqrt(dx * dx + dy * dy) / size
    return F.struct(left.alias("is_left"), points.alias("points"), pinch.alias("pinch_distance"), (pinch < 0.3).alias("pinching"))


def seen(rows: DataFrame, width: int, height: int) -> DataFrame:
    """``left_arm, right_arm`` (three points), ``left_hand, right_hand`` (points, pinch_distance, pinching; the last detected of a side) and ``objects`` (object_id, x, y, z) of each frame."""
    rows = body(rows, width, height)
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    rows = once(rows, h_=F.transform(empty("hands"), hand)).withColumn("h_", F.col("s_.h_"))
    side = lambda left: F.try_element_at(F.filter("h_", lambda h: h["is_left"] == left), F.lit(-1)).dropFields("is_left")

    def thing(o: Column) -> Column:
        x, y = (o["x1"] + o["x2"]) / 2, (o["y1"] + o["y2"]) / 2
        size = F.greatest(o["x2"] - o["x1"], o["y2"] - o["y1"])
        return F.struct(o["object_id"].alias("object_id"), (across(x, y) * 0.8).alias("x"), ((y - F.col("cy")) / height).alias("y"), F.greatest(F.lit(0.4), 1.2 - size / float(max(width, height)) * 1.5).alias("z"))

    return rows.select(*KEY, arm("left", height).alias("left_arm"), arm("right", height).alias("right_arm"), side(True).alias("left_hand"), side(False).alias("right_hand"), F.transform(empty("objects"), thing).alias("objects"))
