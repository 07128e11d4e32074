"""The first-person view: similarity of image and pose, head pose, and points in the head's frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.geometry import Vector, add, choose, cross, distance, dot, scale, sub, unit
from taskloom.operators.pose import J, at

TORSO = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")
HEAD = ("nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder")
KEY = ["video_id", "frame_idx"]


def image_fit(joints: DataFrame, least: float = 0.2) -> DataFrame:
    """``scale, tx, ty, z_plane`` that take pixels to the pose's metres, by least squares over at least three known joints; null if there
    is no such fit."""
    known = joints.where((F.col("conf") > least) & F.col("x3").isNotNull() & (F.col("x") >= 0) & (F.col("y") >= 0))
    torso = F.col("joint").isin(*(J[n] for n in TORSO))
    per = known.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), (F.covar_pop("x", "x3") + F.covar_pop("y", "y3")).alias("cov"), (F.var_pop("x") + F.var_pop("y")).alias("var"),
        *(F.avg(c).alias(f"m{c}") for c in ("x", "y", "x3", "y3")), F.avg(F.when(torso, F.col("z3"))).alias("z_plane"),
    )
    s = F.when((F.col("n") >= 3) & (F.col("var") * F.col("n") >= 1e-9), F.try_divide("cov", "var"))
    fit = per.withColumn("scale", F.when(F.abs(s) >= 1e-9, s)).where("scale is not null")
    return fit.select(*KEY, "scale", (F.col("mx3") - F.col("scale") * F.col("mx")).alias("tx"), (F.col("my3") - F.col("scale") * F.col("my")).alias("ty"), F.coalesce("z_plane", F.lit(0.0)).alias("z_plane"))


def placed(points: DataFrame, fit: DataFrame, x: str, y: str) -> DataFrame:
    """Adds px, py, pz: pixels in the pose's frame."""
    return points.join(fit, KEY).withColumns({"px": F.col("scale") * F.col(x) + F.col("tx"), "py": F.col("scale") * F.col(y) + F.col("ty"), "pz": F.col("z_plane")})


def constant(x: float, y: float, z: float) -> Vector:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def named(prefix: str, v: Vector) -> list[Column]:
    return [e.alias(f"{prefix}_{c}") for c, e in zip("xyz", v, strict=True)]


def vector(prefix: str) -> Vector:
    return tuple(F.col(f"{prefix}_{c}") for c in "xyz")


def head_pose(joints: DataFrame, gaze_down: float = 30.0, offset: float = 0.1, sure: float = 0.3) -> DataFrame:
    """``eye, forward, up, right`` (x, y, z each) and ``confidence`` of each frame: from eyes, ears, nose or shoulders, whichever is sure first."""
    parts = [at(n, c).alias(f"{n}_{s}") for n in HEAD for s, c in (("x", "x3"), ("y", "y3"), ("z", "z3"))]
    w = joints.groupBy(*KEY).agg(*parts, *(F.coalesce(at(n, "conf"), F.lit(0.0)).alias(f"{n}_c") for n in HEAD))
    ok = {n: (F.col(f"{n}_c") > sure) & F.col(f"{n}_x").isNotNull() for n in HEAD}
    eyes, ears, shoulders = (ok[f"left_{n}"] & ok[f"right_{n}"] for n in ("eye", "ear", "shoulder"))
    mid = lambda n: scale(add(vector(f"left_{n}"), vector(f"right_{n}")), 0.5)
    conf = lambda n: (F.col(f"left_{n}_c") + F.col(f"right_{n}_c")) / 2
    none = ~(eyes | ears | ok["nose"] | shoulders)
    center = choose([(eyes, mid("eye")), (ears, mid("ear")), (ok["nose"], vector("nose")), (shoulders, add(mid("shoulder"), constant(0, -0.25, 0)))], constant(0, 0, 0))
    w = w.select("*", *named("h", center), F.when(eyes, conf("eye")).when(ears, conf("ear")).when(ok["nose"], F.col("nose_c")).when(shoulders, 0.3).otherwise(0.0).alias("confidence"))
    across = lambda n: unit(sub(vector(f"right_{n}"), vector(f"left_{n}")))
    w = w.select("*", *named("r0", choose([(ears, across("ear")), (shoulders, across("shoulder"))], constant(1, 0, 0))))
    w = w.select("*", *named("u0", choose([(shoulders, unit(sub(vector("h"), mid("shoulder"))))], constant(0, -1, 0))))
    w = w.select("*", *named("f0", unit(cross(vector("u0"), vector("r0")))))
    w = w.select("*", *named("r1", unit(cross(vector("f0"), vector("u0")))))
    c, s = math.cos(math.radians(gaze_down)), math.sin(math.radians(gaze_down))
    forward = choose([(none, constant(0, 0, 1))], sub(scale(vector("f0"), c), scale(vector("u0"), s)))
    up = choose([(none, constant(0, -1, 0))], add(scale(vector("f0"), s), scale(vector("u0"), c)))
    right = choose([(none, constant(1, 0, 0))], vector("r1"))
    w = w.withColumn("none", none).select(*KEY, "none", "confidence", *named("h", vector("h")), *named("forward", forward), *named("up", up), *named("right", right))
    eye = choose([(F.col("none"), constant(0, 0, 0))], add(vector("h"), scale(vector("forward"), offset)))
    return w.select(*KEY, *named("eye", eye), *named("forward", vector("forward")), *named("up", vector("up")), *named("right", vector("right")), "confidence")


def in_head_frame(points: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds ex, ey, ez: px, py, pz seen from the eye, x to the right, y down, z forward."""
    d = sub(tuple(F.col(c) for c in ("px", "py", "pz")), vector("eye"))
    rows = points.join(heads, KEY)
    return rows.withColumns({"ex": dot(d, vector("right")), "ey": -dot(d, vector("up")), "ez": dot(d, vector("forward"))}).drop(*(f"{v}_{c}" for v in ("eye", "forward", "up", "right") for c in "xyz"))


def projected(points: DataFrame, width: int = 960, height: int = 720) -> DataFrame:
    """Adds u, v, shown: points in front of the eye on its image."""
    depth = F.col("ez") + 0.5
    shown = F.col("ez") > 0.01
    rows = points.withColumns({"u": F.when(shown, width / 2 + F.col("ex") * (width / 2) / depth), "v": F.when(shown, height / 2 + F.col("ey") * (height / 2) / depth)})
    within = (F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)
    return rows.withColumn("shown", F.coalesce(within, F.lit(False)))


def anchored_hands(hands: DataFrame, joints: DataFrame, fit: DataFrame, least: float = 0.2, sure: float = 0.3) -> DataFrame:
    """Each detected hand at its nearest usable body wrist; of several at one wrist the first detected stays, the others go.  ``hands`` has
    video_id, frame_idx, det_idx, x, y; adds ``side`` and the wrist's place.  Where it has ``conf``, only hands surer than ``sure`` are shown; the others still take their wrist."""
    usable = joints.where(F.col("joint").isin(J["left_wrist"], J["right_wrist"]) & (F.col("conf") > least) & (F.col("x") >= 0))
    w = usable.select(*KEY, F.when(F.col("joint") == J["left_wrist"], "left").otherwise("right").alias("side"), F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("x3").alias("px"), F.col("y3").alias("py"), F.col("z3").alias("pz"))
    d = distance(F.col("x"), F.col("y"), F.col("wx"), F.col("wy"))
    near = hands.join(w, KEY).join(fit.select(*KEY, "scale"), KEY).withColumn("d", d)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy(*KEY, "det_idx").orderBy("d", "side"))).where("r = 1")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy(*KEY, "side").orderBy("det_idx"))).where("r = 1").drop("r", "d")
    return near.where(F.col("conf") > sure) if "conf" in hands.columns else near


def hand_landmarks(hands: DataFrame, landmarks: DataFrame, width: int) -> DataFrame:
    """px, py, pz of the landmarks (det_idx, landmark, x, y, z) of anchored hands: offsets from the wrist, scaled, from the body's wrist."""
    base = landmarks.where("landmark = 0").select(*KEY, "det_idx", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"))
    rows = landmarks.drop("side").join(base, [*KEY, "det_idx"]).join(hands.select(*KEY, "det_idx", "side", "scale", "px", "py", "pz"), [*KEY, "det_idx"])
    place = {"px": F.col("px") + (F.col("x") - F.col("x0")) * F.col("scale"), "py": F.col("py") + (F.col("y") - F.col("y0")) * F.col("scale"), "pz": F.col("pz") + (F.col("z") - F.col("z0")) * width * F.col("scale")}
    return rows.select(*KEY, "side", "landmark", *(e.alias(c) for c, e in place.items()))


def pinches(placed_landmarks: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Whether thumb tip and index tip of a hand are within the threshold, in metres."""
    tip = {n: [F.max(F.when(F.col("landmark") == i, F.col(c))) for c in ("px", "py", "pz")] for n, i in (("thumb", 4), ("index", 8))}
    d = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(tip["thumb"], tip["index"], strict=True)), F.lit(0.0)))
    return placed_landmarks.groupBy(*KEY, "side").agg(d.alias("pinch_distance")).withColumn("pinching", F.col("pinch_distance") < threshold)


def summary(heads: DataFrame, hands: DataFrame, objects: DataFrame, arm: DataFrame | None = None) -> DataFrame:
    """Frames per video with a head, either hand, objects and, if arms are given, either arm."""
    n = heads.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.count(F.when(F.col("confidence") > 0, 1)).alias("with_head"))
    h = hands.groupBy("video_id").agg(F.countDistinct(F.when(F.col("side") == "left", F.col("frame_idx"))).alias("with_left_hand"), F.countDistinct(F.when(F.col("side") == "right", F.col("frame_idx"))).alias("with_right_hand"))
    o = objects.groupBy("video_id").agg(F.countDistinct("frame_idx").alias("with_objects"))
    rows = n.join(h, "video_id", "left").join(o, "video_id", "left")
    counts = ["with_left_hand", "with_right_hand", "with_objects"]
    if arm is not None:
        rows, counts = rows.join(arm.groupBy("video_id").agg(F.countDistinct("frame_idx").alias("with_arms")), "video_id", "left"), [*counts, "with_arms"]
    return rows.fillna(0, counts)


def body_relative(joints: DataFrame, points: DataFrame, least: float = 0.2) -> DataFrame:
    """Points (x, y) relative to the shoulders' middle in shoulder widths: the live view's plain frame."""
    usable = (F.col("conf") >= least) & F.col("x").isNotNull()
    parts = [at(f"{s}_shoulder", c, usable).alias(f"{s[0]}{c}") for s in ("left", "right") for c in ("x", "y")]
    body = joints.groupBy(*KEY).agg(*parts).withColumn("w", distance(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))).where("w > 0")
    return points.join(body, KEY).withColumns({"bx": (F.col("x") - (F.col("lx") + F.col("rx")) / 2) / F.col("w"), "by": (F.col("y") - (F.col("ly") + F.col("ry")) / 2) / F.col("w")}).drop("lx", "ly", "rx", "ry", "w")


#: The joints of an arm, in order.
ARM = ("shoulder", "elbow", "wrist")


def arms(joints: DataFrame, heads: DataFrame, sure: float = 0.3) -> DataFrame:
    """``side, part`` (shoulder 0, elbow 1, wrist 2) and ``ex, ey, ez``: arms of which all three joints are sure, in the head's frame."""
    dims = [(J[f"{side}_{p}"], side, i) for side in ("left", "right") for i, p in enumerate(ARM)]
    side, part = F.lit(None).cast("string"), F.lit(None).cast("int")
    for j, s, i in dims:
        side, part = F.when(F.col("joint") == j, s).otherwise(side), F.when(F.col("joint") == j, i).otherwise(part)
    rows = joints.where(F.col("joint").isin([j for j, _, _ in dims]) & (F.col("conf") > sure) & F.col("x3").isNotNull())
    rows = rows.select(*KEY, side.alias("side"), part.alias("part"), F.col("x3").alias("px"), F.col("y3").alias("py"), F.col("z3").alias("pz"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*KEY, "side"))).where("n = 3").drop("n")
    return in_head_frame(rows, heads).select(*KEY, "side", "part", "ex", "ey", "ez")


def has_pose(joints: DataFrame, least: float = 0.2) -> DataFrame:
    """Whether any joint of a frame is surer than ``least``: frames without are shown from a head at the origin, without fit, hands and arms."""
    sure = joints["conf3"] if "conf3" in joints.columns else joints["conf"]
    return joints.groupBy(*KEY).agg(F.coalesce(F.max(sure > least), F.lit(False)).alias("has_pose"))
