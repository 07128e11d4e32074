"""Poses: choice of the person, visibility, lifting, smoothing and kinematics.  Joints are rows: video_id, frame_idx,
joint, x, y, conf, x3, y3, z3; missing coordinates are null."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.functions.geometry import angle, norm, sub
from taskloom.functions.temporal import batched, by_frame, folded, gap_filled, over, turns

#: The joints in order, the bones and the angles (joint, then its two ends).
JOINTS = ["nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
          "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle"]
BONES = [("left_hip", "left_shoulder"), ("right_hip", "right_shoulder"), ("left_shoulder", "left_elbow"), ("left_elbow", "left_wrist"), ("right_shoulder", "right_elbow"),
         ("right_elbow", "right_wrist"), ("left_hip", "left_knee"), ("left_knee", "left_ankle"), ("right_hip", "right_knee"), ("right_knee", "right_ankle")]
ANGLES = {"left_elbow": ("left_elbow", "left_shoulder", "left_wrist"), "right_elbow": ("right_elbow", "right_shoulder", "right_wrist"),
          "left_knee": ("left_knee", "left_hip", "left_ankle"), "right_knee": ("right_knee", "right_hip", "right_ankle"),
          "left_shoulder": ("left_shoulder", "right_shoulder", "left_elbow"), "right_shoulder": ("right_shoulder", "left_shoulder", "right_elbow"),
          "left_hip": ("left_hip", "right_hip", "left_knee"), "right_hip": ("right_hip", "left_hip", "right_knee")}
J = {name: i for i, name in enumerate(JOINTS)}
KEY = ["video_id", "joint"]


def selected(people: DataFrame) -> DataFrame:
    """One person of each frame: the surest at first, then the one that overlaps the last chosen most; a frame without people forgets.
    ``people`` has video_id, frame_idx (a row with null det_idx for an empty frame), det_idx, conf and box; each video is folded in order."""

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chosen() -> Iterator[tuple]:
            last = None
            for frame, rows in by_frame(parts):
                rows = [r for r in rows if not pd.isna(r.det_idx)]
                if not rows:
                    last = None
                    continue
                best = max(rows, key=lambda r: r.conf) if last is None else max(rows, key=lambda r: overlap(last, (r.x1, r.y1, r.x2, r.y2)))
                last = (best.x1, best.y1, best.x2, best.y2)
                yield best.video_id, frame, int(best.det_idx)

        yield from batched(chosen(), ["video_id", "frame_idx", "det_idx"])

    return folded(people, ["video_id"], ["frame_idx", "det_idx"], choose, "video_id long, frame_idx long, det_idx long")


def overlap(a: tuple, b: tuple) -> float:
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = wide * high if wide > 0 and high > 0 else 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def visibility(joints: DataFrame, width: int, height: int, least: float = 0.2) -> DataFrame:
    inside = (F.col("x") != -1) & (F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height) & (F.col("conf") >= least)
    inside = F.coalesce(inside, F.lit(False))
    seen = inside & (F.col("conf") >= 0.5)
    return joints.withColumn("in_frame", inside).withColumn("visible", seen).withColumn("occluded", inside & ~seen)


def at(name: str, column: str, condition: Column | None = None) -> Column:
    """The column at one joint of a frame, in an aggregation by frame."""
    here = F.col("joint") == J[name]
    return F.max(F.when(here if condition is None else here & condition, F.col(column)))


def lifted(joints: DataFrame, width: int, height: int, depth: dict[int, float] | None = None) -> DataFrame:
    """A plain lift of pixel joints: centred on the hips and scaled by the image, with a depth for each joint and 0.8 of the
    confidence; then centred again on the mean of the hips, where a missing hip counts as (-1, -1, -1)."""
    frame = Window.partitionBy("video_id", "frame_idx")
    hip = F.col("joint").isin(J["left_hip"], J["right_hip"])
    there = F.col("x").isNotNull()
    root = [F.coalesce(F.avg(F.when(hip & there, F.col(c))).over(frame), F.lit(size / 2.0)) for c, size in (("x", width), ("y", height))]
    z = F.lit(0.0)
    for j, d in (depth or {}).items():
        z = F.when(F.col("joint") == j, d).otherwise(z)
    out = joints.withColumn("rx", root[0]).withColumn("ry", root[1])
    flat = {"x3": (F.col("x") - F.col("rx")) / width * 2, "y3": (F.col("y") - F.col("ry")) / height * 2, "z3": z}
    for c, e in flat.items():
        out = out.withColumn(c, F.when(there, e))
    any_hip = F.max(hip & there).over(frame)
    for c in flat:
        mean = F.avg(F.when(hip, F.coalesce(F.col(c), F.lit(-1.0)))).over(frame)
        out = out.withColumn(f"{c}_", F.when(F.col(c).isNotNull(), F.col(c) - F.when(any_hip, mean).otherwise(0.0)))
    return out.select("video_id", "frame_idx", "joint", "x", "y", "conf", *(F.col(f"{c}_").alias(c) for c in flat), F.when(there, F.col("conf") * 0.8).otherwise(0.0).alias("conf3"))


def centred(joints: DataFrame, least: float = 0.2) -> DataFrame:
    """World joints relative to the hips' middle if both are known, else to the mean of the known joints."""
    frame = Window.partitionBy("video_id", "frame_idx")
    known = (F.col("conf") > least) & F.col("x3").isNotNull()
    hip = F.col("joint").isin(J["left_hip"], J["right_hip"]) & known
    both = F.sum(hip.cast("int")).over(frame) == 2
    out = joints.withColumn("known", known).withColumn("both", both)
    for c in ("x3", "y3", "z3"):
        root = F.when(F.col("both"), F.avg(F.when(hip, F.col(c))).over(frame)).otherwise(F.avg(F.when(known, F.col(c))).over(frame))
        out = out.withColumn(f"{c}_", F.when(F.col("known"), F.col(c) - root))
    return out.select("video_id", "frame_idx", "joint", "conf", *(F.col(f"{c}_").alias(c) for c in ("x3", "y3", "z3")))


def valid(joints: DataFrame, columns: list[str]) -> DataFrame:
    """Coordinates count only with a confidence above 0."""
    for c in columns:
        joints = joints.withColumn(c, F.when(F.col("conf") > 0, F.col(c)))
    return joints


def filled(joints: DataFrame, columns: list[str], max_gap: int = 5) -> DataFrame:
    return gap_filled(valid(joints, columns), KEY, columns, max_gap)


def moving_average(joints: DataFrame, columns: list[str], window: int = 5, max_gap: int = 5) -> DataFrame:
    """Mean of the valid frames around each valid one; gaps stay as filled."""
    half, out = window // 2, filled(joints, columns, max_gap)
    around = over(KEY).rowsBetween(-half, half)
    true = ~F.col("filled") & F.col(columns[0]).isNotNull()
    means = {c: F.when(true, F.avg(F.when(true, F.col(c))).over(around)).otherwise(F.col(c)) for c in columns}
    return out.withColumns(means)


def series(joints: DataFrame, columns: list[str] | list[list[str]], step, max_gap: int) -> DataFrame:
    """Each coordinate of each joint folded in order of frames by ``step(state, value, true) -> (state, value)``; true frames are those
    neither missing nor filled, and a joint's state is None at first.  The windows that fill gaps have brought each joint's frames into one task, so they are sorted there and not dealt out again.  A task
    goes through batches of many joints and holds a number or two of the last.  Columns that are missing apart from each other are given as several lists, and are folded in one pass; ``filled`` is that of the last."""
    sets = columns if columns and isinstance(columns[0], list) else [columns]
    every, rows = [c for some in sets for c in some], joints.drop("filled")
    for i, some in enumerate(sets):
        rows = filled(rows, some, max_gap).withColumnRenamed("filled", f"filled_{i}")
    rows = rows.select("video_id", "frame_idx", "joint", "conf", *(f"filled_{i}" for i in range(len(sets))), *every)

    def smooth(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states, last = dict.fromkeys(every), None
        for part in parts:
            if not len(part):
                continue
            keys = [part[k].to_numpy() for k in KEY]
            new = turns(keys, len(part))
            new[0] = last != tuple(k[0] for k in keys)
            last = tuple(k[-1] for k in keys)
            new, out = new.tolist(), {}
            for i, some in enumerate(sets):
                true = (~part[f"filled_{i}"].to_numpy(bool) & part[some[0]].notna().to_numpy()).tolist()
                for c in some:
                    state, values = states[c], []
                    for first, value, real in zip(new, part[c].tolist(), true, strict=True):
                        state, value = step(None if first else state, value, real)
                        values.append(value)
                    states[c], out[c] = state, values
            yield part.assign(**out)

    kind = ", ".join(["video_id long, frame_idx long, joint long, conf double", *(f"filled_{i} boolean" for i in range(len(sets))), *(f"{c} double" for c in every)])
    done = rows.sortWithinPartitions(*KEY, "frame_idx").mapInPandas(smooth, kind)
    done = done.withColumnRenamed(f"filled_{len(sets) - 1}", "filled").select("video_id", "frame_idx", "joint", "conf", "filled", *every)
    return done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in every})


def exponential(joints: DataFrame, columns: list[str] | list[list[str]], alpha: float = 0.5, max_gap: int = 5) -> DataFrame:
    """Exponential smoothing over true frames; the state lasts over gaps."""

    def step(state, value, true):
        if not true:
            return state, value
        new = value if state is None else alpha * value + (1 - alpha) * state
        return new, new

    return series(joints, columns, step, max_gap)


def one_euro(joints: DataFrame, columns: list[str] | list[list[str]], fps: float, min_cutoff: float = 1.0, beta: float = 0.007, d_cutoff: float = 1.0, max_gap: int = 5) -> DataFrame:
    """The one-euro filter: a low pass whose cutoff rises with speed; it starts anew after each frame that isn't true."""
    dt = 1.0 / fps

    def alpha(cutoff):
        r = 2 * math.pi * cutoff * dt
        return r / (r + 1)

    def step(state, value, true, slow=alpha(d_cutoff)):
        if not true:
            return None, value
        if state is None:
            return (value, 0.0), value
        last, speed = state
        speed = slow * ((value - last) / dt) + (1 - slow) * speed
        a = alpha(min_cutoff + beta * abs(speed))
        new = a * value + (1 - a) * last
        return (new, speed), new

    return series(joints, columns, step, max_gap)


def pelvis(joints: DataFrame, least: float = 0.2) -> DataFrame:
    """A virtual root: the middle of usable hips, or the one that is; confidence of what it is made of."""
    usable = (F.col("conf") >= least) & F.col("x").isNotNull()
    hips = {f"{s[0]}{c}": at(f"{s}_hip", c, usable) for s in ("left", "right") for c in ("x", "y", "conf")}
    wide = joints.groupBy("video_id", "frame_idx").agg(*(e.alias(n) for n, e in hips.items()))
    out = {c: F.when(F.col("lx").isNotNull() & F.col("rx").isNotNull(), (F.col(f"l{c}") + F.col(f"r{c}")) / 2).otherwise(F.coalesce(f"l{c}", f"r{c}")) for c in ("x", "y", "conf")}
    return wide.select("video_id", "frame_idx", out["x"].alias("x"), out["y"].alias("y"), F.coalesce(out["conf"], F.lit(0.0)).alias("conf"), out["x"].isNotNull().alias("valid"))


def velocities(joints: DataFrame, fps: float, smoothing: int = 3, least: float = 0.2) -> DataFrame:
    """Central differences (one-sided at the ends), 0 where the joint isn't known, then a box filter with zeros beyond the ends."""
    w = over(KEY)
    known = (F.col("conf") >= least) & F.col("x3").isNotNull()
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    out = joints.withColumn("n_", n).withColumn("i_", F.row_number().over(w)).withColumn("known_", known)
    half = smoothing // 2
    for c in ("x3", "y3", "z3"):
        v = F.coalesce(F.col(c), F.lit(-1.0))
        now, before, after = v, F.lag(v).over(w), F.lead(v).over(w)
        raw = F.when(F.col("i_") == 1, (after - now) * fps).when(F.col("i_") == F.col("n_"), (now - before) * fps).otherwise((after - before) * fps / 2)
        out = out.withColumn(f"r{c}", F.when(F.col("known_"), raw).otherwise(0.0))
    boxed = {f"v{c[0]}": F.when(F.col("n_") > 1, F.sum(f"r{c}").over(w.rowsBetween(-half, half)) / float(smoothing)) for c in ("x3", "y3", "z3")}
    out = out.withColumns(boxed)
    return out.select("video_id", "frame_idx", "joint", "vx", "vy", "vz", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2).alias("speed"))


def wide(joints: DataFrame, names: list[str], least: float) -> DataFrame:
    """One row for each frame with the 3-D points of the named joints, null where not known."""
    known = (F.col("conf") >= least) & F.col("x3").isNotNull()
    return joints.where(F.col("joint").isin([J[n] for n in names])).groupBy("video_id", "frame_idx").agg(*(at(n, c, known).alias(f"{n}_{c}") for n in names for c in ("x3", "y3", "z3")))


def point(name: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{name}_{c}") for c in ("x3", "y3", "z3"))


def joint_angles(joints: DataFrame, least: float = 0.2) -> DataFrame:
    names = sorted({n for three in ANGLES.values() for n in three})
    rows = [F.struct(F.lit(n).alias("name"), angle(sub(point(a), point(j)), sub(point(b), point(j))).alias("degrees")) for n, (j, a, b) in ANGLES.items()]
    return wide(joints, names, least).select("video_id", "frame_idx", F.explode(F.array(*rows)).alias("r")).select("video_id", "frame_idx", "r.name", "r.degrees").where("degrees is not null")


def bone_lengths(joints: DataFrame, least: float = 0.2) -> DataFrame:
    names = sorted({n for two in BONES for n in two})
    rows = [F.struct(F.lit(f"{a}_{b}").alias("name"), norm(sub(point(a), point(b))).alias("length")) for a, b in BONES]
    return wide(joints, names, least).select("video_id", "frame_idx", F.explode(F.array(*rows)).alias("r")).select("video_id", "frame_idx", "r.name", "r.length").where("length is not null")


def wrists(joints: DataFrame) -> DataFrame:
    return joints.where(F.col("joint").isin(J["left_wrist"], J["right_wrist"])).withColumn("side", F.when(F.col("joint") == J["left_wrist"], "left").otherwise("right"))


def remapped(points: DataFrame, spark: SparkSession, mapping: dict[int, int], least: float = 0.1) -> DataFrame:
    """Landmarks of another layout as joints of this one, missing below a confidence."""
    dim = spark.createDataFrame(list(mapping.items()), "landmark long, joint long")
    kept = points.join(F.broadcast(dim), "landmark").drop("landmark")  # as many rows as the layout has
    return kept.withColumns({c: F.when(F.col("conf") > least, F.col(c)) for c in ("x", "y")})


def person_of(points: DataFrame, spark: SparkSession, mapping: dict[int, int], width: int, height: int, least: float = 0.1, margin: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """The joints and the person of landmarks of another layout (x and y in parts of the image): joints in pixels, missing with confidence 0 below ``least``; and for each
    frame with any the box around them, widened by ``margin`` and held within the image, and their mean confidence."""
    joints = remapped(points.withColumn("x", F.col("x") * width).withColumn("y", F.col("y") * height), spark, mapping, least)
    joints = joints.withColumn("conf", F.when(F.col("conf") > least, F.col("conf")).otherwise(0.0))
    seen = joints.where(F.col("conf") > least).groupBy("video_id", "frame_idx")
    box = [F.greatest(F.lit(0.0), F.min("x") - margin).alias("x1"), F.greatest(F.lit(0.0), F.min("y") - margin).alias("y1"), F.least(F.lit(float(width)), F.max("x") + margin).alias("x2"), F.least(F.lit(float(height)), F.max("y") + margin).alias("y2")]
    return joints, seen.agg(*box, F.avg("conf").alias("conf"))


def wrist_speeds(joints: DataFrame, fps: float, smoothing: int = 3, least: float = 0.2) -> DataFrame:
    """Place and speed of both wrists in every frame; ``joints`` with world coordinates."""
    moving = velocities(joints, fps, smoothing, least).select("video_id", "frame_idx", "joint", "speed")
    return wrists(joints).join(moving, ["video_id", "frame_idx", "joint"]).select("video_id", "frame_idx", "side", "x3", "y3", "z3", "conf", "speed")
