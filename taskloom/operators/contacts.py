"""Hands and objects: distances, contacts, interactions and contact events."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.geometry import box_distance, center, distance
from taskloom.functions.temporal import fold, hysteresis, islands, over
from taskloom.operators.pose import J, at

HAND = ["video_id", "hand", "object_id"]
#: Features that are an interaction's evidence, and their names there.
FEATURES = {"duration": "duration_frames", "hand_motion": "hand_motion", "object_motion": "object_motion", "correlation": "motion_correlation"}
#: Support and containment where a segment begins and ends.
ENDS = ["s_start", "c_start", "s_end", "c_end"]
#: Landmarks of the fingertips and of the palm.
FINGERTIPS, PALM = (4, 8, 12, 16, 20), (0, 1, 5, 9, 13, 17)


def hand_positions(joints: DataFrame, use_center: bool = True, least: float = 0.2, reach: float = 0.3) -> DataFrame:
    """``video_id, frame_idx, hand, hx, hy, wx, wy``: the wrist, moved on from the elbow by ``reach`` of the forearm if that is usable, and the wrist itself."""
    usable = (F.col("conf") >= least) & F.col("x").isNotNull()
    parts = [at(f"{side}_{part}", c, usable).alias(f"{side}_{part}_{c}") for side in ("left", "right") for part in ("wrist", "elbow") for c in ("x", "y")]
    arms = joints.where(F.col("joint").isin(*(J[f"{side}_{part}"] for side in ("left", "right") for part in ("wrist", "elbow"))))
    wide = arms.groupBy("video_id", "frame_idx").agg(*parts)

    def moved(side: str, c: str) -> Column:
        wrist, elbow = F.col(f"{side}_wrist_{c}"), F.col(f"{side}_elbow_{c}")
        return F.when(elbow.isNotNull(), wrist + reach * (wrist - elbow)).otherwise(wrist) if use_center else wrist

    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("hand"), moved(s, "x").alias("hx"), moved(s, "y").alias("hy"), *(F.col(f"{s}_wrist_{c}").alias(f"w{c}") for c in "xy")) for s in ("left", "right"))))
    return wide.select("video_id", "frame_idx", rows.alias("r")).select("video_id", "frame_idx", "r.*").where("hx is not null")


def distances(hands: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each hand to each box of its frame, both there; the object's support and containment go with it if the tracks have them."""
    cx, cy = center()
    pairs = hands.join(tracks.where("x1 is not null"), ["video_id", "frame_idx"])
    return pairs.select(*HAND, "frame_idx", box_distance(F.col("hx"), F.col("hy")).alias("distance"), "hx", "hy", "wx", "wy", cx.alias("cx"), cy.alias("cy"), *(c for c in ("support", "containment") if c in tracks.columns))


def contacts(near: DataFrame, threshold: float = 50.0, on: int = 2, off: int = 3) -> DataFrame:
    return hysteresis(near, HAND, F.col("distance") < threshold, on, off, "is_contact")


def contact_frames(contact: DataFrame) -> DataFrame:
    return contact.where("is_contact").select("video_id", "object_id", "frame_idx").distinct()


def segments(contact: DataFrame) -> DataFrame:
    return islands(contact.where("is_contact"), HAND)


#: A product and a sum with one rounding; Python has it since 3.13.
fma: Callable[[float, float, float], float] = getattr(math, "fma", lambda a, b, c: float(Fraction(a) * Fraction(b) + Fraction(c)))


def correlation(hand: list[float], thing: list[float]) -> float:
    """Of two lists of steps, summed up in their order and rounded as the SQL's engine does it, since equal confidences are told apart by the last digit.  0 where one hardly varies."""
    n, x, y, xx, yy, xy = 0, 0.0, 0.0, 0.0, 0.0, 0.0
    for n, (a, b) in enumerate(zip(hand, thing, strict=True), 1):
        da, db = a - x, b - y
        x, y = x + da / n, y + db / n
        xx, yy = xx + (a - x) * da, yy + (b - y) * db
        try:
            xy = fma(db, a - x, xy)
        except (ValueError, OverflowError):  # of infinite steps
            xy = math.nan
    sa, sb = math.sqrt(xx / n), math.sqrt(yy / n)
    return 0.0 if sa < 1e-6 or sb < 1e-6 else xy / n / (sa * sb)


def _correlations(hand: pa.Array, thing: pa.Array) -> pa.Array:
    return pa.array([None if a is None else correlation(a, b) for a, b in zip(hand.to_pylist(), thing.to_pylist(), strict=True)], pa.float64())


def features(contact: DataFrame) -> DataFrame:
    """The segments of contact, with the path lengths of hand (wrist) and object over each and the correlation of their steps.  A segment's frames are adjacent
    and both are there in all of them, so steps are taken along its own rows; they are summed up from the last to the first, as the SQL's engine does from some thousand segments on.  Support and containment at both ends, if they are there: ``s_start, c_start, s_end, c_end``."""
    w, (x, y, u, v) = over(HAND), map(F.col, ("wx", "wy", "cx", "cy"))
    ahead = F.lead("frame_idx").over(w) == F.col("frame_idx") + 1

    def step(x: Column, y: Column) -> Column:
        return F.when(ahead, distance(F.lead(x).over(w), F.lead(y).over(w), x, y))

    known = [c for c in ("support", "containment") if c in contact.columns]
    rows = contact.where("is_contact").select(*HAND, "frame_idx", *known, (F.col("frame_idx") - F.row_number().over(w)).alias("run_"), step(x, y).alias("hand_step"), step(u, v).alias("object_step"))
    ends = [of(c, "frame_idx").alias(f"{c[0]}_{e}") for c in known for e, of in (("start", F.min_by), ("end", F.max_by))]
    steps = F.sort_array(F.collect_list(F.struct("frame_idx", "hand_step", "object_step")), asc=False)
    out = rows.groupBy(*HAND, "run_").agg(F.min("frame_idx").alias("frame_start"), F.max("frame_idx").alias("frame_end"), steps.alias("steps"), *ends)
    out = out.withColumns({f"{c}_motion": F.aggregate(f"steps.{c}_step", F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0))) for c in ("hand", "object")})
    out = out.withColumn("steps", F.filter("steps", lambda s: s["hand_step"].isNotNull() & s["object_step"].isNotNull()))
    pair = [F.when(F.size("steps") >= 3, F.col(f"steps.{c}_step")) for c in ("hand", "object")]
    corr = F.arrow_udf(_correlations, "double")(*pair)
    return out.select(
        *HAND, "frame_start", "frame_end", (F.col("frame_end") - F.col("frame_start") + 1).alias("duration"), "hand_motion",
        "object_motion", F.coalesce(corr, F.lit(0.0)).alias("correlation"), *(c for c in ENDS if c in out.columns),
    )


def interactions(feature: DataFrame, states: DataFrame | None = None, motion: float = 5.0, correlation: float = 0.7, grasp: int = 5, push: int = 3) -> DataFrame:
    """Adds ``label`` and ``confidence``, by the first rule that holds.  ``states`` has support_relation and containment; without it the features have those of both ends."""
    ends = [] if states is None else [states.select("video_id", "object_id", F.col("frame_idx").alias(f"frame_{e}"), F.col("support_relation").alias(f"s_{e}"), F.col("containment").alias(f"c_{e}")) for e in ("start", "end")]
    rows = feature
    for e in ends:
        rows = rows.join(e, ["video_id", "object_id", e.columns[2]], "left")
    d, c, m = F.col("duration"), F.col("correlation"), F.col("object_motion")
    into = F.array(F.lit("in_bin"), F.lit("in_box"))
    cases = [
        ((d >= grasp) & (c > correlation) & (m > motion * d * 0.5), "grasp", F.least(F.lit(0.9), 0.5 + 0.4 * c)),
        ((F.col("c_start") == "none") & F.array_contains(into, F.col("c_end")), "insert", F.lit(0.8)),
        (F.array_contains(into, F.col("c_start")) & (F.col("c_end") == "none"), "remove", F.lit(0.8)),
        ((F.col("s_start") == "hand") & F.col("s_end").isin("table", "fixture"), "grasp", F.lit(0.7)),
        ((m > motion * d) & (c < correlation) & (d >= push), "push", F.lit(0.6)),
        (d < grasp, "touch", F.lit(0.5)),
    ]
    out = F.struct(F.lit("unknown").alias("label"), F.lit(0.3).alias("confidence"))
    for when, label, confidence in reversed(cases):
        out = F.when(when, F.struct(F.lit(label).alias("label"), confidence.alias("confidence"))).otherwise(out)
    return rows.withColumn("o", out).select(*(c for c in feature.columns if c not in ENDS), "o.label", "o.confidence").where("label <> 'unknown' or duration >= 3")


def merged(found: DataFrame, max_gap: int = 5) -> DataFrame:
    """Interactions of one hand, object and label whose gap is small are one; its confidence is averaged pair by pair, from the left.  ``evidence``, if there are
    features, is that of the first of them, and whether there are several."""
    keys = [*HAND, "label"]
    seen = [c for c in FEATURES if c in found.columns]
    w = over(keys, "frame_start")
    before = F.max("frame_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("frame_start") - before - 1 > max_gap).cast("int"), F.lit(1))
    group = found.withColumn("new", new).withColumn("group_", F.sum("new").over(w))
    per = group.groupBy(*keys, "group_").agg(
        F.min("frame_start").alias("frame_start"), F.max("frame_end").alias("frame_end"), F.count(F.lit(1)).alias("parts"),
        F.array_sort(F.collect_list(F.struct("frame_start", "confidence"))).alias("s"), *(F.min_by(c, "frame_start").alias(c) for c in seen),
    )
    proof = [F.struct(*(F.col(c).alias(FEATURES[c]) for c in seen), F.when(F.col("parts") > 1, True).alias("merged")).alias("evidence")] if seen else []
    values = F.col("s.confidence")
    mean = fold(F.slice(values, 2, F.greatest(F.lit(1), F.size(values))), F.element_at(values, 1), lambda acc, x: (acc + x) / 2)
    return per.select(*keys, "frame_start", "frame_end", mean.alias("confidence"), "parts", *proof)


def events(found: DataFrame, least: float = 0.3, shortest: int = 3, max_gap: int = 5) -> DataFrame:
    """Contact events: sure and long enough after merging, numbered by start within each video."""
    rows = merged(found, max_gap).where((F.col("confidence") >= least) & (F.col("frame_end") - F.col("frame_start") + 1 >= shortest))
    order = over(["video_id"], "frame_start").orderBy("frame_start", "hand", "object_id", "label")
    return rows.withColumn("event_id", (F.row_number().over(order) - 1).cast("long"))


def raw_events(contact: DataFrame, shortest: int = 3) -> DataFrame:
    """Events from contacts alone; nearer means surer."""
    run = F.col("frame_idx") - F.row_number().over(over(HAND))
    rows = contact.where("is_contact").withColumn("run_", run).groupBy(*HAND, "run_").agg(
        F.min("frame_idx").alias("frame_start"), F.max("frame_idx").alias("frame_end"), F.avg("distance").alias("mean_distance")
    )
    rows = rows.where(F.col("frame_end") - F.col("frame_start") + 1 >= shortest)
    return rows.select(*HAND, "frame_start", "frame_end", F.greatest(F.lit(0.3), 1 - F.col("mean_distance") / 100).alias("confidence"), F.struct(F.col("mean_distance").alias("avg_distance")).alias("evidence"))


def timed(event: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``t_start`` and ``t_end`` of events from the frames."""
    for c in ("start", "end"):
        event = event.join(frames.select("video_id", F.col("frame_idx").alias(f"frame_{c}"), F.col("t").alias(f"t_{c}")), ["video_id", f"frame_{c}"], "left")
    return event


def grasp_frames(event: DataFrame) -> DataFrame:
    held = event.where("label = 'grasp'")
    return held.select("video_id", "object_id", F.explode(F.sequence("frame_start", "frame_end")).alias("frame_idx")).distinct()


def hand_geometry(landmarks: DataFrame, tips: bool = False) -> DataFrame:
    """Per hand and frame: wrist, palm centre, pinch distance, whether it is open or grabbing; ``pinch_3d`` if there are columns x3, y3, z3.  Missing
    landmarks give nulls; a hand without any of the palm or of the fingertips is left out.  With ``tips`` the fingertips come along as a list."""
    def one(i: int, c: str) -> Column:
        return F.max(F.when(F.col("landmark") == i, F.col(c)))

    key = ["video_id", "frame_idx", "side"]
    there = {"x3", "y3", "z3"} <= set(landmarks.columns)
    solid = [F.sqrt(sum(F.pow(one(4, c) - one(8, c), 2) for c in ("x3", "y3", "z3"))).alias("pinch_3d")] if there else []
    seen = lambda of, c: F.when(F.col("landmark").isin(*of), c)
    point = F.struct("landmark", "x", "y", "conf")
    rows = landmarks.groupBy(*key).agg(
        one(0, "x").alias("wrist_x"), one(0, "y").alias("wrist_y"), F.avg(seen(PALM, F.col("x"))).alias("palm_x"), F.avg(seen(PALM, F.col("y"))).alias("palm_y"), F.count(seen(PALM, F.lit(1))).alias("palms_"),
        distance(one(4, "x"), one(4, "y"), one(8, "x"), one(8, "y")).alias("pinch"), *solid, F.array_sort(F.collect_list(seen(FINGERTIPS, point))).alias("tips"),
    ).where("palms_ > 0 and size(tips) > 0")
    apart = F.filter(F.transform("tips", lambda p: distance(p["x"], p["y"], F.col("palm_x"), F.col("palm_y"))), lambda d: d.isNotNull())
    spread = F.when(F.size(apart) > 0, F.aggregate(apart, F.lit(0.0), lambda total, d: total + d) / F.size(apart))
    rows = rows.withColumn("spread", spread)
    return rows.select(*key, "wrist_x", "wrist_y", "palm_x", "palm_y", "pinch", "spread", (F.col("spread") > 50).alias("is_open"), (F.col("pinch") < 40).alias("is_grabbing"), *(["pinch_3d"] if there else []), *(["tips"] if tips else []))


def fingertip_contacts(landmarks: DataFrame, tracks: DataFrame, reach: float = 30.0, grab_reach: float = 50.0, interpolated: bool = False) -> DataFrame:
    """Each hand against each box of its frame: whether fingertips or palm touch it, and how surely the hand grabs it.  ``touch_x`` and
    ``touch_y`` are the fingertip nearest to the box, if fingertips touch it; a palm alone touches without a point."""
    key = ["video_id", "frame_idx", "side"]
    boxes = tracks.where("x1 is not null").select("video_id", "frame_idx", "object_id", "x1", "y1", "x2", "y2")
    hands = hand_geometry(landmarks, tips=True).select(*key, "palm_x", "palm_y", "pinch", "tips")  # a row for each hand, with its fingertips as a list
    rows = hands.join(boxes, ["video_id", "frame_idx"])
    rows = rows.withColumn("d", F.transform("tips", lambda p: F.struct(box_distance(p["x"], p["y"]).alias("d"), p["landmark"].alias("landmark"), p["x"].alias("x"), p["y"].alias("y"), p["conf"].alias("conf"))))
    count = lambda when: F.size(F.filter("d", when)).cast("long")
    sure = lambda p: F.when(p["d"] < reach, p["conf"]).otherwise(0.0) + F.when(p["d"] == 0, 0.5 * p["conf"]).otherwise(0.0)
    rows = rows.withColumns({
        "least": F.array_min("d.d"), "tip": F.array_min("d"), "near": count(lambda p: p["d"] < reach), "inside": count(lambda p: p["d"] == 0),
        "weight": F.aggregate("d", F.lit(0.0), lambda total, p: total + F.coalesce(sure(p), F.lit(0.0))),
    })
    palm = box_distance(F.col("palm_x"), F.col("palm_y"))
    fingers = (F.col("least") < reach * (1.5 if interpolated else 1.0)) | (F.col("inside") >= 1)
    touch = fingers | (palm < reach * 0.7)
    point = [F.when(fingers, F.col(f"tip.{c}")).alias(f"touch_{c}") for c in "xy"]
    posed = (F.col("near") >= 2) | (F.col("inside") >= 2) | ((palm == 0) & (F.col("near") >= 1))
    tip_score, pinch_score = F.least(F.col("weight") / 2.5, F.lit(1.0)), F.greatest(F.lit(0.0), 1 - F.col("pinch") / 100)
    palm_score = F.greatest(F.lit(0.0), 1 - palm / grab_reach)
    score = (tip_score * 0.4 + pinch_score * 0.3 + palm_score * 0.3) * (0.8 if interpolated else 1.0)
    grab = posed & (score > 0.35)
    return rows.select(*key, "object_id", touch.alias("is_contact"), grab.alias("is_grab"), F.when(grab, score).otherwise(0.0).alias("grab_confidence"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), *point)


def smoothed_contacts(found: DataFrame, hands: DataFrame, last: int = 5) -> DataFrame:
    """A contact lasts while it held in over 40 % of the last frames of its hand, counted from its first contact; a hand grabs
    while it did in over half of them, then with a confidence of 0.5 at least.  ``hands`` has video_id, side and frame_idx of each hand that is seen, also
    where no box is.  A contact that lasts without touch is put at the box's centre (``contact_x``, ``contact_y``)."""
    key = ["video_id", "side", "frame_idx"]
    hand = hands.select(*key).distinct().withColumn("i", F.row_number().over(over(["video_id", "side"])))
    rows = found.join(hand, key)
    w = over(["video_id", "side", "object_id"], "i")
    first = F.min(F.when(F.col("is_contact"), F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = F.sum(F.col("is_contact").cast("int")).over(w.rangeBetween(1 - last, 0))
    rows = rows.withColumn("contact", F.col("is_contact") | F.coalesce(held > 0.4 * F.least(F.lit(last), F.col("i") - first + 1), F.lit(False)))
    revived = F.col("contact") & ~F.col("is_contact")
    grips = found.groupBy(*key).agg(F.max("is_grab").alias("g"), F.max("grab_confidence").alias("gc"))
    grips = hand.join(grips, key, "left").withColumn("g", F.coalesce("g", F.lit(False))).withColumn("gc", F.coalesce("gc", F.lit(0.0)))
    back = over(["video_id", "side"], "i").rowsBetween(1 - last, 0)
    holds = F.sum(F.col("g").cast("int")).over(back) > 0.5 * F.count(F.lit(1)).over(back)
    grips = grips.withColumn("grabs", F.col("g") | holds).withColumn("grab_confidence", F.when(holds, F.greatest("gc", F.lit(0.5))).otherwise(F.col("gc")))
    place = [F.when(revived, F.col(c)).alias(f"contact_{c[1]}") for c in ("cx", "cy")]
    return rows.select(*key, "object_id", "contact", *place).join(grips.select(*key, "grabs", "grab_confidence"), key)


def in_pixels(landmarks: DataFrame, width: int, height: int) -> DataFrame:
    """Landmarks as a hand model gives them, x and y in parts of the image and z from the wrist: pixels as x and y, what was given as x3, y3 and z3, and a confidence
    of 0.9 where there is none or it is 0."""
    seen = F.coalesce(F.when(F.col("conf") != 0, F.col("conf")), F.lit(0.9)) if "conf" in landmarks.columns else F.lit(0.9)
    rest = [c for c in landmarks.columns if c not in ("x", "y", "z", "conf")]
    return landmarks.select(*rest, (F.col("x") * width).alias("x"), (F.col("y") * height).alias("y"), F.col("x").alias("x3"), F.col("y").alias("y3"), F.col("z").alias("z3"), seen.alias("conf"))


def hand_frames(landmarks: DataFrame, interpolated: bool = False) -> DataFrame:
    """One row for each hand and frame: its landmarks in order as lists of points, 3-D ones if there are columns x3, y3, z3 (else null), their
    confidences, the mean of these, and whether the hand was detected and not interpolated."""
    there = {"x3", "y3", "z3"} <= set(landmarks.columns)
    three = F.array("x3", "y3", "z3") if there else F.lit(None).cast("array<double>")
    point = F.struct("landmark", F.array("x", "y").alias("two"), three.alias("three"), "conf")
    rows = landmarks.groupBy("video_id", "frame_idx", F.col("side").alias("handedness")).agg(F.array_sort(F.collect_list(point)).alias("p"), F.avg("conf").alias("overall_confidence"))

    def each(c: str) -> Column:
        return F.transform("p", lambda s: s[c])

    solid = each("three") if there else F.lit(None).cast("array<array<double>>")
    return rows.select(
        "video_id", "frame_idx", "handedness", each("two").alias("landmarks_2d"), solid.alias("landmarks_3d"), each("conf").alias("conf"), "overall_confidence", F.lit(not interpolated).alias("is_detected")
    )
