"""Actions: boundaries, segments, their refinement and labels."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.temporal import batched, folded, meeting, over, records
from taskloom.operators.states import changes

#: Trigger and confidence of a change of each dimension, and the names of its evidence.
TRIGGERS = {"motion_state": (1, 0.7), "support_relation": (2, 0.8), "containment": (3, 0.85)}
SHORT = {"motion_state": "state", "support_relation": "support", "containment": "containment"}
#: What speaks for a boundary or a segment; each has the fields that apply and null in the others.
EVIDENCE = {
    "event_id": "long", "label": "string", "hand": "string", "object_id": "long", "prev_state": "string", "curr_state": "string", "prev_support": "string", "curr_support": "string",
    "prev_containment": "string", "curr_containment": "string", "trigger": "string", "pre_first_boundary": "boolean", "no_boundaries": "boolean", "merged_with": "long",
    "merged_for_limit": "boolean", "num_events": "long", "state_changes": "array<string>", "rule_matched": "string",
}
EVIDENCE_TYPE = "struct<" + ",".join(f"{n}:{k}" for n, k in EVIDENCE.items()) + ">"


def evidence(before: Column | None = None, **given: Column) -> Column:
    """The fields given, and of the others what was there before."""
    rest = lambda n: F.lit(None) if before is None else before[n]
    return F.struct(*(given.get(n, rest(n)).cast(k).alias(n) for n, k in EVIDENCE.items()))


def contact_boundaries(events: DataFrame) -> DataFrame:
    """A boundary where each event begins and one after it ends."""
    def of(name: str, at, k: int):
        return F.struct(F.lit(name).alias("trigger"), at.alias("frame_idx"), F.lit(k).alias("k"))

    both = F.explode(F.array(of("contact_onset", F.col("frame_start"), 0), of("contact_offset", F.col("frame_end") + 1, 1)))
    seen = evidence(**{c: F.col(c) for c in ("event_id", "label", "hand") if c in events.columns})
    rows = events.select("video_id", "event_id", "object_id", "confidence", seen.alias("evidence"), both.alias("b"))
    return rows.select("video_id", "b.frame_idx", "b.trigger", F.array("object_id").alias("objects"), "confidence", F.lit(0).alias("rank"), (F.col("event_id") * 2 + F.col("b.k")).alias("seq"), "evidence")


def state_boundaries(states: DataFrame, dimensions: tuple[str, ...] = tuple(TRIGGERS)) -> DataFrame:
    """A boundary at each change of motion, support or containment."""
    found = changes(states, list(dimensions))
    of = F.col("dimension")
    name = F.when(of == "motion_state", F.when(F.col("to") == "moving", "motion_start").otherwise("motion_stop")).when(of == "support_relation", "support_change").otherwise("containment_change")
    rank, conf = F.lit(0), F.lit(0.0)
    for d, (r, c) in TRIGGERS.items():
        rank, conf = F.when(of == d, r).otherwise(rank), F.when(of == d, c).otherwise(conf)
    seen = {f"{when}_{short}": F.when(of == d, F.col(c)) for d, short in SHORT.items() for when, c in (("prev", "from"), ("curr", "to"))}
    return found.select("video_id", "frame_idx", name.alias("trigger"), F.array("object_id").alias("objects"), conf.alias("confidence"), rank.alias("rank"), F.col("object_id").alias("seq"), evidence(object_id=F.col("object_id"), **seen).alias("evidence"))


def merged_boundaries(*found: DataFrame) -> DataFrame:
    """One boundary a frame: the first trigger, the highest confidence, all objects, and of each field of evidence the last value."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # the few boundaries of a frame in order, as a list
    rows = every.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("rank", "seq", "trigger", "confidence", "objects", "evidence"))).alias("s"))
    last = F.struct(*(F.try_element_at(F.array_compact(F.col(f"s.evidence.{n}")), F.lit(-1)).alias(n) for n in EVIDENCE))
    objects = F.array_sort(F.array_distinct(F.flatten(F.col("s.objects"))))
    return rows.select("video_id", "frame_idx", F.col("s")[0]["trigger"].alias("trigger"), F.array_max("s.confidence").alias("confidence"), objects.alias("objects"), last.alias("evidence"))


def refined_boundaries(boundaries: DataFrame, least: int = 3) -> DataFrame:
    """Boundaries nearer than ``least`` frames to the last one kept: the surer of the two stays.  A video's boundaries are folded in order."""

    columns = ["video_id", "frame_idx", "trigger", "confidence"]

    def thin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stay() -> Iterator[tuple]:
            last = None
            for part in parts:
                for r in records(part):
                    if last is None or r.frame_idx - last.frame_idx >= least:
                        if last is not None:
                            yield last
                        last = r
                    elif r.confidence > last.confidence:
                        last = r
            yield last

        yield from batched(stay(), columns)

    rows = boundaries.select(*columns)
    return folded(rows, ["video_id"], ["frame_idx"], thin, "video_id long, frame_idx long, trigger string, confidence double")


def segments(boundaries: DataFrame, totals: DataFrame, shortest: int = 10) -> DataFrame:
    """Segments between boundaries, and the one before the first; ``totals`` has video_id and num_frames.  Those too short go, except the first;
    a video without boundaries is one segment."""
    if "evidence" not in boundaries.columns:
        boundaries = boundaries.withColumn("evidence", evidence())
    rows = boundaries.join(totals, "video_id").where("frame_idx < num_frames")
    w = over(["video_id"])
    cut = rows.withColumn("frame_end", F.coalesce(F.lead("frame_idx").over(w) - 1, F.col("num_frames") - 1)).where(F.col("frame_end") - F.col("frame_idx") + 1 >= shortest)
    none = F.array().cast("array<long>")
    cut = cut.select("video_id", F.col("frame_idx").alias("frame_start"), "frame_end", "confidence", "objects", "trigger", evidence(F.col("evidence"), trigger=F.col("trigger")).alias("evidence"))
    first = totals.join(boundaries.groupBy("video_id").agg(F.min("frame_idx").alias("f")), "video_id", "left")
    alone = F.col("f").isNull() | (F.col("f") >= F.col("num_frames"))
    first = first.select("video_id", F.lit(0).cast("long").alias("frame_start"), (F.when(alone, F.col("num_frames")).otherwise(F.col("f")) - 1).alias("frame_end"), alone.alias("alone")).where("frame_end >= 0")
    seen = evidence(pre_first_boundary=F.when(~F.col("alone"), True), no_boundaries=F.when(F.col("alone"), True))
    trigger = F.when(F.col("alone"), "no_boundaries").otherwise("video_start")
    plain = first.select("video_id", "frame_start", "frame_end", F.lit(0.5).alias("confidence"), none.alias("objects"), trigger.alias("trigger"), seen.alias("evidence"))
    return cut.unionByName(plain).withColumn("seg_id", (F.row_number().over(over(["video_id"], "frame_start")) - 1).cast("long"))


def timed(segment: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds t_start and t_end from the frames."""
    for c in ("start", "end"):
        segment = segment.join(frames.select("video_id", F.col("frame_idx").alias(f"frame_{c}"), F.col("t").alias(f"t_{c}")), ["video_id", f"frame_{c}"], "left")
    return segment


def long_enough(segment: DataFrame, shortest: int = 10) -> DataFrame:
    return segment.where(F.col("frame_end") - F.col("frame_start") + 1 >= shortest)


SEGMENT = f"video_id long, seg_id long, frame_start long, frame_end long, confidence double, label string, objects array<long>, evidence {EVIDENCE_TYPE}"
NAMES = ["video_id", "seg_id", "frame_start", "frame_end", "confidence", "label", "objects", "evidence"]


def rewritten(segment: DataFrame, step: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """A video's segments in order, changed by ``step`` and numbered anew."""
    rows = segment.withColumn("label", F.lit("unknown")) if "label" not in segment.columns else segment
    rows = rows.withColumn("evidence", evidence()) if "evidence" not in rows.columns else rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[dict]:
            for part in parts:
                for r in records(part):
                    yield dict(r._asdict(), objects=sorted({int(o) for o in r.objects}))

        yield from batched((tuple(dict(r, seg_id=i)[n] for n in NAMES) for i, r in enumerate(step(each()))), NAMES)

    return folded(rows.select(*NAMES), ["video_id"], ["seg_id"], run, SEGMENT)


def _joined(a: dict, b: dict, label: str, seen: dict, **more) -> dict:
    return dict(a, frame_end=b["frame_end"], confidence=(a["confidence"] + b["confidence"]) / 2, label=label, objects=sorted({*a["objects"], *b["objects"]}), evidence=dict(seen, **more))


def merged_short(segment: DataFrame, shortest: int = 5) -> DataFrame:
    """Segments shorter than that join the one before, or the first one the next.  Only the last segment is held."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        held, fresh = next(rows), True  # fresh: a short first segment that waits for the next
        for row in rows:
            is_short = lambda r: r["frame_end"] - r["frame_start"] + 1 < shortest
            if fresh and is_short(held):
                held = _joined(held, row, row["label"], row["evidence"], merged_with=held["seg_id"])
            elif is_short(row):
                held = _joined(held, row, held["label"], held["evidence"], merged_with=row["seg_id"])
            else:
                yield held
                held = row
            fresh = False
        yield held

    return rewritten(segment, step)


def limited(segment: DataFrame, most: int) -> DataFrame:
    """At most that many segments: the least sure joins its less sure neighbour, again and again.  A recording's segments are linked to their neighbours and
    wait in a heap by confidence, so each union takes the time of a heap's step."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        held = dict(enumerate(rows))
        before, after = {i: i - 1 for i in held}, {i: i + 1 for i in held}
        heap = [(r["confidence"], i) for i, r in held.items()]
        heapq.heapify(heap)
        while len(held) > max(most, 1):
            sure, i = heapq.heappop(heap)
            if i not in held or held[i]["confidence"] != sure:
                continue  # joined meanwhile
            left, right = held.get(before[i]), held.get(after[i])
            a = before[i] if left and (not right or left["confidence"] < right["confidence"]) else i
            b = after[a]
            x, y = held[a], held.pop(b)
            held[a] = _joined(x, y, x["label"] if x["confidence"] > y["confidence"] else y["label"], x["evidence"], merged_for_limit=True)
            after[a] = after[b]
            before[after[b]] = a
            heapq.heappush(heap, (held[a]["confidence"], a))
        yield from held.values()

    return rewritten(segment, step)


def closed(segment: DataFrame) -> DataFrame:
    """Gaps and overlaps between neighbours closed at their middle.  A moved end is timed at 30 frames a second from the segment's own
    start, which the next segment's start then takes; these times chain from left to right."""
    w = over(["video_id"], "frame_start")
    ahead = F.lead("frame_start").over(w)
    rows = segment.withColumn("mid", F.when(ahead - F.col("frame_end") - 1 != 0, F.floor((F.col("frame_end") + ahead) / 2).cast("long")))
    rows = rows.withColumn("before", F.lag("mid").over(w))
    rows = rows.withColumn("frame_start", F.coalesce(F.col("before") + 1, F.col("frame_start"))).withColumn("frame_end", F.coalesce("mid", "frame_end"))
    # a run is a segment with its own start and those behind it whose starts are the ends before
    run = F.count(F.when(F.col("before").isNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run)
    chain = over(["video_id", "run"], "frame_start")
    length = (F.col("mid") - F.col("frame_start")) / 30.0
    start = F.first("t_start").over(chain) + F.coalesce(F.sum(length).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("t_start", start).withColumn("t_end", F.when(F.col("mid").isNotNull(), start + length).otherwise(F.col("t_end")))
    more = [c for c in ("evidence",) if c in segment.columns]
    return rows.select("video_id", "seg_id", "frame_start", "frame_end", "confidence", "objects", "t_start", "t_end", *more)


#: In the order in which changes are listed.
ORDER = ["support_relation", "motion_state", "containment", "interaction_state"]


def events_in(segment: DataFrame, events: DataFrame) -> DataFrame:
    """Events that overlap each segment."""
    e = events.select("video_id", "event_id", F.col("label").alias("event_label"), F.col("frame_start").alias("e_start"), F.col("frame_end").alias("e_end"))
    each = segment.select("video_id", "seg_id", "frame_start", "frame_end")
    return meeting(each, e, ["video_id"], ("frame_start", "frame_end"), ("e_start", "e_end")).select("video_id", "seg_id", "event_id", "event_label")


def changes_in(segment: DataFrame, states: DataFrame) -> DataFrame:
    """State changes of a segment's objects between its first and last frame."""
    dims = ORDER
    each = segment.select("video_id", "seg_id", "frame_start", "frame_end", F.explode("objects").alias("object_id"))
    for e in ("start", "end"):
        each = each.join(states.select("video_id", "object_id", F.col("frame_idx").alias(f"frame_{e}"), F.struct(*dims).alias(e)), ["video_id", "object_id", f"frame_{e}"])
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"start.{d}").alias("from"), F.col(f"end.{d}").alias("to")) for d in dims)))
    return each.select("video_id", "seg_id", "object_id", rows.alias("c")).where("c.from <> c.to").select("video_id", "seg_id", "object_id", "c.*")


def labelled(segment: DataFrame, events: DataFrame, states: DataFrame) -> DataFrame:
    """Adds ``label`` and ``label_confidence`` by the first rule that holds, and to the evidence the number of events, the state changes as texts and the rule."""
    seen = events_in(segment, events).groupBy("video_id", "seg_id").agg(F.count(F.lit(1)).alias("num_events"), F.collect_set("event_label").alias("e"))
    found = changes_in(segment, states).groupBy("video_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("object_id", F.array_position(F.array(*map(F.lit, ORDER)), F.col("dimension")).alias("at"), "dimension", "from", "to"))).alias("c"))
    rows = segment.join(seen, ["video_id", "seg_id"], "left").join(found, ["video_id", "seg_id"], "left")
    rows = rows.withColumn("num_events", F.coalesce("num_events", F.lit(0))).withColumn("e", F.coalesce("e", F.array().cast("array<string>")))
    rows = rows.withColumn("c", F.coalesce("c", F.array().cast(found.schema["c"].dataType)))

    def event(name: str):
        return F.array_contains("e", name)

    def change(dimension: str, start: tuple[str, ...] = (), end: tuple[str, ...] = ()):
        def is_one(x):
            out = x["dimension"] == dimension
            out = out & x["from"].isin(*start) if start else out
            return out & x["to"].isin(*end) if end else out

        return F.exists("c", is_one)

    into = ("in_bin", "in_box")
    any_event, any_change = F.col("num_events") > 0, F.size("c") > 0
    rules = [
        (event("grasp") & change("support_relation", ("table", "fixture", "unknown"), ("hand",)), "pick", 0.9),
        (event("grasp") & change("support_relation", ("hand",), ("table", "fixture")), "place", 0.9),
        (change("containment", (), into), "insert", 0.85),
        (change("containment", into, ("none",)), "remove", 0.85),
        (event("push"), "push", 0.7),
        (event("pull"), "pull", 0.7),
        (event("touch") & ~any_change, "inspect", 0.6),
        (change("motion_state", (), ("moving",)) & ~any_event, "reach", 0.5),
        (change("motion_state", (), ("static",)) & any_event, "retract", 0.5),
        (event("grasp") & change("motion_state") & ~change("support_relation"), "manipulate", 0.6),
        (~any_event & ~any_change, "idle", 0.8),
        (any_event, "manipulate", 0.4),
    ]
    out = F.struct(F.lit("unknown").alias("label"), F.lit(0.3).alias("label_confidence"))
    for when, label, conf in reversed(rules):
        out = F.when(when, F.struct(F.lit(label).alias("label"), F.lit(conf).alias("label_confidence"))).otherwise(out)
    rows = rows.withColumn("o", out).withColumn("num_changes", F.size("c"))
    text = F.transform("c", lambda x: F.format_string("{'object_id': %d, 'type': '%s', 'from': '%s', 'to': '%s'}", x["object_id"], x["dimension"], x["from"], x["to"]))
    before = F.col("evidence") if "evidence" in segment.columns else None
    seen = evidence(before, num_events=F.col("num_events"), state_changes=text, rule_matched=F.col("o.label"))
    return rows.select(*(c for c in segment.columns if c not in ("evidence", "label")), "num_events", "num_changes", "o.label", "o.label_confidence", seen.alias("evidence"))


def current(frames: DataFrame, segment: DataFrame) -> DataFrame:
    """The first segment that holds each frame."""
    s = segment.select("video_id", "seg_id", "frame_start", "frame_end")
    held = meeting(frames.select("video_id", "frame_idx"), s, ["video_id"], ("frame_idx", "frame_idx"), ("frame_start", "frame_end"))
    return held.groupBy("video_id", "frame_idx").agg(F.min("seg_id").alias("seg_id"))
