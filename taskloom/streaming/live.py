"""Live recordings: trackers, contacts, held poses and windowed counts as Structured Streaming queries.

State is kept for each recording or hand of it, as rows of typed lists of ``transformWithStateInPandas``; recordings whose numbers follow each other share a key, so that a batch calls the store once
for many of them.  Rows that wait are held as Arrow batches, since Spark converts what is held value by value.  Rows that arrive out of order wait until the watermark has passed them and are then taken in order of their
frames; rows later than the watermark are dropped by Spark and counted in the query's progress as ``numRowsDroppedByWatermark``.  A key, or a joint or pair of it, without rows for ``keep`` (a day) of event time
is forgotten, and its next row is as a first one.  Where the input has a column ``reset``, a row with it set clears the state of its key, joint or pair before its frame, and is nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Generator, Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from taskloom.functions.lineage import shared_dir
from taskloom.functions.temporal import turns
from taskloom.operators.objects import BOX, Tracker

#: 1 January 2000, in seconds.
EPOCH = 946_684_800
#: How long a key without rows is kept, in milliseconds of event time.
KEEP = 24 * 3_600_000
#: How many recordings, of numbers that follow each other, share a key of the live queries.
TOGETHER = 64
STORE, PARTS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stamped(rows: DataFrame, seconds: str = "t", delay: str = "10 seconds") -> DataFrame:
    """Adds an event time from seconds since the recording's start, with a watermark.  They are counted from ``EPOCH``: the first
    watermark is 1970, and rows of that instant would come too late."""
    return rows.withColumn("ts", F.timestamp_micros(((F.col(seconds) + EPOCH) * 1_000_000).cast("long"))).withWatermark("ts", delay)


def resets(rows: DataFrame) -> list[str]:
    return ["reset"] if "reset" in rows.columns else []


#: Arrow's types of those that rows which wait can have.
ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def unpacked(part: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(part)).read_all()


def listed(column: pa.ChunkedArray) -> list:
    """The values, None where they are missing; numbers without gaps go through numpy, which is faster."""
    simple = not column.null_count and not pa.types.is_string(column.type)
    return column.to_numpy().tolist() if simple else column.to_pylist()


class InOrder(StatefulProcessor):
    """Takes rows in order of their frames, once the watermark has passed them.  A state is that of ``TOGETHER`` recordings, as each key costs calls to the store and a frame of pandas in every batch;
    within it each recording (or hand of it: ``keys``) is on its own.  Rows wait as Arrow batches, one for each batch of the query.  A subclass says what is held of a key as rows (``held``), and what it gives for
    a run of frames and holds then (``taken``)."""

    keys = ["video_id"]
    #: Schema of the rows that are held of a key.
    held: str

    def __init__(self, columns: list[str], kinds: dict[str, str], names: list[str], keep: int = KEEP):
        kinds = {"video_id": "long", "side": "string"} | kinds
        self.columns, self.names, self.keep = columns, names, keep
        self.given = [*self.keys, *columns]
        self.schema = pa.schema([("ts", pa.int64()), *((c, ARROW[kinds[c]]) for c in self.given)])
        self.key = ", ".join(f"{c} {kinds[c]}" for c in self.keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.seen = handle.getListState("seen", f"{self.key}, taken long")  # the time of the last row taken of each key
        self.state = handle.getListState("state", f"{self.key}, {self.held}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                at = frame["ts"].astype("datetime64[ms]").astype("int64")
                self.waiting.appendValue((packed(pa.Table.from_pandas(frame[self.given].assign(ts=at), self.schema, preserve_index=False)),))
                first = int(at.min()) if first is None else min(first, int(at.min()))
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = pa.concat_tables([self.schema.empty_table(), *(unpacked(part) for (part,) in self.waiting.get())])
        waits = pc.greater(rows["ts"], mark)
        rest, now = rows.filter(waits), rows.filter(pc.invert(waits))
        n = len(self.keys)
        seen = {tuple(r)[:n]: tuple(r)[n] for r in self.seen.get()}
        ready, later = self.there(now), self.there(rest)
        gone = {k for k, at in seen.items() if at + self.keep <= mark and k not in ready and k not in later}
        if not ready and not gone:
            return
        for k in gone:
            del seen[k]
        out = self.moved(now, gone, seen)
        self.put(self.waiting, [(packed(rest),)] if len(rest) else [])
        self.put(self.seen, [(*k, at) for k, at in seen.items()])
        for at in ([pc.min(rest["ts"]).as_py()] if len(rest) else []) + ([min(seen.values()) + self.keep] if seen else []):
            self.handle.registerTimer(max(at, mark) + 1)
        if len(out):
            yield out

    def there(self, rows: pa.Table) -> set[tuple]:
        found = rows.group_by(self.keys).aggregate([])
        return set(zip(*(listed(found[k]) for k in self.keys), strict=True))

    def moved(self, now: pa.Table, gone: set[tuple], seen: dict[tuple, int]) -> pd.DataFrame:
        """What the rows of ``now`` give; holds what is held of each key then, nothing of those in ``gone``, and puts the times of the rows into ``seen``."""
        n = len(self.keys)
        now = now.sort_by([(c, "ascending") for c in (*self.keys, self.columns[0], "ts")])
        ready = {k: list(mine) for k, mine in groupby(zip(*map(listed, now.columns), strict=True), key=lambda r: r[1 : n + 1])}
        held: dict[tuple, list[tuple]] = {}
        for r in map(tuple, self.state.get()):
            held.setdefault(r[:n], []).append(r[n:])
        for k in gone:
            held.pop(k, None)
        out: list[tuple] = []
        for k, mine in ready.items():
            taken, rows = seen.get(k), []
            for r in mine:  # a key is as new after a long silence, whether its timer came first or the next row
                rows.append(dict(zip(self.columns, r[n + 1 :], strict=True), ts=r[0], fresh=taken is not None and r[0] - taken > self.keep))
                taken = max(r[0], taken or r[0])
            seen[k] = taken
            held[k] = self.run(k, rows, held.get(k, []), out)
        self.put(self.state, [(*k, *r) for k, rows in held.items() for r in rows])
        return pd.DataFrame(out, columns=self.names)

    def run(self, key: tuple, rows: list[dict], held: list[tuple], out: list[tuple]) -> list[tuple]:
        """Adds to ``out`` what a key's rows give; returns what is held of it then."""
        steps = self.taken(key, rows, held)
        while True:
            try:
                out.append(next(steps))
            except StopIteration as end:
                return end.value

    @staticmethod
    def put(state: Any, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass

    def by_frame(self, rows: list[dict]) -> Iterator[tuple[int, bool, list[dict]]]:
        """Frames in order, whether the state is cleared before them, and their rows."""
        for frame, group in groupby(rows, key=lambda r: r["frame_idx"]):
            every = list(group)
            yield int(frame), any(r.get("reset") or r["fresh"] for r in every), [r for r in every if not r.get("reset")]

    def by_part(self, rows: list[dict], names: list[str], seen: dict[tuple, int]) -> Iterator[tuple[tuple, list[dict]]]:
        """The rows of each part of a key, such as a joint of a recording, in order.  A silence is the part's own: ``seen`` has the time of the last row of each."""
        parts = {}
        for r in rows:
            part = tuple(r[c] for c in names)
            last = seen.get(part)
            parts.setdefault(part, []).append(dict(r, fresh=last is not None and r["ts"] - last > self.keep))
            seen[part] = max(r["ts"], last or r["ts"])
        yield from parts.items()

    def taken(self, key: tuple, rows: list[dict], held: list[tuple]) -> Generator[tuple, None, list[tuple]]:
        raise NotImplementedError


def lived(rows: DataFrame, processor: InOrder, schema: str) -> DataFrame:
    return rows.withColumn("part_", F.expr(f"video_id div {TOGETHER}")).groupBy("part_").transformWithStateInPandas(processor, schema, "Append", "EventTime")


class Contacts(InOrder):
    """Hysteresis of a recording's hands and objects."""

    held = "hand string, object_id long, active boolean, close int, away int, seen long"

    def __init__(self, marks: list[str], threshold: float, on: int, off: int, keep: int):
        kinds = {"frame_idx": "long", "hand": "string", "object_id": "long", "distance": "double", "reset": "boolean"}
        super().__init__(["frame_idx", "hand", "object_id", "distance", *marks], kinds, ["video_id", "hand", "object_id", "frame_idx", "is_contact"], keep)
        self.threshold, self.on, self.off = threshold, on, off

    def taken(self, key: tuple, rows: list[dict], held: list[tuple]) -> Generator[tuple, None, list[tuple]]:
        states, seen = {r[:2]: r[2:5] for r in held}, {r[:2]: r[5] for r in held}
        for pair, mine in self.by_part(rows, ["hand", "object_id"], seen):
            active, close, away = states.get(pair, (False, 0, 0))
            for frame, cleared, found in self.by_frame(mine):
                if cleared:
                    active, close, away = False, 0, 0
                for r in found:
                    close, away = (close + 1, 0) if r["distance"] < self.threshold else (0, away + 1)
                    active = True if close >= self.on else False if away >= self.off else active
                    yield key[0], *pair, frame, active
            states[pair] = active, close, away
        latest = max(seen.values())  # a pair that was silent for longer is as a new one
        return [(*pair, *state, seen[pair]) for pair, state in states.items() if latest - seen[pair] <= self.keep]


def live_contacts(near: DataFrame, threshold: float = 50.0, on: int = 2, off: int = 3, keep: int = KEEP) -> DataFrame:
    """``video_id, hand, object_id, frame_idx, is_contact`` of a stream of distances with an event time."""
    return lived(near, Contacts(resets(near), threshold, on, off, keep), "video_id long, hand string, object_id long, frame_idx long, is_contact boolean")


class Tracks(InOrder):
    """The tracker of a recording: its next number, and its tracks."""

    held = "next int, id int, class_name string, x1 double, y1 double, x2 double, y2 double, seen long, age int"

    def __init__(self, marks: list[str], least: float, max_age: int, min_hits: int, keep: int):
        kinds = {"frame_idx": "long", "det_idx": "long", "class_name": "string", "conf": "double", "reset": "boolean"} | dict.fromkeys(BOX, "double")
        super().__init__(["frame_idx", "det_idx", "class_name", "conf", *BOX, *marks], kinds, ["video_id", "track_id", "frame_idx", "det_idx"], keep)
        self.settings = (least, max_age, min_hits)

    def taken(self, key: tuple, rows: list[dict], held: list[tuple]) -> Generator[tuple, None, list[tuple]]:
        tracker = Tracker(*self.settings)
        for next_, i, name, *box, seen, age in held:
            tracker.next = next_
            if i is not None:
                tracker.tracks[i] = [name, tuple(box), seen, age]
        for frame, cleared, found in self.by_frame(rows):
            if cleared:
                tracker = Tracker(*self.settings)
            if found or not cleared:
                there = sorted((int(r["det_idx"]), r["class_name"], r["conf"], tuple(r[c] for c in BOX)) for r in found if r["det_idx"] is not None)
                for track, d in tracker.update(frame, [h[1:] for h in there]):
                    yield key[0], track, frame, there[d][0]
        tracks = [(tracker.next, i, name, *map(float, box), int(seen), int(age)) for i, (name, box, seen, age) in tracker.tracks.items()]
        return tracks or [(tracker.next, *[None] * 8)]


def live_tracks(detections: DataFrame, least: float = 0.3, max_age: int = 30, min_hits: int = 2, keep: int = KEEP) -> DataFrame:
    """``video_id, track_id, frame_idx, det_idx`` of a stream of detections with an event time; a frame without detections is a row with
    a null det_idx."""
    return lived(detections, Tracks(resets(detections), least, max_age, min_hits, keep), "video_id long, track_id long, frame_idx long, det_idx long")


class Fingers(InOrder):
    """What one hand touched and whether it grabbed in its last frames.  Of each object once touched, the first frame and the last ones of
    touch are held, as places in the order of the hand's frames; without an object there is what the hand did."""

    keys = ["video_id", "side"]
    held = "object_id long, first long, touches array<long>, seen long, grabs array<boolean>"

    def __init__(self, marks: list[str], last: int, keep: int):
        kinds = {"frame_idx": "long", "object_id": "long", "is_contact": "boolean", "is_grab": "boolean", "grab_confidence": "double", "reset": "boolean"}
        super().__init__(["frame_idx", "object_id", "is_contact", "is_grab", "grab_confidence", *marks], kinds, ["video_id", "side", "frame_idx", "object_id", "contact", "grabs", "grab_confidence"], keep)
        self.span = last

    def taken(self, key: tuple, rows: list[dict], held: list[tuple]) -> Generator[tuple, None, list[tuple]]:
        seen, grabs, objects = 0, [], {}
        for thing, first, touches, frames, grabbed in held:
            if thing is None:
                seen, grabs = frames, list(grabbed)
            else:
                objects[thing] = (first, list(touches))
        for frame, cleared, every in self.by_frame(rows):
            if cleared:
                seen, grabs, objects = 0, [], {}
            if cleared and not every:
                continue
            found, seen = [r for r in every if r["object_id"] is not None], seen + 1
            contact = {}
            for r in sorted(found, key=lambda r: r["object_id"]):
                thing = int(r["object_id"])
                if r["is_contact"]:
                    first, touches = objects.get(thing, (seen, []))
                    objects[thing] = (first, [*touches, seen][-self.span :])
                first, touches = objects.get(thing, (seen, []))
                recent = sum(i > seen - self.span for i in touches)
                contact[thing] = bool(r["is_contact"]) or recent > 0.4 * min(self.span, seen - first + 1)
            grab, sure = any(r["is_grab"] for r in found), max((r["grab_confidence"] for r in found), default=0.0)
            grabs = [*grabs, grab][-self.span :]
            holds = sum(grabs) > 0.5 * len(grabs)
            for thing, touches in contact.items():
                yield *key, frame, thing, touches, grab or holds, float(max(sure, 0.5) if holds else sure)
        return [(None, None, None, seen, grabs), *((thing, *touched, None, None) for thing, touched in objects.items())]


def live_fingertips(found: DataFrame, last: int = 5, keep: int = KEEP) -> DataFrame:
    """``video_id, side, frame_idx, object_id, contact, grabs, grab_confidence`` of a stream of what the fingertips touch (as ``contacts.fingertip_contacts``
    gives it) with an event time; a frame in which the hand meets no box is a row with a null object_id."""
    return lived(found, Fingers(resets(found), last, keep), "video_id long, side string, frame_idx long, object_id long, contact boolean, grabs boolean, grab_confidence double")


class Poses(InOrder):
    """The last rows of each joint of a recording: a ring for each.  All joints of a key are taken together, as columns, since their rows are many and each gives one; what is held is one Arrow batch."""

    held = "joint long, seen long, frame_idx long, x double, y double, conf double"
    told = "held array<struct<frame_idx:long,x:double,y:double,conf:double>>"

    def __init__(self, marks: list[str], last: int, keep: int):
        kinds = {"frame_idx": "long", "joint": "long", "x": "double", "y": "double", "conf": "double", "reset": "boolean"}
        super().__init__(["frame_idx", "joint", "x", "y", "conf", *marks], kinds, ["video_id", "joint", "frame_idx", *(c.split()[0] for c in self.told.split(", "))], keep)
        self.size = last
        self.ring = pa.schema([("ts", pa.int64()), *((c, self.schema.field(c).type) for c in ("video_id", "frame_idx", "joint", "x", "y", "conf"))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rings = handle.getListState("rings", "rows binary")  # as rows of the ring, with the time of the joint's last row as ts

    def moved(self, now: pa.Table, gone: set[tuple], seen: dict[tuple, int]) -> pd.DataFrame:
        old = pa.concat_tables([self.ring.empty_table(), *(unpacked(part) for (part,) in self.rings.get())])
        old = old.filter(pc.invert(pc.is_in(old["video_id"], pa.array([k for (k,) in gone], pa.int64()))))
        latest = now.group_by("video_id").aggregate([("ts", "max")])
        for k, at in zip(listed(latest["video_id"]), listed(latest["ts_max"]), strict=True):
            seen[(k,)] = max(at, seen.get((k,), at))
        rows, n = pa.concat_tables([old, now.select(self.ring.names)]), len(old)
        cleared = pc.fill_null(now["reset"], False).to_numpy() if "reset" in now.column_names else np.zeros(len(now), bool)
        code = lambda c: pc.dictionary_encode(rows[c].combine_chunks(), null_encoding="encode").indices.to_numpy()
        video, joint = code("video_id").astype(np.int64), code("joint").astype(np.int64)
        ts, frame = rows["ts"].to_numpy(), rows["frame_idx"].to_numpy()
        # what is held comes before the rows of its joint, in the order in which it is held
        place, fresh = np.concatenate([np.arange(n), frame[n:]]), np.arange(len(rows)) >= n
        order = np.lexsort((np.where(fresh, ts, 0), place, fresh, joint, video))
        rows, video, joint, ts, place, fresh = rows.take(pa.array(order)), video[order], joint[order], ts[order], place[order], fresh[order]
        reset = np.concatenate([np.zeros(n, bool), cleared])[order]
        first = turns([video, joint], len(order))
        part = np.cumsum(first) - 1
        upto = pd.Series(ts).groupby(part).cummax().to_numpy()
        silent = ~first & fresh & (ts - np.roll(upto, 1) > self.keep)  # a silence is the joint's own
        begin = np.flatnonzero(turns([part, fresh, place], len(order)))  # rows of one joint and frame: a reset or silence clears before all of them
        marked = begin[np.logical_or.reduceat(reset | silent, begin)] if len(begin) else begin
        anew = first.copy()
        anew[marked] = True
        age = np.cumsum(anew)
        ends = np.append(np.flatnonzero(first)[1:] - 1, len(order) - 1) if len(order) else np.zeros(0, int)
        age_at_end, seen_at_end = age[ends][part], upto[ends][part]
        stays = ~reset
        rows, age, part, fresh, age_at_end, at_end, video = rows.filter(pa.array(stays)), age[stays], part[stays], fresh[stays], age_at_end[stays], seen_at_end[stays], video[stays]
        at = np.arange(len(age))
        low = np.maximum(np.maximum.accumulate(np.where(turns([age], len(age)), at, 0)), at - self.size + 1)
        # of each joint the last rows since it was cleared; a joint that was silent for longer than the recording's others is as a new one
        left = np.searchsorted(part, part, "right") - at
        newest = pd.Series(at_end).groupby(video).transform("max").to_numpy()
        holds = (age == age_at_end) & (left <= self.size) & (newest - at_end <= self.keep)
        kept = rows.set_column(0, "ts", pa.array(at_end)).filter(pa.array(holds))
        self.put(self.rings, [(packed(kept),)] if len(kept) else [])
        return self.tells(rows, low, np.flatnonzero(fresh))

    def tells(self, rows: pa.Table, low: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        """What is given for the rows at ``at``, of each of which those from ``low`` on are held."""
        poses = rows.select(["frame_idx", "x", "y", "conf"]).to_pylist()
        return self.keyed(rows, at).assign(held=pd.Series([poses[a : b + 1] for a, b in zip(low[at].tolist(), at.tolist(), strict=True)], dtype=object))

    @staticmethod
    def keyed(rows: pa.Table, at: np.ndarray) -> pd.DataFrame:
        return rows.select(["video_id", "joint", "frame_idx"]).take(pa.array(at)).to_pandas(types_mapper=pd.ArrowDtype)


class HeldPoses(Poses):
    """What ``Poses`` holds, told in numbers."""

    told = "num_held long, oldest long, conf double"

    def tells(self, rows: pa.Table, low: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        conf, low = rows["conf"], low[at]
        missing = pc.is_null(conf).to_numpy()
        conf, total, unknown = pc.fill_null(conf, 0.0).to_numpy(), np.zeros(len(at)), np.zeros(len(at), bool)
        for back in range(self.size - 1, -1, -1):  # from the oldest on
            i = at - back
            inside = i >= low
            total[inside] += conf[i[inside]]
            unknown[inside] |= missing[i[inside]]
        oldest = rows["frame_idx"].to_numpy()[low]
        return self.keyed(rows, at).assign(num_held=at - low + 1, oldest=oldest, conf=pd.Series(pd.arrays.ArrowExtensionArray(pa.array(total, mask=unknown))))


def live_poses(joints: DataFrame, last: int = 30, keep: int = KEEP, numbers: bool = False) -> DataFrame:
    """``video_id, joint, frame_idx, held`` of a stream of joints with an event time: the last rows up to each, oldest first.  With ``numbers``, in place of the rows, how many
    they are, the frame of the oldest and the sum of their confidences (``num_held, oldest, conf``): each row is held thirty times over, and only these leave the state."""
    made = HeldPoses if numbers else Poses
    return lived(joints, made(resets(joints), last, keep), f"video_id long, joint long, frame_idx long, {made.told}")


def windowed_counts(events: DataFrame, size: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events of each type per tumbling or sliding window of their event time."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events less than the gap apart."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def started(writer: Any, spark: Any) -> Any:
    """The query, started with the state store that lists, maps and timers need and its state in at most twice as many parts as tasks can run at once: each part has a store to open and to commit
    and a Python worker in every batch.  The session's own settings stay, and a query that goes on keeps the number that it began with."""
    own = {STORE: ROCKS, PARTS: str(min(int(spark.conf.get(PARTS)), 2 * spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_to_end(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Everything that a stream over finished files gives, written as Parquet to the shared folder, with the query's checkpoint beside it.  Rows behind
    the last watermark are not given: end the input with a row that moves it past them.  With the ``path`` of an earlier run it goes on where that ended."""
    path = path or f"{shared_dir(stream.sparkSession)}/live-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True)
    started(writer, stream.sparkSession).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
