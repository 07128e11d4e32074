"""Recording live: commands and frames as a stream, a sink that holds each take once, and the rates of a running query."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from taskloom.functions.temporal import over
from taskloom.streaming.live import KEEP, InOrder, lived

FOUND = "video_id long, kind string, take long, position long, frame_idx long, action string, object_id long, frame_start long, frame_end long"
NAMES = [c.split()[0] for c in FOUND.split(", ")]


class Recorder(InOrder):
    """Which frames of a recording are taken, and the actions annotated meanwhile."""

    held = "running boolean, take long, n long, action string, object_id long, since long"

    def __init__(self, on: bool, keep: int):
        kinds = {"t": "double", "seq": "long", "command": "string", "action": "string", "object_id": "long"}
        super().__init__(list(kinds), kinds, NAMES, keep)
        self.on = on

    def taken(self, key: tuple, rows: list[dict], held: list[tuple]) -> Generator[tuple, None, list[tuple]]:
        running, take, n, action, thing, since = held[0] if held else (self.on, 0, 0, None, None, None)

        def closed() -> Iterator[tuple]:
            if since is not None:
                yield key[0], "action", take, None, None, action, thing, since, n

        for r in sorted(rows, key=lambda r: (r["t"], r["command"] is not None, r["seq"])):
            command = r["command"]
            if r["fresh"]:
                yield from closed()
                running, take, n, action, thing, since = self.on, 0, 0, None, None, None
            if command is None:
                if running:
                    yield key[0], "frame", take, n, r["seq"], None, None, None, None
                    n += 1
            elif command in ("record", "stop"):
                running = command == "record"
            elif command in ("start", "end", "save", "clear"):
                yield from closed()
                action, thing, since = (r["action"], r["object_id"], n) if command == "start" else (None, None, None)
                if command == "clear":
                    take, n = take + 1, 0
        return [(running, take, n, action, thing, since)]


def live_recorder(rows: DataFrame, on: bool = True, keep: int = KEEP) -> DataFrame:
    """What is recorded of a stream of frames and commands (video_id, t, seq, command, action, object_id; a frame has a null command and its number as seq) with an event time: rows of
    kind ``frame`` (take, position, frame_idx) and of kind ``action`` (take, action, object_id, frame_start, frame_end), the latter when the action ends by a ``start``,
    ``end``, ``save`` or ``clear``.  As ``recorder.recorded`` and ``recorder.annotated``, but that an action still going on at the end of the input isn't given."""
    return lived(rows, Recorder(on, keep), FOUND)


def takes_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes a batch to a folder of its number, by take.  A batch that is run again, as after a failure, replaces its own folder, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("take").parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def taken(spark: SparkSession, path: str, schema: StructType, last: bool = True) -> DataFrame:
    """What a sink holds, in a column ``batch`` the number of the batch; by default only the last take of each recording, which is what a save keeps."""
    kept = StructType([f for f in schema if f.name != "take"]).add("take", "long").add("batch", "long")
    rows = spark.read.schema(kept).parquet(path)
    if not last:
        return rows
    newest = rows.groupBy("video_id").agg(F.max("take").alias("take"))
    return rows.join(newest, ["video_id", "take"])


def metered(rows: DataFrame, name: str = "frames") -> DataFrame:
    """Rows are counted as they pass, under ``name``, into the query's progress."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.max("t").alias("upto"))


class Meter(StreamingQueryListener):
    """The rate of each running query: nine parts of the rate before and one of what the last batch made, in rows a second; and the rows counted by ``metered``."""

    def __init__(self, name: str = "frames"):
        self.name, self.rates, self.rows = name, {}, {}

    def onQueryStarted(self, event: Any) -> None:
        self.rates.setdefault(str(event.id), 0.0)

    def onQueryProgress(self, event: Any) -> None:
        p, key = event.progress, str(event.progress.id)
        seconds = p.durationMs.get("triggerExecution", 0) / 1000
        if p.numInputRows:
            self.rates[key] = metre(self.rates.get(key, 0.0), p.numInputRows, seconds)
        seen = p.observedMetrics.get(self.name)
        if seen is not None:
            self.rows[key] = self.rows.get(key, 0) + (seen["rows"] or 0)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


def metre(before: float, rows: int, seconds: float) -> float:
    return 0.9 * before + 0.1 * rows / max(seconds, 0.001)


def metred(frames: DataFrame) -> DataFrame:
    """The same meter over the times of frames: ``rate`` after each frame, from the steps between them.  The closed form of the recurrence, as a sum over
    all earlier steps, weighed by powers of 0.9; powers are scaled within spans of 512 frames, so none vanishes."""
    step = F.col("t") - F.lag("t").over(over(["video_id"]))
    step = F.when(step.isNotNull(), F.greatest(step, F.lit(0.001)))
    rows = frames.select("video_id", "frame_idx", "t", (F.row_number().over(over(["video_id"])) - 1).alias("i"), (1 / step).alias("now"))
    rows = rows.withColumn("span", F.floor(F.col("i") / 512)).withColumn("at", F.col("i") % 512)
    inside = F.sum(F.coalesce("now", F.lit(0.0)) * 0.1 * F.pow(F.lit(0.9), -F.col("at").cast("double"))).over(over(["video_id", "span"], "at"))
    rows = rows.withColumn("own", inside * F.pow(F.lit(0.9), F.col("at").cast("double")))
    ends = rows.groupBy("video_id", "span").agg(F.max_by("own", "at").alias("end"), F.max("at").alias("last"))
    # what a full span of 512 leaves of the rate before it is 0.9^512, some 10^-24: the span before suffices, and its own start is the same small part
    before = ends.select("video_id", (F.col("span") + 1).alias("span"), F.col("end").alias("carried"))
    rows = rows.join(before, ["video_id", "span"], "left")
    rate = F.col("own") + F.coalesce("carried", F.lit(0.0)) * F.pow(F.lit(0.9), F.col("at").cast("double") + 1)
    return rows.select("video_id", "frame_idx", rate.alias("rate"))
