"""A streaming source of frames as they fall due: the loop of a live recorder, without the camera.

Each recording runs at its own rate from a given instant; a batch holds the frames that fell due since the one before, a partition for each recording.  Offsets are counts of
frames and follow from the clock alone, so a restarted query goes on at the frame after the last committed one, and nothing is lost or read twice.

    spark.dataSource.register(FrameTicks)
    spark.readStream.format("frame_ticks").option("recordings", '[[1, 900, 30.0]]').option("begin", time.time()).load()

Options: ``recordings`` is a JSON list of [video_id, num_frames, fps], ``begin`` the instant of the first frame in seconds, ``speed`` how many times faster than the clock it goes (1).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Span(InputPartition):
    def __init__(self, video: int, first: int, last: int, fps: float):
        self.video, self.first, self.last, self.fps = video, first, last, fps


class FrameTicks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_ticks"

    def schema(self) -> str:
        return "video_id long, frame_idx long, t double"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Ticks(self.options)


class Ticks(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.recordings = [(int(v), int(n), float(fps)) for v, n, fps in json.loads(options["recordings"])]
        self.begin, self.speed = float(options["begin"]), float(options.get("speed", "1"))
        if any(fps <= 0 for _, _, fps in self.recordings) or self.speed <= 0:
            raise ValueError("rates must be above 0")

    def due(self, now: float) -> dict[str, int]:
        """Frames of each recording whose time has come; frame i comes at i / fps."""
        passed = (now - self.begin) * self.speed
        return {str(v): 0 if passed < 0 else min(n, int(passed * fps) + 1) for v, n, fps in self.recordings}

    def initialOffset(self) -> dict[str, int]:
        return {str(v): 0 for v, _, _ in self.recordings}

    def latestOffset(self) -> dict[str, int]:
        return self.due(time.time())

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> Sequence[InputPartition]:
        spans = ((v, start.get(str(v), 0), end.get(str(v), 0), fps) for v, _, fps in self.recordings)
        return [Span(*s) for s in spans if s[2] > s[1]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(partition.first, partition.last):
            yield partition.video, i, i / partition.fps

    def commit(self, end: dict[str, int]) -> None:
        pass
