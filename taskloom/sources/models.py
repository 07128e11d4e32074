"""Models that read pixels or lift poses, run inside Spark tasks over batches of frames.

A model is made by a factory once for each Python worker, which keeps it for all its tasks of a query, with the options given (a factory must therefore be
importable or picklable), and is called with whole batches.  Factories can be registered under a name.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Factory = Callable[..., Any]
KINDS = ("detector", "pose", "lifter")
DETECTIONS = "video_id long, frame_idx long, det_idx long, class_name string, conf double, x1 double, y1 double, x2 double, y2 double"
PEOPLE = "video_id long, frame_idx long, person long, joint long, x double, y double, conf double"
LIFTED = "video_id long, frame_idx long, joint long, x3 double, y3 double, z3 double, conf3 double"

_FACTORIES: dict[tuple[str, str], Factory] = {}
#: The models of this worker, the last few used: by the name that the driver gave to the use of a factory.
_LOADED: OrderedDict[str, Any] = OrderedDict()
MOST = 3


def loaded(name: str, factory: Factory, options: dict) -> Any:
    if name not in _LOADED:
        _LOADED[name] = factory(**options)
    _LOADED.move_to_end(name)
    while len(_LOADED) > MOST:
        _LOADED.popitem(last=False)
    return _LOADED[name]


def register(kind: str, name: str, factory: Factory) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model: {kind}; there are {', '.join(KINDS)}")
    _FACTORIES[kind, name] = factory


def named(kind: str, name: str) -> Factory:
    """The factory registered under the name; an unknown name is a ValueError."""
    if (kind, name) not in _FACTORIES:
        have = sorted(n for k, n in _FACTORIES if k == kind)
        raise ValueError(f"unknown {kind}: {name}; there are {', '.join(have) or 'none'}")
    return _FACTORIES[kind, name]


def applied(frames: DataFrame, factory: Factory, options: dict, rows_of: Callable[[Any, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from taskloom.sources import models  # the worker's own module, and not a copy that travels with this function

        for batch in batches:
            yield pd.DataFrame(rows_of(models.loaded(name, factory, options), batch), columns=columns)

    return frames.mapInPandas(run, schema)


def detected(frames: DataFrame, factory: Factory, image: str = "image", **options) -> DataFrame:
    """Detections of ``frames`` (video_id, frame_idx and the column ``image``).  The model's ``detect_batch`` takes a list of images and gives for
    each a list of (class_name, conf, (x1, y1, x2, y2)); ``det_idx`` is the place in that list."""

    def rows_of(model: Any, batch: pd.DataFrame) -> list[tuple]:
        found = model.detect_batch(batch[image].tolist())
        return [(v, f, d, name, float(conf), *map(float, box)) for v, f, each in zip(batch["video_id"], batch["frame_idx"], found, strict=True) for d, (name, conf, box) in enumerate(each)]

    return applied(frames.select("video_id", "frame_idx", image), factory, options, rows_of, DETECTIONS)


def posed(frames: DataFrame, factory: Factory, image: str = "image", **options) -> DataFrame:
    """2-D joints of the people in ``frames``.  The model's ``estimate_batch`` takes a list of images and gives for each a list of people, a person
    being an array of (x, y, conf) by joint."""

    def rows_of(model: Any, batch: pd.DataFrame) -> list[tuple]:
        found = model.estimate_batch(batch[image].tolist())
        return [(v, f, p, j, *map(float, at)) for v, f, people in zip(batch["video_id"], batch["frame_idx"], found, strict=True) for p, person in enumerate(people) for j, at in enumerate(person)]

    return applied(frames.select("video_id", "frame_idx", image), factory, options, rows_of, PEOPLE)


def lifted(joints: DataFrame, factory: Factory, size: tuple[int, int], **options) -> DataFrame:
    """3-D joints from 2-D ones (video_id, frame_idx, joint, x, y, conf; one person a frame).  The model's ``lift`` takes an array of points (null: NaN) and
    one of confidences in order of joints and the image's size, and gives an array of 3-D points and one of confidences."""
    point = F.array_sort(F.collect_list(F.struct("joint", "x", "y", "conf")))
    poses = joints.groupBy("video_id", "frame_idx").agg(point.alias("p"))
    poses = poses.select("video_id", "frame_idx", *(F.col(f"p.{c}").alias(c) for c in ("joint", "x", "y", "conf")))

    def rows_of(model: Any, batch: pd.DataFrame) -> list[tuple]:
        out = []
        for r in batch.itertuples(index=False):
            points, conf = np.column_stack([np.asarray(r.x, float), np.asarray(r.y, float)]), np.asarray(r.conf, float)
            coords, sure = model.lift(points, conf, size)
            out += [(r.video_id, r.frame_idx, int(j), *map(float, at), float(c)) for j, at, c in zip(r.joint, coords, sure, strict=True)]
        return out

    return applied(poses, factory, options, rows_of, LIFTED)
