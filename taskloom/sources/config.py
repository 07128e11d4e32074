"""Settings of the engine, from defaults and YAML."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field


# Names and defaults are fixed values: files of settings refer to them.


@dataclass(frozen=True)
class Tracking:
    iou: float = 0.3
    max_age: int = 30
    min_hits: int = 3
    max_gap: int = 10
    confidence: float = 0.5


@dataclass(frozen=True)
class Pose:
    smoothing: str = "one_euro"
    window: int = 5
    alpha: float = 0.5
    min_cutoff: float = 1.0
    beta: float = 0.007
    d_cutoff: float = 1.0
    max_gap: int = 5
    min_confidence: float = 0.2


@dataclass(frozen=True)
class States:
    threshold: float = 5.0
    window: int = 3
    fixture_classes: tuple[str, ...] = ("fixture", "machine", "station")
    container_classes: tuple[str, ...] = ("bin", "box", "container")


@dataclass(frozen=True)
class Contacts:
    distance: float = 50.0
    on: int = 2
    off: int = 3
    motion: float = 5.0
    correlation: float = 0.7
    use_hand_center: bool = True
    min_grasp: int = 5
    min_push: int = 3
    merge_gap: int = 5
    min_duration: int = 3
    min_confidence: float = 0.3


@dataclass(frozen=True)
class Segments:
    min_duration: int = 10
    merge: int = 5
    max_segments: int | None = None
    detect_contact: bool = True
    detect_motion: bool = True
    detect_support: bool = True
    detect_containment: bool = True


@dataclass(frozen=True)
class Graph:
    min_confidence: float = 0.5
    lookback: int = 1
    lookahead: int = 1
    #: Pairs without shared objects never match, so this changes no edge; it is kept for files that set it.
    require_shared_objects: bool = True
    add_temporal_fallback: bool = True


@dataclass(frozen=True)
class Ego:
    enabled: bool = True
    offset: float = 0.1
    gaze_down: float = 30.0
    pinch: float = 0.05
    width: int = 960
    height: int = 720


@dataclass(frozen=True)
class Settings:
    fps: float = 30.0
    width: int = 640
    height: int = 480
    tracking: Tracking = field(default_factory=Tracking)
    pose: Pose = field(default_factory=Pose)
    states: States = field(default_factory=States)
    contacts: Contacts = field(default_factory=Contacts)
    segments: Segments = field(default_factory=Segments)
    graph: Graph = field(default_factory=Graph)
    ego: Ego = field(default_factory=Ego)


def merged(base, values: dict):
    """The settings with the given values; names that they don't have are ignored."""
    names = {f.name for f in dataclasses.fields(base)}
    out = {k: merged(getattr(base, k), v or {}) if dataclasses.is_dataclass(getattr(base, k)) else tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names}
    return dataclasses.replace(base, **out)


def load(path: str) -> Settings:
    """Defaults overlaid with a YAML file; a missing file gives the defaults."""
    import yaml

    try:
        with open(path, encoding="utf-8") as file:
            return merged(Settings(), yaml.safe_load(file) or {})
    except FileNotFoundError:
        return Settings()


def listed(values: dict) -> dict:
    return {k: listed(v) if isinstance(v, dict) else list(v) if isinstance(v, tuple) else v for k, v in values.items()}


def save(settings: Settings, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as file:
        yaml.safe_dump(listed(dataclasses.asdict(settings)), file, sort_keys=False)
