"""Settings of the operators; values outside their range are clamped, as they come from hand-edited files."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

TRUE_WORDS, FALSE_WORDS = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


@dataclass(frozen=True)
class SegmentSettings:
    idle_gap_s: float = 20.0
    max_duration_s: float = 900.0
    min_duration_s: float = 180.0
    title_similarity: float = 0.72
    screenshot_similarity: float = 0.985

    def __post_init__(self):
        _clamp(self, {"idle_gap_s": (0, None), "max_duration_s": (0, None), "min_duration_s": (0, None), "title_similarity": (0, 1), "screenshot_similarity": (0, 1)})


@dataclass(frozen=True)
class CoalesceSettings:
    max_gap_s: float = 900.0
    min_cosine: float = 0.90
    min_score: float = 0.85
    semantic_weight: float = 0.45
    app_weight: float = 0.20
    window_weight: float = 0.10
    keyword_weight: float = 0.10
    gap_penalty: float = 0.12
    switch_penalty: float = 0.20
    lock_blocks: bool = True
    pause_blocks: bool = True
    # fixed values
    transitions: tuple[str, ...] = ("then", "afterward", "next", "switched", "meeting", "call", "pausa", "riunione", "poi", "successivamente")


@dataclass(frozen=True)
class SummaryDedupSettings:
    suppress: float = 0.86
    merge: float = 0.74
    cooldown_s: float = 240.0
    recent: int = 5

    def __post_init__(self):
        _clamp(self, {"suppress": (0, 1), "cooldown_s": (0, None), "recent": (1, None)})
        _clamp(self, {"merge": (0, self.suppress)})


@dataclass(frozen=True)
class ScreenshotDedupSettings:
    phash_distance: int = 6
    min_interval_s: float = 60.0
    recent: int = 8
    exact: bool = True
    perceptual: bool = True
    structural: bool = True
    min_similarity: float = 0.985
    max_selected: int = 3

    def __post_init__(self):
        _clamp(self, {"phash_distance": (0, None), "min_interval_s": (0, None), "recent": (1, None), "min_similarity": (0, 1)})


@dataclass(frozen=True)
class Settings:
    """All of them, as read from a configuration object."""

    version: int = 1
    segments: SegmentSettings = field(default_factory=SegmentSettings)
    coalesce: CoalesceSettings = field(default_factory=CoalesceSettings)
    summaries: SummaryDedupSettings = field(default_factory=SummaryDedupSettings)
    screenshots: ScreenshotDedupSettings = field(default_factory=ScreenshotDedupSettings)


def _clamp(settings: Any, ranges: Mapping[str, tuple[float | None, float | None]]) -> None:
    for name, (low, high) in ranges.items():
        value = getattr(settings, name)
        value = value if low is None else max(type(value)(low), value)
        object.__setattr__(settings, name, value if high is None else min(type(value)(high), value))


def coerce(value: Any, kind: type) -> Any:
    """A configured value as bool, int, float or str; ValueError if it can't be one."""
    if kind is bool:
        if isinstance(value, bool):
            return value
        word = str(value).strip().lower()
        if word in TRUE_WORDS | FALSE_WORDS:
            return word in TRUE_WORDS
        raise ValueError(f"not a boolean: {value!r}")
    if isinstance(value, bool) or value is None:
        raise ValueError(f"not a {kind.__name__}: {value!r}")
    return kind(value)


def load(data: Mapping[str, Any]) -> tuple[Settings, list[str]]:
    """Settings from nested mappings, and warnings for unknown fields; a later version than ours is refused."""
    version = coerce(data.get("version", 1), int)
    if version > Settings.version:
        raise ValueError(f"settings have version {version}; {Settings.version} is the newest known")
    warnings = [f"unknown field {k}" for k in sorted(set(data) - {f.name for f in fields(Settings)})]
    parts: dict[str, Any] = {"version": Settings.version}
    for f in fields(Settings):
        if f.name == "version":
            continue
        kind = type(getattr(Settings(), f.name))
        given = data.get(f.name) or {}
        known = {x.name: x for x in fields(kind)}
        warnings += [f"unknown field {f.name}.{k}" for k in sorted(set(given) - set(known))]
        defaults = kind()
        values = {}
        for k, v in given.items():
            if k in known:
                now = getattr(defaults, k)
                values[k] = tuple(v) if isinstance(now, tuple) else coerce(v, type(now))
        parts[f.name] = kind(**values)
    return Settings(**parts), warnings


def difference(old: Any, new: Any) -> dict[str, tuple[Any, Any]]:
    """Changed fields of two settings by dotted name."""
    a, b = _flat(dataclasses.asdict(old)), _flat(dataclasses.asdict(new))
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


def _flat(data: Mapping[str, Any], before: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in data.items():
        out |= _flat(v, f"{before}{k}.") if isinstance(v, Mapping) else {f"{before}{k}": v}
    return out
