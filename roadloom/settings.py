"""Settings of a run: checked when they are made, from keywords or a YAML or JSON file."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from pathlib import Path


POSITIVE = ("resolution", "most_pixels", "supersampling", "endpoint_tolerance", "grid_tolerance", "most_details")


@dataclass(frozen=True)
class Settings:
    """resolution and padding in metres, pixel cap, samples a pixel side, tolerances in metres, categories of checks that run."""

    resolution: float = 0.5
    padding: float = 5.0
    most_pixels: int = 40_000_000
    supersampling: int = 4
    endpoint_tolerance: float = 0.5
    grid_tolerance: float = 1.0
    warn_below: float = 0.95
    most_details: int = 500
    categories: tuple[str, ...] = ("structure", "topology", "geometry", "semantics", "raster")


    def __post_init__(self):
        for f in dataclasses.fields(self):
            value, kind = getattr(self, f.name), type(f.default)
            if kind is float and type(value) is int:
                object.__setattr__(self, f.name, float(value))
            elif kind is tuple and isinstance(value, list) and all(isinstance(x, str) for x in value):
                object.__setattr__(self, f.name, tuple(value))
            elif type(value) is not kind:
                raise TypeError(f"{f.name} is {type(value).__name__}, not {kind.__name__}")
        for name in POSITIVE:
            if not 0 < getattr(self, name) < float("inf"):
                raise ValueError(f"{name} must be over 0")
        if not (0 <= self.warn_below <= 1 and 0 <= self.padding < float("inf")):
            raise ValueError("warn_below is from 0 to 1, padding 0 or more")


def load(path: str) -> Settings:
    """Settings from a file; an unknown name is an error."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        import yaml

        values = yaml.safe_load(text)
    known = {f.name for f in dataclasses.fields(Settings)}
    if not isinstance(values or {}, dict) or (unknown := set(values or {}) - known):
        raise ValueError(f"unknown settings: {sorted(unknown) if isinstance(values, dict) else values!r}")
    return Settings(**(values or {}))
