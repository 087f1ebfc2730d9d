"""Run configuration from TOML: areas, gates and model parameters."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from ..functions.geo import BBox
from ..operators.evaluate import Gates

# The box of the National Grid in metres.
GRID_LIMITS = (0.0, 0.0, 700_000.0, 1_300_000.0)


@dataclass(frozen=True)
class Model:
    length_h: float = 300.0
    length_v: float = 2.5
    prior_strength: float = 1.0
    min_evidence: float = 0.05
    cell_xy: float = 125.0
    cell_z: float = 2.5
    sample_step_m: float = 0.5


@dataclass(frozen=True)
class Config:
    areas: dict[str, BBox] = field(default_factory=dict)
    gates: Gates = Gates()
    model: Model = Model()


def check_area(name: str, box: BBox) -> BBox:
    x0, y0, x1, y1 = box
    if not (x0 < x1 and y0 < y1):
        raise ValueError(f"area {name}: its corners are not in order")
    if x0 < GRID_LIMITS[0] or y0 < GRID_LIMITS[1] or x1 > GRID_LIMITS[2] or y1 > GRID_LIMITS[3]:
        raise ValueError(f"area {name}: it leaves the grid")
    return box


def load(path: str) -> Config:
    """The TOML file at path; keys that a section doesn't know are left to others."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    areas = {k: check_area(k, tuple(float(x) for x in v["bbox_bng"])) for k, v in raw.get("aoi", {}).items()}
    pick = lambda cls, d: cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})
    return Config(areas, pick(Gates, raw.get("gates", {})), pick(Model, raw.get("model", {})))
