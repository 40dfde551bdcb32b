"""Settings of a model, from defaults or a YAML file."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Domain:
    lat_min: float = -90.0
    lat_max: float = 90.0
    lon_min: float = -180.0
    lon_max: float = 180.0
    resolution_deg: float = 1.5
    analysis_lat_max: float | None = 66.0


@dataclass(frozen=True)
class Charge:
    window_days: int = 30
    decay_per_day: float = 0.02
    climatology_smooth_days: int = 15


@dataclass(frozen=True)
class Permittivity:
    method: str = "linear"
    eps_min: float = 0.2
    eps_max: float = 1.0
    params: dict[str, float] = field(default_factory=lambda: {"elevation_ref_m": 4000.0, "slope_weight": 0.5})


@dataclass(frozen=True)
class Breakdown:
    threshold_mode: str = "percentile"
    threshold_value: float = 97.5


@dataclass(frozen=True)
class Clustering:
    algorithm: str = "components"
    dbscan_eps_cells: float = 2.0
    dbscan_min_samples: int = 5
    link_radius_km: float = 300.0


@dataclass(frozen=True)
class Validation:
    spatial_radius_km: float = 100.0
    temporal_window_hours: float = 48.0
    min_recall: float = 0.30
    min_precision: float = 0.10
    max_pvalue: float = 0.05


@dataclass(frozen=True)
class Config:
    domain: Domain = field(default_factory=Domain)
    charge: Charge = field(default_factory=Charge)
    permittivity: Permittivity = field(default_factory=Permittivity)
    breakdown: Breakdown = field(default_factory=Breakdown)
    clustering: Clustering = field(default_factory=Clustering)
    validation: Validation = field(default_factory=Validation)

    def key(self, *extra: Any) -> str:
        """Eight characters that stand for these settings and extra ones, for names of stored results."""
        return hashlib.md5(json.dumps([asdict(self), *map(str, extra)], sort_keys=True).encode()).hexdigest()[:8]


def _build(kind: type, given: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    values = {}
    for name, value in given.items():
        if name in known:
            default = known[name].default_factory() if callable(known[name].default_factory) else None
            values[name] = _build(type(default), value) if is_dataclass(default) and isinstance(value, dict) else value
    if kind is Validation and isinstance(given.get("success"), dict):
        values |= {k: v for k, v in given["success"].items() if k in known}
    return kind(**values)


def load_config(path: str | Path | None = None) -> Config:
    """The settings of a YAML file; unknown keys are ignored, missing ones and a missing path mean the defaults."""
    if path is None:
        return Config()
    import yaml

    with open(path, encoding="utf-8") as f:
        return _build(Config, yaml.safe_load(f) or {})
