"""Permittivity of terrain: formulas by name that give a column of each cell."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Terrain:
    """What a formula may use. slope_p99: the slope's 99th percentile over the grid."""

    elevation: Column
    slope: Column | None = None
    slope_p99: Column | None = None
    params: dict[str, float] = field(default_factory=dict)


Formula = Callable[[Terrain], Column]
_FORMULAS: dict[str, Formula] = {}


def formula(name: str) -> Callable[[Formula], Formula]:
    """Adds a formula for the raw ruggedness of a cell, from 0 for smooth to 1; it is clipped to that range."""

    def add(own: Formula) -> Formula:
        _FORMULAS[name] = own
        return own

    return add


def names() -> list[str]:
    """The names of all formulas, in order."""
    return sorted(_FORMULAS)


def _above_sea(elevation: Column) -> Column:
    return F.greatest(elevation, F.lit(0.0))


def _reference(params: dict[str, float]) -> float:
    return float(params.get("elevation_ref_m", 4000.0))


@formula("linear")
def linear(t: Terrain) -> Column:
    return _above_sea(t.elevation) / _reference(t.params)


@formula("log")
def log(t: Terrain) -> Column:
    return F.log1p(_above_sea(t.elevation)) / F.log1p(F.lit(_reference(t.params)))


@formula("slope")
def slope(t: Terrain) -> Column:
    if t.slope is None:
        raise ValueError("the slope method needs a slope")
    return t.slope / F.coalesce(F.nullif(t.slope_p99, F.lit(0.0)), F.lit(1.0))


@formula("combined")
def combined(t: Terrain) -> Column:
    weight = float(t.params.get("slope_weight", 0.5))
    return log(t) * (1 - weight) + (slope(t) if t.slope is not None else F.lit(0.0)) * weight


def permittivity(method: str, terrain: Terrain, eps_min: float = 0.2, eps_max: float = 1.0) -> Column:
    """eps_max where the ground is smooth, down to eps_min where it is rugged."""
    if method not in _FORMULAS:
        raise KeyError(f"{method!r} is no formula of permittivity; there are {', '.join(names())}")
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _FORMULAS[method](terrain)))
    return F.lit(eps_max) - raw * (eps_max - eps_min)
