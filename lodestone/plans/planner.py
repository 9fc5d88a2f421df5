"""Probe of the source, choice of reduction and depth, and where folds run."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AREA_MARKS, View
from ..functions.measures import partials
from ..functions.tiling import MAX_ZOOM, Bbox

RAW_ROWS, POINT_BUDGET, FACTS_PER_PLACE, FOLD_BUDGET, VIEWPORT_TILES = 250_000, 250_000, 4, 32_000_000, 12
#: Relative standard deviation of the sketched count of places.
DISTINCT_RSD = 0.05


@dataclass(frozen=True)
class Probe:
    bounds: Bbox | None
    count: int
    distinct: int


@dataclass(frozen=True)
class Plan:
    reduction: str
    max_zoom: int
    budget: int
    root: Bbox


def probe_frame(facts: DataFrame, exact: bool = True) -> DataFrame:
    """One row: bounds, rows and distinct places. exact=False sketches the last, which is enough for planning."""
    place = F.count_distinct(F.struct("x", "y")) if exact else F.approx_count_distinct(F.struct("x", "y"), DISTINCT_RSD)
    return facts.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count(F.lit(1)).alias("n"), place.alias("n_distinct"))


def probe(facts: DataFrame, exact: bool = False) -> Probe:
    r = probe_frame(facts, exact).first()
    return Probe(Bbox(r.min_x, r.min_y, r.max_x, r.max_y) if r.n and r.min_x is not None else None, r.n, r.n_distinct)


def max_zoom(distinct: int, budget: int = POINT_BUDGET) -> int:
    return max(1, min(MAX_ZOOM, math.ceil(math.log2(max(math.sqrt(distinct / budget), 1.0))) + 5))


def reduction(count: int, distinct: int, mark: str) -> str:
    if count <= RAW_ROWS:
        return "rawPassthrough"
    return "aggregate" if mark in AREA_MARKS or count / max(distinct, 1) >= FACTS_PER_PLACE else "quadtreeLod"


def plan(view: View, p: Probe, budget: int = POINT_BUDGET) -> Plan:
    """Grouped views always build the aggregate pyramid, so that their cube exists at any size."""
    if p.bounds is None:
        raise ValueError(f"view '{view.id}': the source is empty")
    return Plan("aggregate" if view.grouped else reduction(p.count, p.distinct, view.mark), max_zoom(p.distinct, budget), budget, p.bounds.padded_square())


@dataclass(frozen=True)
class Route:
    execution: str
    worst_tile_bytes: int
    viewport_bytes: int
    budget_bytes: int
    forced: bool


def tile_costs(cube: DataFrame, view: View) -> DataFrame:
    """Bytes a change of the colour measure moves per tile: its partials (4 bytes each) and a cell id per cell."""
    chosen = next((m for m in view.measures if m.name == view.color), view.measures[0])
    width = 4 * (1 + len(partials([chosen.tree])))
    return cube.groupBy("z", "tx", "ty").agg((F.count(F.lit(1)) * width).alias("bytes"))


def route(cube: DataFrame, view: View, budget: int = FOLD_BUDGET, viewport: int = VIEWPORT_TILES, force: bool = False) -> Route:
    top = [r.bytes for r in tile_costs(cube, view).orderBy(F.desc("bytes"), "z", "tx", "ty").limit(max(1, viewport)).collect()]
    worst = top[0] if top else 0
    return Route("remote" if force or worst > budget else "client", worst, sum(top), budget, force)
