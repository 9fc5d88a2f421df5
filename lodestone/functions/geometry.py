"""Geometry columns: representative point x, y (f32) and, for areas, a flat ring list with part offsets."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Geometry
from .tiling import MAX_ZOOM, Bbox

_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value: the geohash alphabet


def point(x: Column, y: Column) -> dict[str, Column]:
    return {"x": x.cast("float"), "y": y.cast("float")}


def quadkey(key: Column) -> dict[str, Column]:
    """Base-4 digits to tile, tile to longitude and latitude; centre and closed ring of five corners."""
    bits = lambda table: F.conv(F.translate(key, "0123", table), 2, 10).cast("double")
    tx, ty = bits("0101"), bits("0011")
    n = F.pow(F.lit(2.0), F.length(key))
    lon = lambda o: ((tx + o) / n * 360 - 180).cast("float")
    lat = lambda o: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * (ty + o) / n)))).cast("float")
    w, e, north, south = lon(0.0), lon(1.0), lat(0.0), lat(1.0)
    return {"x": lon(0.5), "y": lat(0.5), "geometry": F.array(w, north, e, north, e, south, w, south, w, north), "part_offsets": F.array(F.lit(0), F.lit(5))}


def wkt(text: Column) -> dict[str, Column]:
    """POLYGON and MULTIPOLYGON: all rings in order; the point is the mean of all vertices, closing ones included."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    numbers = F.transform(rings, lambda r: F.transform(F.split(F.trim(r), r"\s*,\s*|\s+"), lambda v: v.cast("double")))
    flat = F.flatten(numbers)
    count = F.size(flat) / 2
    total = lambda parity: F.aggregate(F.filter(flat, lambda _, i: i % 2 == parity), F.lit(0.0), lambda a, v: a + v)
    sizes = F.transform(numbers, lambda r: (F.size(r) / 2).cast("int"))
    offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return {"x": (total(0) / count).cast("float"), "y": (total(1) / count).cast("float"), "geometry": F.transform(flat, lambda v: v.cast("float")), "part_offsets": offsets}


def geohash(key: Column) -> dict[str, Column]:
    """Centre of a geohash cell; five bits a character, longitude first."""
    code = F.transform(F.filter(F.split(F.lower(key), ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(_BASE32)) - 1)
    bits = F.flatten(F.transform(code, lambda v: F.transform(F.array(*map(F.lit, (4, 3, 2, 1, 0))), lambda s: F.call_function("shiftright", v, s).bitwiseAND(F.lit(1)))))

    def centre(parity: int, half: float) -> Column:
        mine = F.filter(bits, lambda _, i: i % 2 == parity)
        step = lambda a, b: F.struct((a["v"] * 2 + b).alias("v"), (a["n"] * 2).alias("n"))
        got = F.aggregate(mine, F.struct(F.lit(0.0).alias("v"), F.lit(1.0).alias("n")), step)
        return ((got["v"] + 0.5) / got["n"] * (2 * half) - half).cast("float")

    return {"x": centre(0, 180.0), "y": centre(1, 90.0)}


def columns(g: Geometry) -> dict[str, Column]:
    if g.kind in ("xy", "lonLat"):
        return point(F.col(g.x), F.col(g.y))
    if g.kind == "quadkey":
        return quadkey(F.col(g.column))
    if g.kind == "wkt":
        return wkt(F.col(g.column))
    if g.kind == "geohash":
        return geohash(F.col(g.column))
    raise NotImplementedError(f"geometry kind '{g.kind}'")


def extent(geometry: Column) -> Column:
    """The larger side of the bounding box of a flat vertex list; null without vertices."""
    span = lambda parity: (lambda v: F.array_max(v) - F.array_min(v))(F.filter(geometry, lambda _, i: i % 2 == parity))
    return F.greatest(span(0).cast("double"), span(1).cast("double"))


def real_zoom(ext: Column, root: Bbox) -> Column:
    """First zoom at which the shape is as large as a grid cell, with 0.02 of slack; deepest for points."""
    z = F.ceil(F.log2(F.lit(root.max_x - root.min_x) / (F.lit(512.0) * ext)) - F.lit(0.02))
    return F.when(ext.isNull() | (ext <= 0), F.lit(MAX_ZOOM)).otherwise(F.greatest(F.lit(0), F.least(F.lit(MAX_ZOOM), z))).cast("int")
