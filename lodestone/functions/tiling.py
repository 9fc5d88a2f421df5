"""Quadtree tiles as Column arithmetic. Every index at every zoom is a shift of one 25-bit index per axis."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS, GRID_BITS, MAX_ZOOM = 25, 9, 16


@dataclass(frozen=True)
class Bbox:
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def padded_square(self, margin: float = 0.001) -> Bbox:
        """The square around the centre, a little larger; half a unit each way for a single point."""
        cx, cy = (self.min_x + self.max_x) / 2, (self.min_y + self.max_y) / 2
        half = max(self.max_x - self.min_x, self.max_y - self.min_y) / 2
        half = half * (1 + margin) if half > 0 else 0.5
        return Bbox(cx - half, cy - half, cx + half, cy + half)

    def axis(self, name: str) -> tuple[float, float]:
        return (self.min_x, self.max_x) if name == "x" else (self.min_y, self.max_y)


def edge(lo: float, hi: float, n: int, i: Column) -> Column:
    """Left edge of cell i of n; the last edge is hi itself."""
    return F.when(i >= n, F.lit(hi)).otherwise(F.lit(lo) + i.cast("double") * ((hi - lo) / n))


def cell_index(p: Column, lo: float, hi: float, n: int) -> Column:
    """Clamped floor, then moved by one where rounding disagrees with the exact edges."""
    p = p.cast("double")
    i = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((p - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(n))))).cast("long")
    down = (i > 0) & (p < edge(lo, hi, n, i))
    up = (i < n - 1) & (p >= edge(lo, hi, n, i + 1))
    return F.when(down, i - 1).when(up, i + 1).otherwise(i)


def deep_index(root: Bbox, axis: str, p: Column | None = None) -> Column:
    return cell_index(F.col(axis) if p is None else p, *root.axis(axis), 1 << BITS)


def shift(index: Column, z: Column | int, extra: int = 0) -> Column:
    """index >> (25 - z - extra): the tile index at z (extra 0), or the 512-grid index (extra 9)."""
    z = F.lit(z) if isinstance(z, int) else z
    return F.call_function("shiftright", index, (F.lit(BITS - extra) - z).cast("int"))


def tile_index(root: Bbox, z: int, axis: str, p: Column | None = None) -> Column:
    return cell_index(F.col(axis) if p is None else p, *root.axis(axis), 1 << z)


def grid_index(root: Bbox, z: int, axis: str, p: Column | None = None) -> Column:
    return cell_index(F.col(axis) if p is None else p, *root.axis(axis), 1 << (z + GRID_BITS))


def grid_edge(root: Bbox, z: Column, axis: str, i: Column) -> Column:
    """Left edge of grid cell i at a zoom that may vary by row."""
    lo, hi = root.axis(axis)
    n = F.call_function("shiftleft", F.lit(1).cast("long"), (z + GRID_BITS).cast("int")).cast("double")
    return F.when(i.cast("double") >= n, F.lit(hi)).otherwise(F.lit(lo) + i.cast("double") * (F.lit(hi - lo) / n))


def tile_rect(root: Bbox, z: Column | int, tx: Column, ty: Column) -> list[Column]:
    z = F.lit(z) if isinstance(z, int) else z
    n = F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))
    at = lambda axis, i: F.when(i >= n, F.lit(root.axis(axis)[1])).otherwise(F.lit(root.axis(axis)[0]) + i.cast("double") * (F.lit(root.axis(axis)[1] - root.axis(axis)[0]) / n.cast("double")))
    return [at("x", tx).alias("min_x"), at("y", ty).alias("min_y"), at("x", tx + 1).alias("max_x"), at("y", ty + 1).alias("max_y")]


def in_tile(root: Bbox, z: int, tx: int, ty: int) -> Column:
    """Half-open membership, closed on the root's far edges. Plain ranges on x and y, so scans can prune by them."""
    out = F.lit(True)
    for axis, i in (("x", tx), ("y", ty)):
        lo, hi = root.axis(axis)
        n, p = 1 << z, F.col(axis).cast("double")
        at = lambda j, lo=lo, hi=hi, n=n: hi if j >= n else lo + j * ((hi - lo) / n)
        out = out & ((p >= at(i)) if i > 0 else F.lit(True)) & ((p < at(i + 1)) if i < n - 1 else F.lit(True))
    return out


def child(tx: Column, ty: Column, q: Column | int) -> tuple[Column, Column]:
    q = F.lit(q) if isinstance(q, int) else q
    return tx * 2 + q.bitwiseAND(F.lit(1)), ty * 2 + F.call_function("shiftright", q, F.lit(1)).bitwiseAND(F.lit(1))


def morton(ix: Column, iy: Column) -> Column:
    """Bits of both 25-bit indexes interleaved: a locality-preserving sort key for layouts."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(ix).bitwiseOR(F.shiftleft(spread(iy), 1))


HILBERT_BITS = 16


def hilbert(ix: Column, iy: Column, bits: int = HILBERT_BITS) -> Column:
    """Place on the Hilbert curve of the `bits` upper bits of both 25-bit indexes: neighbours on it are neighbours on the map."""
    n = 1 << bits
    start = F.struct(*[F.shiftright(i.cast("long"), BITS - bits).alias(c) for i, c in ((ix, "x"), (iy, "y"))], F.lit(0).cast("long").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx, ry = (a[c].bitwiseAND(s) > 0 for c in "xy")
        quadrant = F.when(rx, F.when(ry, 2).otherwise(3)).otherwise(F.when(ry, 1).otherwise(0))
        turned = rx & ~ry  # the curve runs backwards here
        x, y = (F.when(turned, F.lit(n - 1) - a[c]).otherwise(a[c]) for c in "xy")
        return F.struct(F.when(ry, x).otherwise(y).alias("x"), F.when(ry, y).otherwise(x).alias("y"), (a["d"] + s * s * quadrant).alias("d"))

    return F.aggregate(F.lit([1 << i for i in range(bits - 1, -1, -1)]).cast("array<bigint>"), start, step)["d"]
