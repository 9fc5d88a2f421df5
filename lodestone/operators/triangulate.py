"""Triangle indices of polygon parts by ear clipping, as an Arrow-fed column."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pyramid import TILE


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def clip(points: list[tuple[float, float]]) -> list[int]:
    """Indices of n - 2 triangles of a simple ring of any winding; a closing vertex is ignored. What cannot be clipped
    (degenerate rings) is fanned from its first vertex."""
    n = len(points) - (len(points) > 1 and points[0] == points[-1])
    ring = list(range(n))
    if n < 3:
        return []
    area = sum(points[i][0] * points[(i + 1) % n][1] - points[(i + 1) % n][0] * points[i][1] for i in range(n))
    if area < 0:
        ring.reverse()
    out: list[int] = []

    def is_ear(k: int) -> bool:
        a, b, c = (points[ring[(k + d) % len(ring)]] for d in (-1, 0, 1))
        if _cross(a, b, c) <= 0:
            return False
        corner = {ring[(k + d) % len(ring)] for d in (-1, 0, 1)}
        return not any(i not in corner and _cross(a, b, points[i]) >= 0 and _cross(b, c, points[i]) >= 0 and _cross(c, a, points[i]) >= 0 and points[i] not in (a, b, c) for i in ring)

    while len(ring) > 3:
        ear = next((k for k in range(len(ring)) if is_ear(k)), None)
        if ear is None:
            break
        out += [ring[ear - 1], ring[ear], ring[(ear + 1) % len(ring)]]
        del ring[ear]
    for k in range(1, len(ring) - 1):
        out += [ring[0], ring[k], ring[k + 1]]
    return out


def of_parts(flat, offsets) -> list[int]:
    """Indices over the whole vertex list; every part is a ring of its own."""
    out: list[int] = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        out += [int(a) + i for i in clip([(float(flat[2 * i]), float(flat[2 * i + 1])) for i in range(a, b)])]
    return out


def triangles(geometry: str = "geometry", parts: str = "part_offsets") -> Column:
    @F.pandas_udf("array<int>")
    def run(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or o is None else of_parts(x, o) for x, o in zip(g, p)])

    return run(F.col(geometry), F.col(parts))


def rebased(rows: DataFrame) -> DataFrame:
    """triangles as indices into the tile's common vertex list: plus the vertices of the marks before. Needs mki."""
    before = F.coalesce(F.sum(F.size("geometry") / 2).over(Window.partitionBy(*TILE).orderBy("mki").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return rows.withColumn("_base", before).withColumn("triangles", F.transform("triangles", lambda i: i + F.col("_base"))).drop("_base")
