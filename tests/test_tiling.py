import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry, tiling
from lodestone.functions.tiling import Bbox


def naive(p, lo, hi, n):
    """The cell whose half-open span holds p, by its exact edges."""
    edge = lambda i: hi if i >= n else lo + i * ((hi - lo) / n)
    i = max(0, min(n - 1, math.floor((p - lo) / (hi - lo) * n)))
    while i > 0 and p < edge(i):
        i -= 1
    while i < n - 1 and p >= edge(i + 1):
        i += 1
    return i


ROOTS = [(-180.17999999999998, 180.17999999999998), (0.0, 1.0), (-10.0, 10.0), (0.1, 0.30000000000000004), (-73.99, 40.77)]


@pytest.mark.parametrize("lo,hi", ROOTS)
def test_seams_and_nesting(spark, lo, hi):
    ps = []
    for z in (1, 3, 7, 11):
        for i in {0, 1, (1 << z) // 3, (1 << z) // 2, (1 << z) - 1, 1 << z}:
            e = hi if i >= 1 << z else lo + i * ((hi - lo) / (1 << z))
            ps += [e, np.nextafter(e, -np.inf), np.nextafter(e, np.inf)]
    ps += [lo - 1, hi + 1]
    root = Bbox(lo, lo, hi, hi)
    df = spark.createDataFrame([(float(p), float(p)) for p in ps], "x double, y double").withColumn("ix", tiling.deep_index(root, "x"))
    for z in (0, 1, 3, 7, 11, 16):
        rows = df.select("x", tiling.tile_index(root, z, "x").alias("t"), tiling.shift(F.col("ix"), z).alias("s"), tiling.grid_index(root, min(z, 16), "x").alias("g"), tiling.shift(F.col("ix"), z, 9).alias("gs")).collect()
        for r in rows:
            assert r.t == r.s == naive(r.x, lo, hi, 1 << z) and r.g == r.gs


def test_rect_membership_is_a_partition(spark):
    root = Bbox(-10.0, -20.0, 30.0, 60.0)
    rng = np.random.default_rng(3)
    pts = [(float(x), float(y)) for x, y in zip(rng.uniform(-10, 30, 200), rng.uniform(-20, 60, 200))] + [(30.0, 60.0), (-10.0, -20.0), (10.0, 20.0)]
    df = spark.createDataFrame(pts, "x double, y double")
    hits = sum((tiling.in_tile(root, 2, i, j).cast("int") for i in range(4) for j in range(4)), F.lit(0))
    assert df.where(hits != 1).count() == 0


def test_padded_square():
    assert Bbox(-180, -90, 180, 90).padded_square() == Bbox(-180.17999999999998, -180.17999999999998, 180.17999999999998, 180.17999999999998)
    assert Bbox(3, 3, 3, 3).padded_square() == Bbox(2.5, 2.5, 3.5, 3.5)


def test_morton_orders_bits(spark):
    r = spark.createDataFrame([(5, 3)], "a long, b long").select(tiling.morton(F.col("a"), F.col("b")).alias("m")).first()
    assert r.m == 0b011011


def test_geometries(spark):
    df = spark.createDataFrame([("0213", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "ezs42")], "k string, w string, g string")
    q = {n: c.alias(n) for n, c in geometry.quadkey(F.col("k")).items()}
    r = df.select(*q.values()).first()
    assert abs(r.x - (3.5 / 16 * 360 - 180)) < 1e-4 and r.part_offsets == [0, 5] and len(r.geometry) == 10 and r.geometry[:2] == r.geometry[-2:]
    w = df.select(*[c.alias(n) for n, c in geometry.wkt(F.col("w")).items()]).first()
    assert w.part_offsets == [0, 5, 9] and abs(w.x - 14 / 9) < 1e-6
    g = df.select(*[c.alias(n) for n, c in geometry.geohash(F.col("g")).items()]).first()
    assert abs(g.x + 5.603) < 0.01 and abs(g.y - 42.605) < 0.01


def test_real_zoom(spark):
    root = Bbox(0, 0, 524288, 524288)
    rows = spark.createDataFrame([(1024.0, 0), (1.0, 10), (0.0, 16), (None, 16), (1.01, 10), (1e9, 0)], "e double, z int").select("z", geometry.real_zoom(F.col("e"), root).alias("got")).collect()
    assert all(r.z == r.got for r in rows)
