"""Closed forms against naive loops over levels."""
import random

import pytest

from lodestone.functions.tiling import Bbox
from lodestone.operators import pyramid

ROOT = Bbox(0.0, 0.0, 1.0, 1.0)


def tile(p, z):
    n = 1 << z
    return tuple(min(n - 1, max(0, int(c * n))) for c in p)


def naive_quadtree(pts, budget, max_zoom):
    out, todo = [], [(0, 0, 0, pts)]
    while todo:
        z, tx, ty, rows = todo.pop()
        cells = {}
        for r in rows:
            cells.setdefault(tile(r[:2], z + 9), []).append(r)
        if len(rows) <= budget or z >= max_zoom or len(cells) == len(rows):
            out += [(z, tx, ty, r[2], 1, True) for r in rows]
            continue
        out += [(z, tx, ty, min(r[2] for r in c), len(c), False) for c in cells.values()]
        kids = {}
        for r in rows:
            kids.setdefault(tile(r[:2], z + 1), []).append(r)
        todo += [(z + 1, *k, v) for k, v in kids.items()]
    return sorted(out)


def naive_aggregate(marks):
    out, active, z = [], {(0, 0)}, 0
    while active:
        inside = [m for m in marks if tile(m[:2], z) in active]
        inner = {tile(m[:2], z) for m in inside if m[2] > z}
        for t in active:
            mine = [m for m in inside if tile(m[:2], z) == t]
            out += [(z, *t, t not in inner, 1, m[3]) for m in mine if m[2] <= z]
            cells = {}
            for m in mine:
                if m[2] > z:
                    cells.setdefault(tile(m[:2], z + 9), []).append(m[3])
            out += [(z, *t, False, len(c), sum(c) / len(c)) for c in cells.values()]
        active = {tile(m[:2], z + 1) for m in inside if tile(m[:2], z) in inner}
        z += 1
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quadtree(spark, seed):
    r = random.Random(seed)
    pts = [(r.choice([r.random(), 0.25 + r.random() / 4096, 0.7]), r.choice([r.random(), 0.5]), i) for i in range(300)]
    got = pyramid.quadtree(spark.createDataFrame(pts, "x double, y double, id int"), ROOT, 6, 20, ["id"]).select("z", "tx", "ty", "id", "merged_count", "is_leaf").collect()
    assert sorted(map(tuple, got)) == naive_quadtree(pts, 20, 6)
    assert sum(1 for g in got if g.is_leaf) == len(pts)


@pytest.mark.parametrize("seed", [1, 2])
def test_aggregate(spark, seed):
    r = random.Random(seed)
    marks = [(r.choice([r.random(), 0.3 + r.random() / 2000]), r.choice([r.random(), 0.3]), r.choice([0, 1, 2, 3, 5]), float(r.randint(0, 50)) * 4) for _ in range(120)]
    marks = list({m[:2]: m for m in marks}.values())
    got = pyramid.aggregate(spark.createDataFrame(marks, "x double, y double, zreal int, v double"), ROOT, ["v"], []).select("z", "tx", "ty", "is_leaf", "merged_count", "v").collect()
    want = naive_aggregate(marks)
    assert sorted((*g[:5], round(g[5], 2)) for g in got) == sorted((*w[:5], round(w[5], 2)) for w in want)


def test_fixture_counts(spark):
    dense = spark.createDataFrame([(0.0005, 0.0005, 1), (0.0010, 0.0010, 2), (0.0015, 0.0015, 3), (0.5, 0.5, 4), (0.9, 0.9, 5)], "x double, y double, val int")
    top = [g for g in pyramid.quadtree(dense, ROOT, 8, 2, ["val"]).collect() if g.z == 0]
    assert sorted((g.val, g.merged_count) for g in top) == [(1, 3), (4, 1), (5, 1)] and not top[0].is_leaf
    sparse = spark.createDataFrame([(v, v, i) for i, v in enumerate((0.1, 0.3, 0.5, 0.7, 0.9))], "x double, y double, val int")
    assert [(g.z, g.is_leaf) for g in pyramid.quadtree(sparse, ROOT, 8, 2, ["val"]).collect()] == [(0, True)] * 5


def test_empty(spark):
    none = spark.createDataFrame([], "x double, y double, id int")
    assert pyramid.quadtree(none, ROOT, 6, 20, ["id"]).count() == 0
