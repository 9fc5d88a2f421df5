"""The slab fixture: five facts, six measures, six contexts."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions.measures import ArgExtreme, Partial, parse, partials
from lodestone.functions.tiling import Bbox
from lodestone.operators import cube, fold

ROWS = [(0, "apex", "2025-01-01", 10.0, 50.0), (0, "apex", "2025-04-01", 5.0, 40.0), (0, "zenith", "2025-01-01", 3.0, 90.0), (1, "zenith", "2025-01-01", 8.0, 20.0), (1, "zenith", "2025-07-01", 4.0, 60.0)]
M = {k: parse(v) for k, v in {"total": "sum(tests)", "avg": "wavg(mbps, tests)", "n": "count()", "max": "max(tests)", "dom": "argmax(operator, sum(tests))", "share": "share(sum(tests)) where operator = 'apex'"}.items()}
N = None
CASES = [
    (fold.Context(), [(18, 53.888889, 3, 10, "apex", 0.833333), (12, 33.333333, 2, 8, "zenith", 0)]),
    (fold.Context({"operator": "apex"}), [(15, 46.666667, 2, 10, "apex", 1), (N, N, N, N, N, N)]),
    (fold.Context(ranges={"quarter": ("2025-01-01", "2025-01-01")}), [(13, 59.230769, 2, 10, "apex", 0.769231), (8, 20, 1, 8, "zenith", 0)]),
    (fold.Context(ranges={"quarter": ("2025-04-01", "2025-07-01")}), [(5, 40, 1, 5, "apex", 1), (4, 60, 1, 4, "zenith", 0)]),
    (fold.Context({"operator": "zenith"}, {"quarter": ("2025-01-01", "2025-01-01")}), [(3, 90, 1, 3, "zenith", 0), (8, 20, 1, 8, "zenith", 0)]),
    (fold.Context({"operator": "nimbus"}), [(N,) * 6, (N,) * 6]),
    (fold.Context({"nowhere": "x"}), [(N,) * 6, (N,) * 6]),
]


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(float(m), 0.0, o, dt.date.fromisoformat(q), t, d) for m, o, q, t, d in ROWS]
    return spark.createDataFrame(rows, "x double, y double, operator string, quarter date, tests float, mbps float").withColumn("zreal", F.lit(0))


@pytest.mark.parametrize("ctx,want", CASES)
def test_contexts(facts, ctx, want):
    root = Bbox(-0.5, -0.5, 2.0, 2.0)
    got = fold.fold(facts, root, M, ctx, [(0, 0, 0)], ["operator", "quarter"]).orderBy("k1").collect()
    for g, w in zip(got, want, strict=True):
        for a, b in zip((g.total, g.avg, g.n, g.max, g.dom, g.share), w):
            assert a == b if b is None or isinstance(b, str) else a == pytest.approx(b, abs=1e-6)


def test_codes_and_nan(facts):
    out = fold.fold(facts, Bbox(-0.5, -0.5, 2.0, 2.0), M, fold.Context({"operator": "apex"}), [(0, 0, 0)], ["operator", "quarter"])
    rows = fold.coded(out, M, {"operator": ["apex", "zenith"]}).orderBy("mki").collect()
    assert [r.mki for r in rows] == [0, 1] and [r.dom for r in rows] == [0, 65535] and math.isnan(rows[1].total) and rows[0].total == 15


def test_cache_forgets_the_oldest():
    cache, calls = fold.FoldCache(2), []

    class Row:
        def __init__(self, t):
            self.z, self.tx, self.ty = t

    class Result:
        def __init__(self, tiles):
            self.tiles = tiles

        def orderBy(self, *_):
            return self

        def collect(self):
            return [Row(t) for t in self.tiles]

    def compute(tiles):
        calls.append(list(tiles))
        return Result(tiles)

    a, b, c = (1, 0, 0), (1, 0, 1), (1, 1, 0)
    ask = lambda tiles, ctx=fold.Context(), version="1": cache.get(version, tiles, M, ctx, compute)
    assert len(ask([a, b])[a]) == 1 and ask([a]) and len(calls) == 1
    ask([c])
    ask([b])
    ask([c], fold.Context({"operator": "apex"}))
    ask([c], version="2")
    assert calls == [[a, b], [c], [b], [c], [c]]


def test_ties_take_the_lowest(spark):
    df = spark.createDataFrame([(0.0, 0.0, "b", 2.0), (0.0, 0.0, "a", 2.0), (0.0, 0.0, "c", None)], "x double, y double, d string, v double").withColumn("zreal", F.lit(0))
    for verb in ("argmax", "argmin"):
        assert fold.fold(df, Bbox(-1, -1, 1, 1), {"m": parse(f"{verb}(d, max(v))")}, fold.Context(), [(0, 0, 0)], ["d"]).first().m == "a"


def test_slab(spark):
    rows = [(0, 0, 0, m, o, q, t, t * d) for m, o, q, t, d in ROWS]
    plan = cube.axes({"operator": (["apex", "zenith"], False), "quarter": (["2025-01-01", "2025-04-01", "2025-07-01"], True)})
    assert cube.n_cells(plan) == 6 and [a.stride for a in plan] == [3, 1]
    df = spark.createDataFrame(rows, "z int, tx int, ty int, mki int, operator string, quarter string, sum__tests float, swp__mbps__tests float").withColumns({"cnt": F.lit(1), "max__tests": F.col("sum__tests")})
    df = df.withColumn("cell_id", cube.cell_id(df, plan))
    parts = [Partial("sum", "tests"), Partial("cnt"), Partial("swp", "mbps", "tests"), Partial("max", "tests")]
    s = cube.sparse(df, parts).first()
    assert (s.offsets, s.cell_ids, s.sum__tests, s.swp__mbps__tests) == ([0, 3, 5], [0, 1, 3, 3, 5], [10, 5, 3, 8, 4], [500, 200, 270, 160, 240])
    long = cube.dense(df, plan, parts)
    d = cube.planes(long, parts).first()
    assert d.sum__tests == [10, 0, 15, 0, 15, 0, 3, 8, 3, 8, 3, 12] and d.cnt == [1, 0, 2, 0, 2, 0, 1, 1, 1, 1, 1, 2] and d.swp__mbps__tests == [500, 0, 700, 0, 700, 0, 270, 160, 270, 160, 270, 400]
    assert [None if math.isnan(v) else v for v in d.max__tests] == [10, N, 5, N, N, N, 3, 8, N, N, N, 4]
    got = {(r.mki, r.category): r.sum__tests for r in cube.range_by_difference(long, plan, parts[0], 1, 2).collect()}
    assert got == {(0, 0): 5, (0, 1): 0, (1, 0): 0, (1, 1): 4}
    assert cube.layouts(df, plan).first().layout == "sparse"
    assert cube.bins_of(plan[1], "2025-02-01", None) == (1, 2)
    assert cube.needed_cells(plan, fold.Context({"operator": "zenith"}, {"quarter": ("2025-04-01", "2025-07-01")})) == [3, 5]
    assert cube.needed_cells(plan, fold.Context({"operator": "nimbus"})) is None


@pytest.mark.parametrize("ctx,want", CASES)
@pytest.mark.parametrize("layout", ["sparse", "dense"])
def test_slab_folds_agree_with_the_contexts(spark, layout, ctx, want):
    rows = [(0, 0, 0, m, o, q, t, t * d) for m, o, q, t, d in ROWS]
    plan = cube.axes({"operator": (["apex", "zenith"], False), "quarter": (["2025-01-01", "2025-04-01", "2025-07-01"], True)})
    df = spark.createDataFrame(rows, "z int, tx int, ty int, mki int, operator string, quarter string, sum__tests float, swp__mbps__tests float").withColumns({"cnt": F.lit(1), "max__tests": F.col("sum__tests")})
    df = df.withColumn("cell_id", cube.cell_id(df, plan))
    parts = [Partial("sum", "tests"), Partial("cnt"), Partial("swp", "mbps", "tests"), Partial("max", "tests")]
    made = {"rows": cube.sparse(df, parts)} if layout == "sparse" else {"planes_": cube.planes(cube.dense(df, plan, parts), parts)}
    got = cube.fold_slabs(plan, parts, M, ctx, **made).orderBy("mki").collect()
    for g, w in zip(got, want, strict=True):
        for a, b in zip((g.total, g.avg, g.n, g.max, g.dom, g.share), w):
            assert a == b if b is None or isinstance(b, str) else a == pytest.approx(b, abs=1e-5)


def test_sparse_rows_keep_gaps(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 2, 5.0), (0, 0, 0, 1, 0, 4.0), (0, 0, 0, 4, 1, 7.0)], "z int, tx long, ty long, mki int, cell_id int, sum__v float")
    r = cube.sparse(df, [Partial("sum", "v")]).first()
    assert (r.offsets, r.cell_ids, r.sum__v) == ([0, 0, 2, 2, 2, 3], [0, 2, 1], [4, 5, 7])
    back = cube.sparse_rows(cube.sparse(df, [Partial("sum", "v")]), [Partial("sum", "v")])
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_filters():
    assert fold.active({"a": "x", "b": "(all)", "c": "", "zz": "1"}, {"a", "b", "c"}) == {"a": "x"}
    assert fold.context({"q": "2025-01-01..", "o": "x"}, {"q"}) == fold.Context({"o": "x"}, {"q": ("2025-01-01", None)})
    assert fold.tile_keys(["1/2/3", "1/0/0", "0/0/0"]) == {1: [(2, 3), (0, 0)], 0: [(0, 0)]}


def test_partials_merge(spark):
    parts = partials(M.values())
    assert [p.name for p in parts] == ["sum__tests", "swp__mbps__tests", "cnt", "max__tests"]
