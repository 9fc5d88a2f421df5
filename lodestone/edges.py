"""Queries of operators at the edges of the engine: filters, contexts, slabs, exports, screens, scales, telemetry.

Each entry of the catalogue is a query over the library and SQL that says the same by itself. Results of plain functions
are small tables, and their SQL states the expected values.
"""
from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import queries as base
from .config import Channel, Geometry, Measure, View, ViewError, ViewRegistry
from .functions import dates, measures, scales, tiling
from .functions.measures import parse
from .functions.tiling import Bbox
from .operators import cube, domains, fold, geometry_codec, marks, pyramid, telemetry, triangulate, verify, viewport
from .plans import planner
from .sources import adapters, files, sinks


def rows(spark, values, schema: str) -> DataFrame:
    """A small table from plain values."""
    return spark.createDataFrame([tuple(v) for v in values], schema)


def expected(values, schema: str) -> str:
    """SQL of a small table. schema: 'name TYPE, ...'."""
    names, kinds = zip(*[c.split() for c in schema.split(", ")])
    lit = lambda v: "NULL" if v is None else repr(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(lit, v)) + ")" for v in values)
    return f"SELECT {', '.join(f'{n}::{k} AS {n}' for n, k in zip(names, kinds))} FROM (VALUES {body}) t({', '.join(names)})"


def stated(compute, schema: str, values) -> tuple:
    """An entry whose expected rows are stated. schema in Spark's words."""
    duck = ", ".join(f"{c.split()[0]} {dict(string='VARCHAR', int='INT', long='BIGINT', double='DOUBLE', boolean='BOOLEAN')[c.split()[1]]}" for c in schema.split(", "))
    return (lambda s, d: rows(s, compute(s, d), schema)), expected(values, duck)


SALES = View(
    "sales", "SELECT 1", Geometry("quadkey", "cell"),
    (Channel("part", "part", "dimension", "dict"), Channel("kind", "kind", "dimension", "dict"), Channel("qty", "qty", "measure", "i32"), Channel("day", "day", "temporal", "date")),
    measures=(Measure("sold", "sum(qty)"), Measure("best", "argmax(part, sum(qty))")), encoding={"color": {"channel": "sold"}},
)
PLAN = cube.axes({"flag": (["A", "N"], False), "day": (["2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01"], True)})
LATE = fold.Context({}, {"quarter": ("1996-01-01", "1997-12-31")})
SLAB_MEASURES = {n: parse(t) for n, t in {"total": "sum(qty)", "n": "count()", "most": "max(qty)", "returned": "sum(qty) where flag = 'R'", "share_r": "share(sum(qty)) where flag = 'R'", "top_flag": "argmax(flag, sum(qty))"}.items()}
_SLAB_SQL = base._CELLS + """, i AS (SELECT * FROM cells WHERE quarter BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'), mm AS (SELECT DISTINCT z, tx, ty, mki FROM cells),
g AS (SELECT z, tx, ty, mki, sum(sum__qty::DOUBLE) AS total, sum(cnt)::DOUBLE AS n, max(max__qty)::DOUBLE AS most, coalesce(sum(sum__qty::DOUBLE) FILTER (WHERE flag = 'R'), 0) AS returned FROM i GROUP BY ALL),
t AS (SELECT z, tx, ty, mki, flag AS top_flag FROM (SELECT z, tx, ty, mki, flag, row_number() OVER (PARTITION BY z, tx, ty, mki ORDER BY sum(sum__qty::DOUBLE) DESC, flag) AS r FROM i GROUP BY z, tx, ty, mki, flag) WHERE r = 1)
SELECT z::INT AS z, tx, ty, mki::INT AS mki, total, n, most, returned, round(returned / total, 6) AS share_r, top_flag FROM mm LEFT JOIN g USING (z, tx, ty, mki) LEFT JOIN t USING (z, tx, ty, mki)"""


def _slabs(s, d, which: str) -> DataFrame:
    """A fold of leaf tiles from sparse rows, dense planes, or by each tile's own layout."""
    cells, plan, parts = base._cells(s, d)
    lists = lambda df: cube.sparse(df, parts)
    planes = lambda df: cube.planes(cube.dense(df, plan, parts), parts)
    if which == "sparse":
        made = {"rows": lists(cells)}
    elif which == "dense":
        made = {"planes_": planes(cells)}
    else:
        layout = cube.layouts(cells, plan, 0.25).select(*pyramid.TILE, "layout")
        told = cells.join(layout, list(pyramid.TILE))
        made = {"rows": lists(told.where("layout = 'sparse'")), "planes_": planes(told.where("layout = 'dense'"))}
    out = cube.fold_slabs(plan, parts, SLAB_MEASURES, LATE, **made)
    # the nearest double of a multiple: F.round(c, 6) rounds the decimal text instead, and 41 / 640 lies between the two
    return out.select(*pyramid.TILE, "mki", "total", "n", "most", "returned", (F.round(F.col("share_r") * 1e6) / 1e6).alias("share_r"), "top_flag")


def _plain(df: DataFrame, *names: str) -> DataFrame:
    """NaN as null, for engines that order it otherwise."""
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def _cache(s, d):
    calls, cache, version = [], fold.FoldCache(4), "v1"
    trees = base.trees("total", "top_flag")

    def compute(tiles):
        calls.append(len(tiles))
        return fold.coded(fold.fold(base.facts(s, d), base.ROOT, trees, base.CONTEXT, tiles, base.GRAIN), trees, {"flag": ["A", "N", "R"]})

    first = cache.get(version, base.TILES[:3], trees, base.CONTEXT, compute)
    cache.get(version, base.TILES[1:3], trees, base.CONTEXT, compute)
    cache.get(version, base.TILES, trees, base.CONTEXT, compute)
    return [(f"{z}/{x}/{y}", len(first[z, x, y]), ",".join(map(str, calls)), len(cache.kept)) for z, x, y in base.TILES[:3]]


def _said(text: str) -> str:
    try:
        return str(parse(text))
    except measures.MeasureError as e:
        return f"error: {e}"


def _broken(**changes) -> str:
    import dataclasses

    try:
        dataclasses.replace(SALES, **changes).validate()
        return "ok"
    except ViewError as e:
        return str(e)


def _registry(s, d):
    shelf = ViewRegistry(files.scratch(s))
    shelf.save(SALES)
    got = [(i, len(shelf.get(i).channels), shelf.get(i) == SALES) for i in shelf.list()] + [("../sales", 0, shelf.get("../sales") is None)]
    files.remove(shelf.folder)
    return got


def _store(s, d):
    store = sinks.BakeStore(files.scratch(s))
    none = store.latest("sales")
    for n in (1, 2):
        store.publish("sales", store.new_version("sales"), {"rows": n})
    version, manifest = store.latest("sales")
    kept = len([v for v in files.names(f"{store.folder}/sales") if v != "latest.json"])
    files.remove(store.folder)
    return [(none is None, manifest["rows"], kept)]


def _written(write):
    """Read back what a sink wrote."""

    def run(s, d):
        at = files.scratch(s)
        write(s, d, at)
        return s.read.parquet(at)

    return run


def _leaves(s, d) -> DataFrame:
    tiles = pyramid.quadtree(base.points(s, d), base.ROOT, 6, 500, ["id"]).where("is_leaf")
    return tiles.select(*pyramid.TILE, "id", "x", "y", "status")


_LEAVES = base._PTS + " SELECT z::INT AS z, tx, ty, id, x, y, status FROM lvl JOIN tiles USING (z, tx, ty) WHERE is_leaf"


def _arrow_round(s, d):
    made = sinks.arrow_tiles(_leaves(s, d), {"status": ["F", "O", "P"]}).drop("n_rows")
    return sinks.tile_rows(sinks.unpacked(sinks.packed(made)), "id long, x float, y float, status string")


def _pack_round(s, d):
    made = sinks.arrow_tiles(_leaves(s, d)).select(*pyramid.TILE, F.lit(True).alias("is_leaf"), "data")
    return sinks.tile_rows(sinks.from_packs(sinks.packs(made, 4)), "id long, x float, y float, status string")


def _slab_round(s, d):
    cells, plan, parts = base._cells(s, d)
    raw = sinks.slab_blocks(cube.sparse(cells, parts)).cache()
    words = sinks.slab_dictionary(raw)
    back = sinks.unpacked(sinks.packed(raw, "zstd", 9, words), "zstd", dictionary_=words)
    read = sinks.read_slabs(back, {"sum__qty": "float", "cnt": "int", "max__qty": "float"}).where("sparse")
    return cube.sparse_rows(read, parts)


def _folded_bytes(s, d):
    import pyarrow as pa

    trees = base.trees("total", "top_flag")
    out = fold.coded(fold.fold(base.facts(s, d), base.ROOT, trees, fold.Context({"status": "O"}), base.TILES, base.GRAIN), trees, {"flag": ["A", "N", "R"]})
    t = pa.ipc.open_stream(sinks.folded_columns(out)).read_all()
    runs, at, got = json.loads(t.schema.metadata[b"tiles"]), 0, []
    for k, n in runs:
        part = t.slice(at, n)
        at += n
        got.append((k, n, float(np.nansum(part.column("total").to_numpy())), sum(c == 65535 for c in part.column("top_flag").to_pylist())))
    return got


def _columns(s, d):
    from pyspark.sql.types import IntegerType

    blocks = sinks.column_blocks(_leaves(s, d), ["status"])
    size = F.udf(lambda b: __import__("pyarrow").ipc.open_stream(__import__("zstandard").ZstdDecompressor().decompress(b)).read_all().num_rows, IntegerType())
    return blocks.select("place", "column", size("data").alias("n")).groupBy("place", "column").agg(F.count("n").alias("tiles"), F.sum("n").alias("values"))


_SHAPES = "SELECT p_partkey AS k, CAST(p_partkey % 7 AS INT) AS z0, array(CAST(p_partkey % 100 AS FLOAT), CAST(p_size AS FLOAT), CAST(p_partkey % 100 + 2 AS FLOAT), CAST(p_size AS FLOAT), CAST(p_partkey % 100 + 2 AS FLOAT), CAST(p_size + 3 AS FLOAT), CAST(p_partkey % 100 AS FLOAT), CAST(p_size + 3 AS FLOAT), CAST(p_partkey % 100 AS FLOAT), CAST(p_size AS FLOAT)) AS geometry, array(0, 5) AS part_offsets FROM part"


def _codec(s, d):
    df = base.load(s, d, _SHAPES)

    @F.pandas_udf("struct<kind:int,size:int,x:array<float>>")
    def through(g):
        import pandas as pd

        made = [geometry_codec.encode(x, [5]) for x in g]
        return pd.DataFrame({"kind": [int(m[0]) for m in made], "size": [len(m) for m in made], "x": [geometry_codec.decode(m)[0].tolist() for m in made]})

    return df.select("k", through("geometry").alias("r"), "geometry").select("k", (F.col("r.x") == F.col("geometry")).alias("same"), F.col("r.kind").alias("kind"), "r.size")


def _triangles(s, d):
    shape = base.load(s, d, "SELECT p_partkey AS k, array(CAST(0 AS FLOAT), CAST(0 AS FLOAT), CAST(p_size + 4 AS FLOAT), CAST(0 AS FLOAT), CAST(p_size + 4 AS FLOAT), CAST(p_size AS FLOAT), CAST(2 AS FLOAT), CAST(1 AS FLOAT), CAST(0 AS FLOAT), CAST(p_size AS FLOAT), CAST(0 AS FLOAT), CAST(0 AS FLOAT)) AS geometry, array(0, 6) AS part_offsets FROM part")
    t = shape.select("k", "geometry", triangulate.triangles().alias("t"))
    at = lambda i, c: F.get("geometry", (2 * i + c).cast("int")).cast("double")
    twice = lambda n: F.abs((at(n[1], 0) - at(n[0], 0)) * (at(n[2], 1) - at(n[0], 1)) - (at(n[2], 0) - at(n[0], 0)) * (at(n[1], 1) - at(n[0], 1)))
    corners = F.transform(F.sequence(F.lit(0), (F.size("t") / 3 - 1).cast("int")), lambda i: twice([F.get("t", (3 * i + j).cast("int")) for j in range(3)]))
    used = F.size(F.array_distinct("t"))
    return t.select("k", (F.size("t") / 3).cast("int").alias("triangles"), F.aggregate(corners, F.lit(0.0), lambda a, x: a + x).alias("twice_area"), used.alias("corners_used"))


def _rebased(s, d):
    df = base.load(s, d, _SHAPES).select(F.lit(0).alias("z"), F.col("z0").cast("long").alias("tx"), F.lit(0).cast("long").alias("ty"), "k", "geometry", F.array(F.lit(0), F.lit(1), F.lit(2)).alias("triangles"))
    from pyspark.sql import Window

    df = df.withColumn("mki", F.row_number().over(Window.partitionBy("tx").orderBy("k")) - 1)
    return triangulate.rebased(df).select("k", "mki", F.array_join("triangles", ",").alias("triangles"))


def catalogue() -> dict[str, tuple]:
    q: dict[str, tuple] = {}
    P = base.POINTS
    # sources and sinks
    q["s02_dispatch"] = stated(lambda s, d: [(k, k in adapters.ADAPTERS) for k in ("sql", "jdbc", "parquet", "csv", "json", "orc", "nowhere")], "kind string, known boolean", [(k, k != "nowhere") for k in ("sql", "jdbc", "parquet", "csv", "json", "orc", "nowhere")])
    q["s06_schema"] = stated(lambda s, d: base.points(s, d).dtypes, "name string, kind string", [("id", "bigint"), ("x", "float"), ("y", "float"), ("status", "string"), ("priority", "string"), ("day", "date")])
    q["s07_staging"] = (_written(lambda s, d, at: sinks.write_sorted(base.points(s, d), at, base.ROOT, {"partitionBy": ["status"], "bloom": ["id"], "sortBy": ["id"]})), f"WITH p AS ({P}) SELECT id, x, y, priority, day, status FROM p")
    q["s09_fold_facts"] = (_written(lambda s, d, at: sinks.write_fold_facts(base.facts(s, d).select("x", "y", "zreal", "flag", "qty", F.array(F.col("x")).alias("geometry"), F.lit(1).alias("ext")), at)), f"WITH f AS ({base.DUCK_FACTS}) SELECT x, y, zreal, flag, qty FROM f")
    q["s08_tiles"] = (_written(lambda s, d, at: sinks.write_tiles(_leaves(s, d), at)), _LEAVES)
    q["s10_arrow_tiles"] = (_arrow_round, _LEAVES)
    q["s13_dictionary"] = stated(lambda s, d: [(n, str(sinks.dictionary(["v1"], [f"v{i}" for i in range(n)]).type)) for n in (3, 127, 128, 32768, 65537)], "n int, kind string", [(3, "dictionary<values=string, indices=int8, ordered=0>"), (127, "dictionary<values=string, indices=int8, ordered=0>"), (128, "dictionary<values=string, indices=int16, ordered=0>"), (32768, "dictionary<values=string, indices=int32, ordered=0>"), (65537, "string")])
    q["s15_pack"] = (_pack_round, _LEAVES)
    q["s16_slab_pack"] = (_slab_round, base._CELLS + " SELECT z::INT AS z, tx, ty, mki::INT AS mki, cell_id, sum__qty, cnt, max__qty FROM cells")
    q["s18_column_blocks"] = (_columns, f"WITH l AS ({_LEAVES}), t AS (SELECT count(DISTINCT (z, tx, ty)) AS tiles, count(*) AS n FROM l), c(place, \"column\") AS (VALUES (0, 'x'), (1, 'y'), (2, 'status'), (3, 'id')) SELECT place::INT AS place, \"column\", tiles, n::BIGINT AS \"values\" FROM t, c")
    q["s19_first_paint"] = stated(lambda s, d: enumerate(sinks.first_paint(SALES, ["part", "qty"], "aggregate")), "place int, channel string", [(0, "sold"), (1, "kind"), (2, "day")])
    q["s21_manifest"] = stated(_store, "empty_before boolean, newest int, versions int", [(True, 2, 2)])
    q["s22_registry"] = stated(_registry, "id string, channels int, same boolean", [("sales", 4, True), ("../sales", 0, True)])
    q["s24_folded_columns"] = (lambda s, d: rows(s, _folded_bytes(s, d), "tile string, marks long, total double, unknown long"), "SELECT z || '/' || tx || '/' || ty AS tile, count(*) AS marks, coalesce(sum(total), 0)::DOUBLE AS total, count(*) FILTER (WHERE top_flag IS NULL) AS unknown FROM (" + base._TILEFACTS + ", " + base._fold_sql(["total", "top_flag"], "status = 'O'", base._MK) + ") GROUP BY z, tx, ty")
    # projections
    q["p13_padded_square"] = stated(lambda s, d: [tuple(round(v, 6) for v in (b.min_x, b.min_y, b.max_x, b.max_y)) for b in (Bbox(0, 0, 1000, 500).padded_square(), Bbox(3, 4, 3, 4).padded_square())], "a double, b double, c double, e double", [(-0.5, -250.5, 1000.5, 750.5), (2.5, 3.5, 3.5, 4.5)])
    q["p20_triangulate"] = (_triangles, "SELECT p_partkey AS k, 3::INT AS triangles, (CASE WHEN p_size >= 0 THEN abs((p_size + 4) * p_size + ((p_size + 4) * 1 - 2 * p_size) + (2 * p_size - 0)) END)::DOUBLE AS twice_area, 5 AS corners_used FROM part")
    q["p21_rebase"] = (_rebased, "WITH r AS (SELECT p_partkey AS k, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) - 1 AS i FROM part) SELECT k, i::INT AS mki, (5 * i) || ',' || (5 * i + 1) || ',' || (5 * i + 2) AS triangles FROM r")
    q["p22_codec"] = (_codec, "SELECT p_partkey AS k, true AS same, 1 AS kind, 30 AS size FROM part")
    # filters
    q["f05_filters"] = stated(
        lambda s, d: (lambda f: [("active", k, v) for k, v in f.items()] + [("predicate" if i == 0 else "context", k, v) for i, part in enumerate(fold.split(f, {"part", "day"})) for k, v in part.items()] + [("equals", k, v) for k, v in fold.context(f, {"day"}).equals.items()] + [("range", k, f"{lo}|{hi}") for k, (lo, hi) in fold.context(f, {"day"}).ranges.items()])(fold.active({"part": "p1", "kind": "k2", "day": "2024-01-01..", "empty": "", "all": "(all)", "nowhere": "x"}, {"part", "kind", "day", "empty", "all"})),
        "what string, channel string, value string",
        [("active", "part", "p1"), ("active", "kind", "k2"), ("active", "day", "2024-01-01.."), ("predicate", "kind", "k2"), ("context", "part", "p1"), ("context", "day", "2024-01-01.."), ("equals", "part", "p1"), ("equals", "kind", "k2"), ("range", "day", "2024-01-01|None")],
    )
    q["f07_date_range"] = stated(lambda s, d: [(t, dates.make_range(*(dates.parse_range(t) or (None, None))), dates.in_range("2024-02-10", t)) for t in ("2024-02-01..2024-02-29", "2024-02-10", "..2024-02-09", "2024-02-10..", "", "(all)")], "said string, made string, holds boolean", [("2024-02-01..2024-02-29", "2024-02-01..2024-02-29", True), ("2024-02-10", "2024-02-10", True), ("..2024-02-09", "..2024-02-09", False), ("2024-02-10..", "2024-02-10..", True), ("", "", True), ("(all)", "", True)])
    q["f10_discarded_marks"] = (lambda s, d: fold.fold(base.facts(s, d), base.ROOT, base.trees("total"), fold.Context({"flag": "R"}), base.TILES, base.GRAIN).groupBy("z", "tx", "ty").agg(F.count_if("alive").alias("shown"), F.count_if(~F.col("alive")).alias("discarded")), base._TILEFACTS + f", m AS (SELECT {base._MK}, bool_or(flag = 'R') AS alive FROM f GROUP BY ALL) SELECT z::INT AS z, tx, ty, count(*) FILTER (WHERE alive) AS shown, count(*) FILTER (WHERE NOT alive) AS discarded FROM m GROUP BY z, tx, ty")
    controls = View("o", "x", Geometry("xy", x="x", y="y"), filters=({"channel": "priority", "control": "multiSelect"}, {"channel": "x", "control": "range"}, {"channel": "status", "default": "O"}, {"channel": "day", "control": "dateRange"}))
    q["f11_multi_range"] = (lambda s, d: fold.controlled(base.points(s, d), controls, {"priority": ["1-URGENT", "2-HIGH"], "x": (50000.0, 150000.0), "day": "1995-01-01.."}).select("id"), f"WITH p AS ({P}) SELECT id FROM p WHERE priority IN ('1-URGENT', '2-HIGH') AND x >= 50000 AND x <= 150000 AND status = 'O' AND day >= DATE '1995-01-01'")
    # measures
    texts = ["sum(qty)", "count()", "wavg(a, b)", "share(sum(qty)) where part = 'p'", "argmin(part, avg(qty))", "median(qty)", "countDistinct(qty)", "argmax(part)", "sum(qty", "share(sum(qty))"]
    q["a09_measure_text"] = stated(
        lambda s, d: [(t, _said(t)) for t in texts], "said string, read string",
        list(zip(texts, [
            "Agg(verb='sum', channel='qty', weight=None, where=None)", "Agg(verb='count', channel=None, weight=None, where=None)", "Agg(verb='wavg', channel='a', weight='b', where=None)",
            "Share(inner=Agg(verb='sum', channel='qty', weight=None, where=None), where=Where(channel='part', value='p'))", "ArgExtreme(dimension='part', inner=Agg(verb='avg', channel='qty', weight=None, where=None), largest=False)",
            "error: unknown aggregate verb 'median'", "error: unknown aggregate verb 'countDistinct'", "error: expected ',', found ')'", "error: expected ')', found 'end of expression'", "error: share(...) requires a 'where' restriction",
        ])),
    )
    q["a10_validation"] = stated(lambda s, d: [("as it is", _broken()), ("number", _broken(measures=(Measure("m", "sum(part)"),))), ("dict", _broken(measures=(Measure("m", "argmax(qty, count())"),))), ("name", _broken(measures=(Measure("qty", "count()"),)))], "what string, verdict string", [("as it is", "ok"), ("number", "view 'sales': sums and averages need a number: 'part'; color shows no channel or measure of the view: 'sold'"), ("dict", "view 'sales': restrictions and arg measures need a dict: 'qty'; color shows no channel or measure of the view: 'sold'"), ("name", "view 'sales': two channels or measures share a name: 'qty'; color shows no channel or measure of the view: 'sold'")])
    q["a11_partials"] = stated(lambda s, d: [(t, ",".join(p.name for p in measures.partials([parse(t)]))) for t in ("sum(a)", "count()", "avg(a)", "wavg(a, b)", "min(a)", "max(a)", "share(avg(a)) where c = 'x'", "argmax(c, wavg(a, b))")] + [("all", ",".join(p.name for p in measures.partials(map(parse, ("avg(a)", "sum(a)", "count()", "wavg(b, a)")))))], "measure string, partials string", [("sum(a)", "sum__a"), ("count()", "cnt"), ("avg(a)", "sum__a,cnt"), ("wavg(a, b)", "swp__a__b,sum__b"), ("min(a)", "min__a"), ("max(a)", "max__a"), ("share(avg(a)) where c = 'x'", "sum__a,cnt"), ("argmax(c, wavg(a, b))", "swp__a__b,sum__b"), ("all", "sum__a,cnt,swp__b__a")])
    # grouped views and domains
    q["g04_artifacts"] = (lambda s, d: marks.artifacts(base.facts(s, d), base.SUPPLY, ["zone"]), f"WITH f AS ({base.DUCK_FACTS}), v AS (SELECT DISTINCT 'zone' AS channel, zone AS value FROM f UNION SELECT DISTINCT c, flag FROM f, (VALUES ('top_flag'), ('low_flag')) t(c)) SELECT channel, (row_number() OVER (PARTITION BY channel ORDER BY value) - 1)::INT AS position, value FROM v")
    few = View("o", "x", Geometry("xy", x="x", y="y"), (Channel("status", "status", "dimension", "dict"), Channel("day", "day", "temporal", "date"), Channel("none", "none", "measure", "f32"), Channel("absent", "absent", "measure", "f32")))
    q["g08_scan"] = (lambda s, d: rows(s, [(k, ",".join(v["values"]) if "values" in v else None) for k, v in domains.scan(base.points(s, d).withColumn("none", F.lit(None).cast("float")), few).items()], "channel string, said string"), f"WITH p AS ({P}) SELECT 'status' AS channel, string_agg(DISTINCT status, ',' ORDER BY status) AS said FROM p UNION ALL SELECT 'day', min(day)::VARCHAR || ',' || max(day)::VARCHAR FROM p")
    q["g15_aggregate_block"] = (lambda s, d: marks.aggregate_block(base.facts(s, d), {"by": ["flag", "status"], "measures": {"total": "sum(qty)", "n": "count()", "least": "min(qty)", "zone": "argmax(zone, sum(qty))"}}), f"WITH f AS ({base.DUCK_FACTS}), z AS (SELECT flag, status, zone FROM (SELECT flag, status, zone, row_number() OVER (PARTITION BY flag, status ORDER BY sum(qty::DOUBLE) DESC, zone) AS r FROM f GROUP BY flag, status, zone) WHERE r = 1) SELECT flag, status, total, n, least, zone FROM (SELECT flag, status, sum(qty::DOUBLE) AS total, count(*)::DOUBLE AS n, min(qty)::DOUBLE AS least FROM f GROUP BY flag, status) JOIN z USING (flag, status)")
    # planning and pyramids
    q["b01_plan"] = (lambda s, d: rows(s, [(planner.reduction(p.count, p.distinct, mark), mark, p.count) for p in [planner.probe(base.facts(s, d), exact=True)] for mark in ("point", "polygon")] + [(planner.reduction(n, k, "point"), "point", n) for n, k in ((250_000, 1), (250_001, 250_000), (1_000_000, 250_000))], "reduction string, mark string, n long"), "SELECT CASE WHEN n <= 250000 THEN 'rawPassthrough' WHEN mark = 'polygon' OR n / k >= 4 THEN 'aggregate' ELSE 'quadtreeLod' END AS reduction, mark, n::BIGINT AS n FROM (SELECT m.mark, count(*) AS n, count(DISTINCT l_partkey) AS k FROM lineitem, (VALUES ('point'), ('polygon')) m(mark) GROUP BY m.mark UNION ALL SELECT * FROM (VALUES ('point', 250000, 1), ('point', 250001, 250000), ('point', 1000000, 250000)))")
    q["b02_max_zoom"] = stated(lambda s, d: [(n, planner.max_zoom(n)) for n in (1, 250_000, 250_001, 1_000_000, 1_000_001, 10**9, 10**14)], "places long, zoom int", [(1, 5), (250_000, 5), (250_001, 6), (1_000_000, 6), (1_000_001, 7), (10**9, 11), (10**14, 16)])
    q["b03_raw"] = (lambda s, d: pyramid.raw(base.points(s, d), base.ROOT).select("z", "tx", "ty", "is_leaf", "id", "x", "y", "status"), f"WITH p AS ({P}) SELECT 0 AS z, 0::BIGINT AS tx, 0::BIGINT AS ty, true AS is_leaf, id, x, y, status FROM p")
    # slabs
    q["q06_slab_fold_sparse"] = (lambda s, d: _slabs(s, d, "sparse"), _SLAB_SQL)
    q["q06_slab_fold_dense"] = (lambda s, d: _slabs(s, d, "dense"), _SLAB_SQL)
    q["c14_slab_fold_mixed"] = (lambda s, d: _slabs(s, d, "mixed"), _SLAB_SQL)
    q["c15_sparse_rows"] = (lambda s, d: (lambda c: cube.sparse_rows(cube.sparse(c[0], c[2]), c[2]))(base._cells(s, d)), base._CELLS + " SELECT z::INT AS z, tx, ty, mki::INT AS mki, cell_id, sum__qty, cnt, max__qty FROM cells")
    q["c09_bins"] = stated(lambda s, d: [(str(lo), str(hi), *cube.bins_of(PLAN[1], lo, hi)) for lo, hi in ((None, None), ("2024-02-01", "2024-03-01"), ("2024-02-02", None), ("2024-04-02", None), (None, "2023-01-01"))], "lo string, hi string, first int, last int", [("None", "None", 0, 3), ("2024-02-01", "2024-03-01", 1, 2), ("2024-02-02", "None", 2, 3), ("2024-04-02", "None", 4, 3), ("None", "2023-01-01", 0, -1)])
    ctxs = {"all": fold.Context(), "N": fold.Context({"flag": "N"}), "late": fold.Context({}, {"day": ("2024-03-01", None)}), "N late": fold.Context({"flag": "N"}, {"day": ("2024-02-01", "2024-03-01")}), "unknown": fold.Context({"flag": "X"})}
    q["c10_mask"] = stated(lambda s, d: [(n, "".join("x" if m else "." for m in cube.cell_mask(PLAN, c) or [])) for n, c in ctxs.items()], "context string, cells string", [("all", "xxxxxxxx"), ("N", "....xxxx"), ("late", "..xx..xx"), ("N late", ".....xx."), ("unknown", "")])
    q["c13_needed"] = stated(lambda s, d: [(n, ",".join(map(str, cube.needed_cells(PLAN, c) or []))) for n, c in ctxs.items()], "context string, cells string", [("all", "3,7"), ("N", "7"), ("late", "1,3,5,7"), ("N late", "4,6"), ("unknown", "")])
    q["c05_dense"] = (lambda s, d: (lambda c: cube.planes(cube.dense(c[0], c[1], c[2]), c[2]).select("z", "tx", "ty", F.size("sum__qty").alias("entries"), F.element_at("cnt", -1).alias("last"), F.array_join(F.slice("cnt", 1, 20), ",").alias("head")))(base._cells(s, d)), base._CELLS + ", mm AS (SELECT DISTINCT z, tx, ty, mki FROM cells), e AS (SELECT mm.*, c::INT AS c, coalesce(sum(k.cnt), 0)::INT AS v FROM mm CROSS JOIN range(0, 84) r(c) LEFT JOIN cells k ON k.z = mm.z AND k.tx = mm.tx AND k.ty = mm.ty AND k.mki = mm.mki AND k.cell_id // 28 = c // 28 AND k.cell_id <= c GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY z, tx, ty ORDER BY c, mki) AS i, count(*) OVER (PARTITION BY z, tx, ty) AS entries FROM e) SELECT z::INT AS z, tx, ty, max(entries)::INT AS entries, max(v) FILTER (WHERE i = entries) AS last, string_agg(v::VARCHAR, ',' ORDER BY i) FILTER (WHERE i <= 20) AS head FROM o GROUP BY z, tx, ty")
    q["t03_occupancy"] = (lambda s, d: (lambda c: cube.occupancy_distribution(cube.layouts(c[0], c[1]), 0.25).select("tiles", *[F.round(n, 9).alias(n) for n in ("least", "mean", "most", "dense_tiles", "dense_cells")]))(base._cells(s, d)), base._CELLS + ", t AS (SELECT z, tx, ty, count(*) AS nnz, count(*) / (count(DISTINCT mki) * 84) AS o FROM cells GROUP BY z, tx, ty) SELECT count(*) AS tiles, round(min(o), 9) AS least, round(avg(o), 9) AS mean, round(max(o), 9) AS most, round(avg((o >= 0.25)::INT), 9) AS dense_tiles, round(sum(nnz) FILTER (WHERE o >= 0.25) / sum(nnz), 9) AS dense_cells FROM t")
    # folds
    coded = lambda s, d: fold.coded(fold.fold(base.facts(s, d), base.ROOT, base.trees("total", "least", "top_flag"), fold.Context({"status": "O"}), base.TILES, base.GRAIN), base.trees("total", "least", "top_flag"), {"flag": ["A", "N", "R"]})
    q["q05_coded"] = (lambda s, d: _plain(coded(s, d), "total", "least"), "SELECT z, tx, ty, (dense_rank() OVER (PARTITION BY z, tx, ty ORDER BY \"real\", k1, k2) - 1)::INT AS mki, total::FLOAT AS total, least::FLOAT AS least, coalesce(CASE top_flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END, 65535)::INT AS top_flag FROM (" + base._TILEFACTS + ", " + base._fold_sql(["total", "least", "top_flag"], "status = 'O'", base._MK) + ")")
    q["o04_fold_order"] = (lambda s, d: coded(s, d).orderBy("z", "tx", "ty", "mki").groupBy("z", "tx", "ty").agg(F.max("mki").alias("last"), F.count(F.lit(1)).alias("marks")), "SELECT z, tx, ty, (count(*) - 1)::INT AS last, count(*) AS marks FROM (" + base._TILEFACTS + ", " + base._fold_sql(["total"], "status = 'O'", base._MK) + ") GROUP BY z, tx, ty")
    q["q07_tile_keys"] = stated(lambda s, d: [(z, f"{x}/{y}") for z, ks in fold.tile_keys(["3/1/2", "0/0/0", "3/5/6"]).items() for x, y in ks], "z int, place string", [(3, "1/2"), (0, "0/0"), (3, "5/6")])
    q["q09_fold_cache"] = (lambda s, d: rows(s, _cache(s, d), "tile string, marks long, computed string, kept int"), base._TILEFACTS + f", m AS (SELECT DISTINCT {base._MK} FROM f) SELECT z || '/' || tx || '/' || ty AS tile, count(*) AS marks, '3,2' AS computed, 4 AS kept FROM m WHERE (z, tx, ty) IN ((0, 0, 0), (3, 1, 2), (3, 5, 6)) GROUP BY z, tx, ty")
    q["q10_inspect"] = (lambda s, d: base._rounded(fold.inspect(base.facts(s, d), base.ROOT, base.trees("total", "mean"), fold.Context({"flag": "R"}), base.TILES[1], base.GRAIN), base.trees("total", "mean")), "SELECT * FROM (" + base._TILEFACTS + ", " + base._fold_sql(["total", "mean"], "flag = 'R'", base._MK) + ") WHERE (z, tx, ty) = (3, 1, 2) AND total IS NOT NULL")
    q["t04_same_columns"] = (lambda s, d: (lambda c: verify.column_differences(_slabs(s, d, "sparse").withColumn("n", F.col("n") + (F.col("mki") == 0).cast("int")), _slabs(s, d, "dense"), [*pyramid.TILE, "mki"]))(None), _SLAB_SQL.replace("SELECT z::INT AS z, tx", ", u AS (SELECT z::INT AS z, tx").strip() + ") SELECT \"column\", CASE \"column\" WHEN 'n' THEN (SELECT count(*) FROM u WHERE mki = 0 AND n IS NOT NULL) ELSE 0 END AS differing FROM (VALUES ('total'), ('n'), ('most'), ('returned'), ('share_r'), ('top_flag')) t(\"column\")")
    q["t01_stage_traffic"] = (lambda s, d: telemetry.stage_traffic(base.load(s, d, "SELECT event_type, CAST(user_id AS BIGINT) AS b, CAST(event_id % 50 AS BIGINT) AS w FROM events"), "event_type", "b", "w", F.col("w") < 10), "SELECT event_type, sum(user_id)::BIGINT AS bytes, sum(event_id % 50)::BIGINT AS wire, count(*) FILTER (WHERE event_id % 50 >= 10) AS cold, count(*) FILTER (WHERE event_id % 50 < 10) AS warm FROM events GROUP BY event_type")
    q["t02_frames"] = (lambda s, d: telemetry.frame_totals(base.load(s, d, "SELECT CAST(event_id % 80 AS DOUBLE) AS ms FROM events"), "ms").select("long_frames", F.round("fps", 6).alias("fps")), "SELECT count(*) FILTER (WHERE event_id % 80 >= 50) AS long_frames, round(1000 / avg((event_id % 80)::DOUBLE), 6) AS fps FROM events")
    # screens
    q["v02_cover"] = stated(lambda s, d: viewport.cover_tiles([(2, 0, 0), (2, 3, 3), (2, 1, 2)], {(1, 0, 0), (2, 3, 3), (3, 2, 4), (4, 6, 10)}), "z int, x int, y int", [(1, 0, 0), (2, 3, 3), (3, 2, 4), (4, 6, 10)])
    known = {(z, x, y) for z in range(4) for x in range(1 << z) for y in range(1 << z)}
    q["v03_prefetch"] = stated(lambda s, d: [(i, *t) for i, t in enumerate(viewport.prefetch([(2, 0, 0)], known, {(2, 0, 1)}))], "i int, z int, x int, y int", [(0, 1, 0, 0), (1, 2, 1, 0), (2, 2, 1, 1), (3, 3, 0, 0), (4, 3, 0, 1), (5, 3, 1, 0), (6, 3, 1, 1)])

    def cached(s, d):
        c = viewport.TileCache(budget=100)
        first = c.want([(1, 0, 0), (1, 0, 1), (1, 1, 0)], 0.0)
        c.put((1, 0, 0), 40), c.put((1, 0, 1), 40), c.fail((1, 1, 0), 0.0)
        stale = c.put((5, 5, 5), 1)
        soon, later = c.want([(1, 0, 0), (1, 1, 0)], 1.0), c.want([(1, 0, 0), (1, 1, 0)], 2.0)
        c.put((1, 1, 0), 40)
        return [(len(first), stale, len(soon), len(later), ",".join("/".join(map(str, k)) for k in sorted(c.kept)), c.used)]

    q["v06_tile_cache"] = stated(cached, "first int, stale boolean, soon int, later int, kept string, used int", [(3, False, 0, 1, "1/0/0,1/1/0", 80)])
    q["v05_camera"] = stated(lambda s, d: [(b.min_x, b.min_y, b.max_x, b.max_y, *viewport.fitted(b, (800, 400))[0], viewport.fitted(b, (800, 400))[1]) for b in [viewport.camera_bounds((10.0, 20.0), 4.0, (800, 400))]], "a double, b double, c double, e double, x double, y double, scale double", [(-90.0, -30.0, 110.0, 70.0, 10.0, 20.0, 4.0)])
    # scales
    q["e01_scale_type"] = stated(lambda s, d: [(str(e), scales.scale_type(e, dom)) for e, dom in (({"scale": "log"}, None), ({"palette": ["#fff"]}, None), ({"thresholds": [1]}, None), ({}, {"values": ["a"]}), ({}, {"min": 0}))], "said string, scale string", [("{'scale': 'log'}", "log"), ("{'palette': ['#fff']}", "categorical"), ("{'thresholds': [1]}", "threshold"), ("{}", "categorical"), ("{}", "linear")])
    q["e10_legend"] = stated(lambda s, d: [("breaks", "|".join(scales.legend("threshold", [1, 5.5])["items"])), ("values", "|".join(scales.legend("categorical", values=[f"v{i}" for i in range(12)])["items"])), ("more", str(scales.legend("categorical", values=[f"v{i}" for i in range(12)])["more"])), ("clamped", str(scales.legend("linear", lo=0, hi=10, data=(-1, 9))))], "what string, said string", [("breaks", "< 1|1 – 5.5|≥ 5.5"), ("values", "v0|v1|v2|v3|v4|v5|v6|v7|v8|v9"), ("more", "2"), ("clamped", "{'lo': 0, 'hi': 10, 'clamped_lo': True, 'clamped_hi': False}")])
    q["e11_lookup_table"] = stated(lambda s, d: [(k, len(t), str(t[0]), str(t[-1])) for k, t in (("viridis", scales.lookup_table("linear", "viridis")), ("categorical", scales.lookup_table("categorical", "status", categories=6)))], "kind string, texels int, first string, last string", [("viridis", 1024, "(68, 1, 84)", "(253, 231, 37)"), ("categorical", 7, "(12, 163, 12)", "(128, 128, 128)")])
    q["e12_schemes"] = stated(lambda s, d: [(n, len(t), min(map(len, t.values())), max(map(len, t.values()))) for n, t in (("sequential", scales.SEQUENTIAL), ("diverging", scales.DIVERGING), ("categorical", scales.CATEGORICAL))], "family string, schemes int, least int, most int", [("sequential", 10, 5, 5), ("diverging", 5, 3, 5), ("categorical", 3, 4, 8)])
    q["e13_unknown"] = (lambda s, d: base.points(s, d).select("id", scales.category_code(F.col("status"), ["F", "O"]).alias("code")).withColumn("known", scales.known(F.col("code"), ["F", "O"])), f"WITH p AS ({P}) SELECT id, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::INT AS code, status IN ('F', 'O') AS known FROM p")
    q["e14_size"] = (lambda s, d: base.points(s, d).select("id", F.round(scales.sized(F.when(F.col("status") != "P", F.col("x")), 0.0, 524288.0), 6).alias("r")), f"WITH p AS ({P}) SELECT id, round(2 + 22 * sqrt(CASE WHEN status <> 'P' THEN greatest(0, least(1, x::DOUBLE / 524288)) ELSE 0 END), 6) AS r FROM p")
    q["e15_embed_url"] = stated(lambda s, d: [(k, str(v)) for k, v in sorted(scales.parse_embed(scales.embed_url("https://maps.example/v", view="sales", color="sold", bins=5, f_part="p 1&2")).items())], "name string, value string", [("bins", "5"), ("color", "sold"), ("filters", "{'part': 'p 1&2'}"), ("view", "sales")])
    # orders
    q["o01_hilbert_order"] = (lambda s, d: (lambda p: p.select("id", tiling.hilbert(tiling.deep_index(base.ROOT, "x"), tiling.deep_index(base.ROOT, "y")).alias("at")))(base.points(s, d)), f"""WITH RECURSIVE p AS ({P}), h(id, x, y, d, s) AS (SELECT id, greatest(0, least(65535, floor(x::DOUBLE / {base.SIDE} * 65536)))::BIGINT, greatest(0, least(65535, floor(y::DOUBLE / {base.SIDE} * 65536)))::BIGINT, 0::BIGINT, 32768::BIGINT FROM p
        UNION ALL SELECT id, CASE WHEN y & s > 0 THEN x WHEN x & s > 0 THEN 65535 - y ELSE y END, CASE WHEN y & s > 0 THEN y WHEN x & s > 0 THEN 65535 - x ELSE x END, d + s * s * CASE WHEN x & s > 0 THEN (CASE WHEN y & s > 0 THEN 2 ELSE 3 END) WHEN y & s > 0 THEN 1 ELSE 0 END, s // 2 FROM h WHERE s > 0) SELECT id, d AS at FROM h WHERE s = 0""")
    q["o06_distinct_cap"] = (lambda s, d: rows(s, [(c, len(v), more) for c in ("status", "id") for v, more in [domains.values_of(base.load(s, d, "SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus AS status FROM lineitem"), c)]], "channel string, kept int, truncated boolean"), "SELECT channel, least(4096, n)::INT AS kept, n > 4096 AS truncated FROM (SELECT 'status' AS channel, count(DISTINCT l_linestatus) AS n FROM lineitem UNION ALL SELECT 'id', count(DISTINCT l_orderkey * 10 + l_linenumber) FROM lineitem)")
    return q
