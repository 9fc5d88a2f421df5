"""Query catalogue: every operator over the test tables, with the SQL that an independent engine runs on them.

Marks are parts at exact integer places of a power-of-two root, so that indexes need no tolerance; sums that are not
of whole numbers are rounded on both sides.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Channel, Geometry, Measure, View
from .functions import geometry, scales, tiling
from .functions.dates import iso_day
from .functions.measures import ArgExtreme, Partial, flat, over_facts, parse
from .functions.tiling import Bbox
from .operators import cube, domains, fold, marks, pyramid, telemetry, triangulate, verify, viewport
from .plans import planner
from .sources import adapters

ROOT = Bbox(0.0, 0.0, 524288.0, 524288.0)
SIDE = 524288
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FACTS = """SELECT l_partkey AS pk, CAST((l_partkey * 7919) % 524288 AS FLOAT) AS x, CAST((l_partkey * 104729) % 524288 AS FLOAT) AS y, l_returnflag AS flag, l_linestatus AS status,
CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, CAST(l_partkey % 5 AS {text}) AS zone, CAST(l_quantity AS FLOAT) AS qty, CAST(l_linenumber AS FLOAT) AS w, CAST(l_extendedprice AS FLOAT) AS price,
CAST(10 - l_partkey % 10 AS INT) AS zreal FROM lineitem"""
POINTS = "SELECT o_orderkey AS id, CAST(o_totalprice AS FLOAT) AS x, CAST(o_orderkey AS FLOAT) AS y, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day FROM orders"
SPARK_FACTS, DUCK_FACTS = FACTS.format(text="STRING"), FACTS.format(text="VARCHAR")
MEASURES = {
    "total": "sum(qty)", "n": "count()", "mean": "avg(qty)", "weighted": "wavg(qty, w)", "least": "min(qty)", "most": "max(qty)", "returned": "sum(qty) where flag = 'R'",
    "share_r": "share(sum(qty)) where flag = 'R'", "top_flag": "argmax(flag, sum(qty))", "low_flag": "argmin(flag, avg(qty))",
}
GRAIN = ["flag", "status", "quarter"]
CONTEXT = fold.Context({"status": "O"}, {"quarter": ("1996-01-01", "1997-12-31")})
TILES = [(0, 0, 0), (3, 1, 2), (3, 5, 6), (5, 7, 9), (5, 20, 3)]

SUPPLY = View(
    "supply", SPARK_FACTS, Geometry("xy", x="x", y="y"),
    channels=(Channel("flag", "flag", "dimension", "dict"), Channel("status", "status", "dimension", "dict"), Channel("zone", "zone", "dimension", "dict"), Channel("quarter", "quarter", "temporal", "date"), Channel("qty", "qty", "measure", "f32"), Channel("w", "w", "measure", "f32")),
    measures=tuple(Measure(k, v) for k, v in MEASURES.items()), encoding={"color": {"channel": "weighted"}},
)


def load(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    adapters.register_tables(spark, sf_dir, TABLES)
    return spark.sql(text)


def facts(spark, d) -> DataFrame:
    return load(spark, d, SPARK_FACTS)


def placed_facts(spark, d) -> DataFrame:
    """Facts with the place of their row in the table, `_file` and `_row`."""
    return spark.sql(SPARK_FACTS.replace(" FROM lineitem", ", _file, _row FROM {lineitem}"), lineitem=adapters.placed(spark, f"{d}/lineitem.parquet"))


def points(spark, d) -> DataFrame:
    return load(spark, d, POINTS)


def trees(*names):
    return {n: parse(MEASURES[n]) for n in names or MEASURES}


def mark_table(spark, d) -> DataFrame:
    """One row per place with a square shape as large as its zreal says; where parts share a place, the first row of the table has the zone."""
    m = placed_facts(spark, d).groupBy("x", "y").agg(F.min_by("zone", F.struct("_file", "_row")).alias("zone"), F.min("zreal").alias("zreal"), F.sum("qty").cast("float").alias("total"), F.min("flag").alias("lowest_flag"))
    return m


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant flag per mark among open items, with sum, weighted mean and share."""
    names = ("total", "weighted", "share_r", "top_flag")
    return _fold_marks(facts(spark, sf_dir), trees(*names), fold.Context({"status": "O"})).orderBy("x", "y")


def _fold_marks(df: DataFrame, measures, ctx) -> DataFrame:
    from .functions.measures import partials

    parts = list(dict.fromkeys([*partials(measures.values()), Partial("cnt")]))
    cells = df.groupBy("x", "y", *GRAIN).agg(*[p.from_facts() for p in parts])
    return _rounded(fold.tail(cells, ["x", "y"], measures, ctx, GRAIN), measures).drop("alive")


def _rounded(df: DataFrame, measures) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n, t in measures.items() if not isinstance(t, ArgExtreme)})


def _measure(name):
    def run(spark, d):
        t, df = parse(MEASURES[name]), facts(spark, d)
        if isinstance(t, ArgExtreme):
            return marks.arg_measure(df, ["x", "y"], "v", t)
        return df.groupBy("x", "y").agg(F.round(flat(t, over_facts), 6).alias("v"))

    return run


# --- SQL fragments -------------------------------------------------------------------------------------------------

_F = f"WITH f AS ({DUCK_FACTS})"


def _idx(c: str, n: str) -> str:
    return f"greatest(0, least({n} - 1, CAST(floor(CAST({c} AS DOUBLE) / {SIDE} * {n}) AS BIGINT)))"


_KEYED = f"""WITH f AS ({DUCK_FACTS}), m AS (SELECT x, y, min(zreal) AS zreal, first(zone) AS zone, CAST(sum(qty) AS FLOAT) AS total, min(flag) AS lowest_flag FROM f GROUP BY x, y),
zs AS (SELECT unnest(range(0, 17)) AS z), lvl AS (SELECT m.*, z, {_idx('x', '(1 << z)')} AS tx, {_idx('y', '(1 << z)')} AS ty, {_idx('x', '(1 << (z + 9))')} AS gx, {_idx('y', '(1 << (z + 9))')} AS gy FROM m, zs),
deep AS (SELECT z, tx, ty, max(zreal) AS zmax FROM lvl GROUP BY ALL), tiles AS (SELECT d.z, d.tx, d.ty, d.zmax <= d.z AS is_leaf FROM deep d LEFT JOIN deep p ON p.z = d.z - 1 AND p.tx = d.tx // 2 AND p.ty = d.ty // 2 WHERE d.z = 0 OR p.zmax > p.z),
pl AS (SELECT l.*, t.is_leaf, zreal <= l.z AS "real", CASE WHEN zreal <= l.z THEN CAST(x AS DOUBLE) ELSE gx END AS k1, CASE WHEN zreal <= l.z THEN CAST(y AS DOUBLE) ELSE gy END AS k2 FROM lvl l JOIN tiles t USING (z, tx, ty))"""

_PTS = f"""WITH p AS ({POINTS}), zs AS (SELECT unnest(range(0, 7)) AS z),
lvl AS (SELECT p.*, z, {_idx('x', '(1 << z)')} AS tx, {_idx('y', '(1 << z)')} AS ty, {_idx('x', '(1 << (z + 9))')} AS gx, {_idx('y', '(1 << (z + 9))')} AS gy FROM p, zs),
st AS (SELECT z, tx, ty, count(*) AS n, count(DISTINCT (gx, gy)) AS cells FROM lvl GROUP BY ALL), lf AS (SELECT *, n <= 500 OR z >= 6 OR cells = n AS is_leaf FROM st),
tiles AS (SELECT a.* FROM lf a LEFT JOIN lf b ON b.z = a.z - 1 AND b.tx = a.tx // 2 AND b.ty = a.ty // 2 WHERE a.z = 0 OR NOT b.is_leaf)"""


def _fold_sql(names, where: str, keys="x, y", src="f", grain=("flag", "status", "quarter"), marks_from=None) -> str:
    """Two-stage fold in SQL: f32 cells, then f64 measures of the surviving ones, joined to all marks."""
    g = ", ".join(grain)
    using = keys
    flat_sql = {
        "total": "coalesce(sum(s::DOUBLE), 0)", "n": "sum(c)::DOUBLE", "mean": "sum(s::DOUBLE) / nullif(sum(c), 0)", "weighted": "sum(sw::DOUBLE) / nullif(sum(ww::DOUBLE), 0)", "least": "min(lo)::DOUBLE", "most": "max(hi)::DOUBLE",
        "returned": "coalesce(sum(s::DOUBLE) FILTER (WHERE flag = 'R'), 0)", "share_r": "coalesce(sum(s::DOUBLE) FILTER (WHERE flag = 'R'), 0) / nullif(coalesce(sum(s::DOUBLE), 0), 0)",
    }
    cols = [f"round({flat_sql[n]}, 6) AS {n}" for n in names if n in flat_sql]
    args = {"top_flag": "sum(s::DOUBLE) DESC", "low_flag": "sum(s::DOUBLE) / sum(c) ASC"}
    ctes = [f"cells AS (SELECT {keys}, {g}, sum(qty)::FLOAT AS s, count(*) AS c, sum(qty * w)::FLOAT AS sw, sum(w)::FLOAT AS ww, min(qty) AS lo, max(qty) AS hi FROM {src} GROUP BY {keys}, {g})", f"inside AS (SELECT * FROM cells WHERE {where})", f"flat AS (SELECT {keys}, {', '.join([*cols, 'true AS alive'])} FROM inside GROUP BY {keys})"]
    joins = ""
    for n in names:
        if n in args:
            ctes.append(f"{n}_t AS (SELECT {keys}, flag AS {n} FROM (SELECT {keys}, flag, row_number() OVER (PARTITION BY {keys} ORDER BY {args[n]}, flag) AS r FROM inside GROUP BY {keys}, flag) WHERE r = 1)")
            joins += f" LEFT JOIN {n}_t USING ({using})"
    ctes.append(f"marks AS (SELECT DISTINCT {keys} FROM {marks_from or 'cells'})")
    return ", ".join(ctes) + f" SELECT {keys}, {', '.join(names)} FROM marks LEFT JOIN flat USING ({using}){joins}"


_CTX = "status = 'O' AND quarter BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"
_REQ = "req(z, tx, ty) AS (VALUES " + ", ".join(f"({z}::INT, {x}::BIGINT, {y}::BIGINT)" for z, x, y in TILES) + ")"
_TILEFACTS = f"""WITH f0 AS ({DUCK_FACTS}), {_REQ}, ft AS (SELECT f0.*, req.z, req.tx, req.ty, {_idx('x', '(1 << (req.z + 9))')} AS gx, {_idx('y', '(1 << (req.z + 9))')} AS gy FROM f0, req WHERE {_idx('x', '(1 << req.z)')} = req.tx AND {_idx('y', '(1 << req.z)')} = req.ty),
f AS (SELECT *, zreal <= z AS "real", CASE WHEN zreal <= z THEN CAST(x AS DOUBLE) ELSE gx END AS k1, CASE WHEN zreal <= z THEN CAST(y AS DOUBLE) ELSE gy END AS k2 FROM ft)"""
_MK = 'z, tx, ty, "real", k1, k2'


def _view_fold(names, ctx):
    def run(spark, d):
        out = fold.fold(facts(spark, d), ROOT, trees(*names), ctx, TILES, GRAIN)
        return _rounded(out, trees(*names)).drop("alive")

    return run


def _cells(spark, d) -> tuple[DataFrame, list, list]:
    """Cells of the leaf tiles with marks numbered and cell ids, over flag x quarter."""
    df = facts(spark, d)
    dom = {"flag": (["A", "N", "R"], False), "quarter": ([f"{y}-{m:02d}-01" for y in range(1995, 2002) for m in (1, 4, 7, 10)], True)}
    plan, parts = cube.axes(dom), [Partial("sum", "qty"), Partial("cnt"), Partial("max", "qty")]
    rows = pyramid.numbered(pyramid.cube(df, ROOT, ["flag", "quarter"], parts).where("is_leaf"))
    return rows.withColumn("cell_id", cube.cell_id(rows, plan)), plan, parts


_Q0 = "(date_diff('quarter', DATE '1995-01-01', quarter))"
_CELLS = _KEYED + f""", leafrows AS (SELECT pl.z, pl.tx, pl.ty, "real", k1, k2, f.flag, f.quarter, f.qty FROM pl JOIN f USING (x, y) WHERE is_leaf),
c0 AS (SELECT {_MK}, flag, quarter, sum(qty)::FLOAT AS sum__qty, count(*)::INT AS cnt, max(qty) AS max__qty FROM leafrows GROUP BY ALL),
cells AS (SELECT *, CAST((ascii(flag) = ascii('N'))::INT * 28 + (ascii(flag) = ascii('R'))::INT * 56 + {_Q0} AS INT) AS cell_id, dense_rank() OVER (PARTITION BY z, tx, ty ORDER BY "real", k1, k2) - 1 AS mki FROM c0)"""


def _sql(text):
    return lambda spark, d: load(spark, d, text)


def _same(text):
    """A source query that both engines run as it is."""
    return _sql(text), text


def catalogue() -> dict[str, tuple]:
    """name: (callable, SQL or None)."""
    q: dict[str, tuple] = {}
    q["s05_row_count"] = (lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem")
    q["p02_cast"] = (
        lambda s, d: adapters.canonical(load(s, d, "SELECT * FROM orders"), View("o", "x", Geometry("xy", x="o_totalprice", y="o_orderkey"), (Channel("k8", "o_orderkey", "identity", "u8"), Channel("k16", "o_orderkey", "identity", "u16"), Channel("status", "o_orderstatus", "dimension", "dict"), Channel("day", "o_orderdate", "temporal", "date"), Channel("price", "o_totalprice", "measure", "f64")))),
        "SELECT o_totalprice::FLOAT AS x, o_orderkey::FLOAT AS y, (o_orderkey % 256)::INT AS k8, (o_orderkey % 65536)::INT AS k16, coalesce(o_orderstatus, 'null') AS status, o_orderdate::DATE AS day, o_totalprice AS price FROM orders",
    )
    digits = "||".join(f"CAST((s_suppkey // {4**i}) % 4 AS VARCHAR)" for i in reversed(range(7)))
    spark_digits = ", ".join(f"CAST((s_suppkey DIV {4**i}) % 4 AS STRING)" for i in reversed(range(7)))

    def quadkey(s, d):
        df = load(s, d, f"SELECT s_suppkey, concat({spark_digits}) AS k FROM supplier")
        g = geometry.quadkey(F.col("k"))
        return df.select("s_suppkey", "k", F.round(g["x"].cast("double"), 3).alias("x"), F.round(g["y"].cast("double"), 3).alias("y"), (F.size(g["geometry"]) / 2).cast("int").alias("vertices"), F.round(F.get(g["geometry"], F.lit(1)).cast("double"), 3).alias("north"))

    bit = lambda k: " + ".join(f"((s_suppkey // {4**i * k}) % 2) * {2**i}" for i in range(7))
    q["p05_quadkey"] = (quadkey, f"WITH t AS (SELECT s_suppkey, {digits} AS k, {bit(1)} AS tx, {bit(2)} AS ty FROM supplier) SELECT s_suppkey, k, round(((tx + 0.5::DOUBLE) / 128 * 360 - 180)::FLOAT::DOUBLE, 3) AS x, round((degrees(2 * atan(exp(pi() * (1 - 2 * (ty + 0.5::DOUBLE) / 128))) - pi() / 2))::FLOAT::DOUBLE, 3) AS y, 5 AS vertices, round((degrees(2 * atan(exp(pi() * (1 - 2 * ty::DOUBLE / 128))) - pi() / 2))::FLOAT::DOUBLE, 3) AS north FROM t")

    def wkt(s, d):
        df = load(s, d, "SELECT p_partkey, p_size, concat('MULTIPOLYGON(((', p_partkey, ' 0, ', p_partkey + p_size, ' 0, ', p_partkey + p_size, ' ', p_size, ', ', p_partkey, ' 0)), ((0 0, 4 0, 4 4, 0 0)))') AS t FROM part")
        g = geometry.wkt(F.col("t"))
        return df.select("p_partkey", g["x"].cast("double").alias("x"), g["y"].cast("double").alias("y"), F.array_join(g["part_offsets"], ",").alias("offsets"), geometry.extent(g["geometry"]).alias("ext"))

    q["p06_wkt"] = (wkt, "SELECT p_partkey, ((4 * p_partkey + 2 * p_size + 8) / 8.0::DOUBLE)::FLOAT::DOUBLE AS x, ((p_size + 4) / 8.0::DOUBLE)::FLOAT::DOUBLE AS y, '0,4,8' AS offsets, greatest(p_partkey + p_size, greatest(p_size, 4))::DOUBLE AS ext FROM part")
    q["p08_tile_index"] = (lambda s, d: points(s, d).select("id", *[tiling.tile_index(ROOT, z, a).alias(f"t{a}{z}") for z in (0, 3, 12) for a in "xy"]), f"WITH p AS ({POINTS}) SELECT id, " + ", ".join(f"{_idx(a, str(1 << z))} AS t{a}{z}" for z in (0, 3, 12) for a in "xy") + " FROM p")
    q["p09_grid_index"] = (lambda s, d: pyramid.indexed(points(s, d), ROOT).select("id", *[tiling.shift(F.col(f"i{a}"), z, 9).alias(f"g{a}{z}") for z in (0, 4, 16) for a in "xy"]), f"WITH p AS ({POINTS}) SELECT id, " + ", ".join(f"{_idx(a, str(1 << (z + 9)))} AS g{a}{z}" for z in (0, 4, 16) for a in "xy") + " FROM p")
    q["p10_grid_edges"] = (lambda s, d: pyramid.indexed(points(s, d), ROOT).select("id", tiling.grid_edge(ROOT, F.lit(3), "x", tiling.shift(F.col("ix"), 3, 9)).alias("lo"), tiling.grid_edge(ROOT, F.lit(3), "x", tiling.shift(F.col("ix"), 3, 9) + 1).alias("hi")), f"WITH p AS ({POINTS}) SELECT id, {_idx('x', '4096')} * 128.0::DOUBLE AS lo, ({_idx('x', '4096')} + 1) * 128.0::DOUBLE AS hi FROM p")
    q["p12_tile_rect"] = (lambda s, d: pyramid.indexed(points(s, d), ROOT).select(tiling.shift(F.col("ix"), 4).alias("tx"), tiling.shift(F.col("iy"), 4).alias("ty")).distinct().select("tx", "ty", *tiling.tile_rect(ROOT, 4, F.col("tx"), F.col("ty")), *[c.alias(n) for n, c in zip(("cx", "cy"), tiling.child(F.col("tx"), F.col("ty"), 3))]), f"WITH p AS ({POINTS}), t AS (SELECT DISTINCT {_idx('x', '16')} AS tx, {_idx('y', '16')} AS ty FROM p) SELECT tx, ty, tx * 32768.0::DOUBLE AS min_x, ty * 32768.0::DOUBLE AS min_y, (tx + 1) * 32768.0::DOUBLE AS max_x, (ty + 1) * 32768.0::DOUBLE AS max_y, tx * 2 + 1 AS cx, ty * 2 + 1 AS cy FROM t")
    q["p14_zreal"] = (lambda s, d: load(s, d, "SELECT p_partkey, CAST(power(2, p_partkey % 12) AS DOUBLE) * (CASE WHEN p_partkey % 3 = 0 THEN 1.5D ELSE 1D END) AS ext FROM part").select("p_partkey", geometry.real_zoom(F.col("ext"), ROOT).alias("zreal")), f"SELECT p_partkey, CAST(greatest(0, least(16, ceil(log2({SIDE} / (512 * power(2, p_partkey % 12) * (CASE WHEN p_partkey % 3 = 0 THEN 1.5::DOUBLE ELSE 1 END))) - 0.02::DOUBLE))) AS INT) AS zreal FROM part")
    q["p18_iso_day"] = (lambda s, d: load(s, d, "SELECT o_orderkey, CAST(datediff(o_orderdate, DATE '1970-01-01') AS INT) AS days, CAST(datediff(o_orderdate, DATE '1970-01-01') AS BIGINT) * 86400000 + 3600000 AS ms FROM orders").select("o_orderkey", iso_day(F.col("days"), "int").alias("a"), iso_day(F.col("ms"), "bigint").alias("b")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b FROM orders")
    q["o01_morton_order"] = (lambda s, d: pyramid.indexed(points(s, d), ROOT).select("id", tiling.morton(tiling.shift(F.col("ix"), 2), tiling.shift(F.col("iy"), 2)).alias("m")), f"WITH p AS ({POINTS}), t AS (SELECT id, {_idx('x', '4')} AS a, {_idx('y', '4')} AS b FROM p) SELECT id, (a % 2) + 2 * (b % 2) + 4 * (a // 2) + 8 * (b // 2) AS m FROM t")
    q["f01_bake_filter"] = (lambda s, d: adapters.filtered(facts(s, d), ["qty > 10", "flag <> 'N'"]).groupBy("flag").agg(F.count("*").alias("n")), _F + " SELECT flag, count(*) AS n FROM f WHERE qty > 10 AND flag <> 'N' GROUP BY flag")
    q["f02_tile_rect"] = (lambda s, d: points(s, d).where(tiling.in_tile(ROOT, 2, 1, 0)).select("id"), f"WITH p AS ({POINTS}) SELECT id FROM p WHERE {_idx('x', '4')} = 1 AND {_idx('y', '4')} = 0")
    q["f03_context"] = (lambda s, d: (lambda df: df.where(fold.predicate(CONTEXT, GRAIN, dict(df.dtypes))).groupBy("quarter").agg(F.count("*").alias("n")))(facts(s, d)), _F + f" SELECT quarter, count(*) AS n FROM f WHERE {_CTX} GROUP BY quarter")
    q["f04_predicate"] = (lambda s, d: fold.mark_filters(points(s, d), {"status": "O", "day": "1996-01-01.."}, {"day"}).select("id"), f"WITH p AS ({POINTS}) SELECT id FROM p WHERE status = 'O' AND (day IS NULL OR day >= DATE '1996-01-01')")
    q["a12_cell_partials"] = (lambda s, d: facts(s, d).groupBy("x", "y", *GRAIN).agg(*[p.from_facts() for p in (Partial("sum", "qty"), Partial("cnt"), Partial("swp", "qty", "w"), Partial("min", "qty"), Partial("max", "qty"))]), _F + " SELECT x, y, flag, status, quarter, sum(qty)::FLOAT AS sum__qty, count(*)::INT AS cnt, sum(qty * w)::FLOAT AS swp__qty__w, min(qty) AS min__qty, max(qty) AS max__qty FROM f GROUP BY ALL")
    q["a13_fold_marks"] = (lambda s, d: _fold_marks(facts(s, d), trees(), CONTEXT), _F + ", " + _fold_sql(list(MEASURES), _CTX))
    q["flagship_dominant"] = (flagship, _F + ", " + _fold_sql(["total", "weighted", "share_r", "top_flag"], "status = 'O'"))
    q["g01_classify"] = (lambda s, d: marks.classify_frame(facts(s, d), ["flag", "status", "quarter", "zone", "zreal"]), _F + ", p AS (SELECT count(DISTINCT (x, y)) AS n FROM f) " + " UNION ALL ".join(f"SELECT '{c}' AS channel, count(DISTINCT (x, y, {c})) > (SELECT n FROM p) AS per_fact FROM f" for c in ("flag", "status", "quarter", "zone", "zreal")))
    q["g02_marks"] = (lambda s, d: marks.group(placed_facts(s, d), SUPPLY, ["zone"], ["_file", "_row"]).select("x", "y", "zone", "total", "n", "least", "most", "top_flag", F.round(F.col("share_r").cast("double"), 4).alias("share_r"), "n_facts"), _F + ", a AS (SELECT x, y, flag AS top_flag FROM (SELECT x, y, flag, row_number() OVER (PARTITION BY x, y ORDER BY sum(qty) DESC, flag) AS r FROM f GROUP BY x, y, flag) WHERE r = 1) SELECT x, y, first(zone) AS zone, sum(qty)::FLOAT AS total, count(*)::FLOAT AS n, min(qty) AS least, max(qty) AS most, first(top_flag) AS top_flag, round((coalesce(sum(qty) FILTER (WHERE flag = 'R'), 0) / sum(qty))::FLOAT::DOUBLE, 4) AS share_r, count(*) AS n_facts FROM f JOIN a USING (x, y) GROUP BY x, y")
    q["g03_effective_view"] = (lambda s, d: s.createDataFrame([(c.name, c.role, c.type) for c in marks.effective_view(SUPPLY, ["zone"]).channels], "name string, role string, type string"), "SELECT * FROM (VALUES ('id', 'identity', 'dict'), ('zone', 'dimension', 'dict'), " + ", ".join(f"('{n}', '{'dimension' if n.endswith('_flag') else 'measure'}', '{'dict' if n.endswith('_flag') else 'f32'}')" for n in MEASURES) + ") t(name, role, type)")
    q["g05_numeric_domain"] = (lambda s, d: domains.numeric(points(s, d), "x").select("min", "max", F.posexplode("quantiles").alias("i", "v")).select("min", "max", "i", F.round("v", 4).alias("v")), f"WITH p AS ({POINTS}), q AS (SELECT min(x)::DOUBLE AS min, max(x)::DOUBLE AS max, quantile_cont(x::DOUBLE, {[i / 128 for i in range(129)]}) AS v FROM p) SELECT min, max, i::INT AS i, round(v[i + 1], 4) AS v FROM q, range(0, 129) r(i)")
    q["g06_distinct_domain"] = (lambda s, d: domains.coded(points(s, d), "priority"), f"WITH p AS ({POINTS}), v AS (SELECT DISTINCT coalesce(priority, 'null') AS value FROM p) SELECT value, (row_number() OVER (ORDER BY value) - 1)::INT AS code FROM v")
    q["g07_temporal_domain"] = (lambda s, d: domains.temporal(points(s, d), "day"), f'WITH p AS ({POINTS}) SELECT strftime(min(day), \'%Y-%m-%d\') AS "from", strftime(max(day), \'%Y-%m-%d\') AS "to" FROM p')
    q["g09_probe"] = (lambda s, d: planner.probe_frame(facts(s, d)), _F + " SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n, count(DISTINCT (x, y)) AS n_distinct FROM f")
    q["g10_axis_domain"] = (lambda s, d: cube.axis_values(facts(s, d), "quarter"), _F + " SELECT DISTINCT strftime(quarter, '%Y-%m-%d') AS value FROM f WHERE quarter IS NOT NULL")
    q["b04_quadtree"] = (lambda s, d: pyramid.quadtree(points(s, d), ROOT, 6, 500, ["id"]).select("z", "tx", "ty", "id", "merged_count", "is_leaf"), _PTS + ", r AS (SELECT l.*, t.is_leaf FROM lvl l JOIN tiles t USING (z, tx, ty)) SELECT z::INT AS z, tx, ty, id, 1 AS merged_count, is_leaf FROM r WHERE is_leaf UNION ALL SELECT z::INT, tx, ty, min(id), count(*)::INT, false FROM r WHERE NOT is_leaf GROUP BY z, tx, ty, gx, gy")
    q["b04_quadtree_tiles"] = (lambda s, d: pyramid.quadtree_tiles(pyramid.indexed(points(s, d), ROOT), 6, 500), _PTS + " SELECT z::INT AS z, tx, ty, n, is_leaf FROM tiles")
    q["b05_aggregate"] = (lambda s, d: pyramid.aggregate(mark_table(s, d), ROOT, ["total"], ["zone", "lowest_flag"]).select("z", "tx", "ty", "is_leaf", "real", "k1", "k2", "x", "y", "merged_count", F.round(F.col("total").cast("double"), 2).alias("total"), "zone", "lowest_flag"), _KEYED + f""", md AS (SELECT {_MK}, zone FROM (SELECT {_MK}, zone, row_number() OVER (PARTITION BY {_MK} ORDER BY count(*) DESC, zone) AS r FROM pl WHERE NOT "real" GROUP BY {_MK}, zone) WHERE r = 1),
mf AS (SELECT {_MK}, lowest_flag FROM (SELECT {_MK}, lowest_flag, row_number() OVER (PARTITION BY {_MK} ORDER BY count(*) DESC, lowest_flag) AS r FROM pl WHERE NOT "real" GROUP BY {_MK}, lowest_flag) WHERE r = 1)
SELECT z::INT AS z, tx, ty, is_leaf, "real", k1, k2, x, y, 1 AS merged_count, round(total::DOUBLE, 2) AS total, zone, lowest_flag FROM pl WHERE "real"
UNION ALL SELECT z::INT, tx, ty, is_leaf, "real", k1, k2, ((k1 + 0.5::DOUBLE) * {SIDE} / (1 << (z + 9)))::FLOAT, ((k2 + 0.5::DOUBLE) * {SIDE} / (1 << (z + 9)))::FLOAT, n, t, zone, lowest_flag FROM (SELECT {_MK}, is_leaf, count(*)::INT AS n, round(avg(total::DOUBLE)::FLOAT::DOUBLE, 2) AS t FROM pl WHERE NOT "real" GROUP BY {_MK}, is_leaf) JOIN md USING ({_MK}) JOIN mf USING ({_MK})""")
    q["b08_tile_meta"] = (lambda s, d: pyramid.metadata(pyramid.aggregate(mark_table(s, d), ROOT, ["total"], ["zone"])), _KEYED + f' SELECT z::INT AS z, tx, ty, count(DISTINCT ("real", k1, k2)) AS n_rows, bool_or(is_leaf) AS is_leaf FROM pl GROUP BY z, tx, ty')
    q["b09_verify"] = (lambda s, d: verify.summary(pyramid.quadtree(points(s, d), ROOT, 6, 500, ["id"]), points(s, d).count()).select("leaf_rows", "overfull", "source_rows", "verdict"), "SELECT count(*) AS leaf_rows, 0::BIGINT AS overfull, count(*)::INT AS source_rows, 'ok' AS verdict FROM orders")
    q["b09_verify_facts"] = (lambda s, d: verify.group_summary(pyramid.cube(facts(s, d), ROOT, GRAIN, [Partial("cnt")]), facts(s, d).count()), "SELECT count(*) AS facts, count(*)::INT AS source_rows, 'ok' AS verdict FROM lineitem")
    q["b07_signal_m4"] = (lambda s, d: pyramid.signal_m4(load(s, d, "SELECT CAST(event_id AS DOUBLE) AS t, value AS v FROM events"), "t", "v", 0.0, 100000.0, 50), "WITH e AS (SELECT greatest(0, least(49, floor(event_id::DOUBLE / 100000 * 50)))::INT AS bucket, event_id, value FROM events WHERE value IS NOT NULL) SELECT bucket, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(value) AS min, max(value) AS max, count(*) AS n FROM e GROUP BY bucket")
    q["g13_cube"] = (lambda s, d: pyramid.cube(facts(s, d), ROOT, ["flag", "quarter"], [Partial("sum", "qty"), Partial("cnt"), Partial("max", "qty")]), _KEYED + f', r AS (SELECT pl.z, pl.tx, pl.ty, is_leaf, "real", k1, k2, f.flag, f.quarter, f.qty FROM pl JOIN f USING (x, y)) SELECT z::INT AS z, tx, ty, is_leaf, "real", k1, k2, flag, quarter, sum(qty)::FLOAT AS sum__qty, count(*)::INT AS cnt, max(qty) AS max__qty FROM r GROUP BY ALL')
    q["g11_leaf_occupancy"] = (lambda s, d: (lambda c: cube.leaf_occupancy(c[0], c[1]).select("nnz", "marks", F.round("occupancy", 9).alias("occupancy")))(_cells(s, d)), _CELLS + " SELECT count(*) AS nnz, count(DISTINCT (z, tx, ty, mki)) AS marks, round(count(*) / (count(DISTINCT (z, tx, ty, mki)) * 84), 9) AS occupancy FROM cells")
    q["c03_layout"] = (lambda s, d: (lambda c: cube.layouts(c[0], c[1], 0.25).select("z", "tx", "ty", "marks", "nnz", "layout"))(_cells(s, d)), _CELLS + " SELECT z::INT AS z, tx, ty, count(DISTINCT mki) AS marks, count(*)::BIGINT AS nnz, CASE WHEN count(*) / (count(DISTINCT mki) * 84) >= 0.25 THEN 'dense' ELSE 'sparse' END AS layout FROM cells GROUP BY z, tx, ty")
    q["c04_sparse"] = (lambda s, d: (lambda c: cube.sparse(c[0], c[2]).select("z", "tx", "ty", F.array_join("offsets", ",").alias("offsets"), F.array_join("cell_ids", ",").alias("cell_ids"), F.array_join(F.transform("sum__qty", lambda v: v.cast("int")), ",").alias("sums")))(_cells(s, d)), _CELLS + ", o AS (SELECT z, tx, ty, mki, count(*) AS k FROM cells GROUP BY ALL), oo AS (SELECT z, tx, ty, '0,' || string_agg(CAST(e AS BIGINT)::VARCHAR, ',' ORDER BY mki) AS offsets FROM (SELECT *, sum(k) OVER (PARTITION BY z, tx, ty ORDER BY mki) AS e FROM o) GROUP BY z, tx, ty) SELECT z::INT AS z, tx, ty, first(offsets) AS offsets, string_agg(cell_id::VARCHAR, ',' ORDER BY mki, cell_id) AS cell_ids, string_agg(sum__qty::INT::VARCHAR, ',' ORDER BY mki, cell_id) AS sums FROM cells JOIN oo USING (z, tx, ty) GROUP BY z, tx, ty")
    q["c06_prefix"] = (lambda s, d: (lambda c: cube.dense(c[0], c[1], c[2]).select("z", "tx", "ty", "mki", "cell_id", "sum__qty", "cnt", F.when(~F.isnan("max__qty"), F.col("max__qty")).alias("max__qty")))(_cells(s, d)), _CELLS + ", low AS (SELECT * FROM cells), ev AS (SELECT DISTINCT z, tx, ty, mki FROM low), fl AS (SELECT ev.*, r.c::INT AS cell_id, l.sum__qty, l.cnt, l.max__qty FROM ev CROSS JOIN range(0, 84) r(c) LEFT JOIN low l ON (l.z, l.tx, l.ty, l.mki, l.cell_id) = (ev.z, ev.tx, ev.ty, ev.mki, r.c)) SELECT z::INT AS z, tx, ty, mki::INT AS mki, cell_id, CAST(sum(coalesce(sum__qty, 0)::DOUBLE) OVER w AS FLOAT) AS sum__qty, CAST(sum(coalesce(cnt, 0)) OVER w AS INT) AS cnt, max__qty FROM fl WINDOW w AS (PARTITION BY z, tx, ty, mki, cell_id // 28 ORDER BY cell_id)")
    q["c07_range_difference"] = (lambda s, d: (lambda c: cube.range_by_difference(cube.dense(c[0], c[1], c[2]), c[1], c[2][0], 8, 15).select("z", "tx", "ty", "mki", "category", F.col("sum__qty").cast("double").alias("v")))(_cells(s, d)), _CELLS + ", low AS (SELECT * FROM cells) SELECT z::INT AS z, tx, ty, mki::INT AS mki, c::BIGINT AS category, coalesce(sum(sum__qty::DOUBLE) FILTER (WHERE cell_id // 28 = c AND cell_id % 28 BETWEEN 8 AND 15), 0) AS v FROM low CROSS JOIN range(0, 3) r(c) GROUP BY z, tx, ty, mki, c")
    q["c08_range_extremum"] = (lambda s, d: (lambda c: cube.range_by_difference(cube.dense(c[0], c[1], c[2]), c[1], c[2][2], 8, 15).select("z", "tx", "ty", "mki", "category", "max__qty"))(_cells(s, d)), _CELLS + ", low AS (SELECT * FROM cells) SELECT z::INT AS z, tx, ty, mki::INT AS mki, c::BIGINT AS category, max(max__qty) FILTER (WHERE cell_id // 28 = c AND cell_id % 28 BETWEEN 8 AND 15) AS max__qty FROM low CROSS JOIN range(0, 3) r(c) GROUP BY z, tx, ty, mki, c")
    q["b10_witness"] = (lambda s, d: cube.witness(_cells(s, d)[0]), _CELLS + " SELECT z::INT AS z, tx, ty, sum(cnt)::BIGINT AS facts FROM cells GROUP BY z, tx, ty")
    q["q01_fold_equals"] = (_view_fold(["total", "weighted", "top_flag"], fold.Context({"status": "O"})), _TILEFACTS + ", " + _fold_sql(["total", "weighted", "top_flag"], "status = 'O'", _MK))
    q["q01_fold_range"] = (_view_fold(list(MEASURES), CONTEXT), _TILEFACTS + ", " + _fold_sql(list(MEASURES), _CTX, _MK))
    q["q01_fold_impossible"] = (_view_fold(["total", "top_flag"], fold.Context({"nowhere": "x"})), _TILEFACTS + ", " + _fold_sql(["total", "top_flag"], "false", _MK))

    def from_cube(s, d):
        c = pyramid.cube(facts(s, d), ROOT, GRAIN, marks.cube_partials(SUPPLY))
        return _rounded(fold.fold_cube(c, trees("total", "share_r", "low_flag"), CONTEXT, TILES, GRAIN), trees("total", "share_r", "low_flag")).drop("alive")

    q["q01_fold_cube"] = (from_cube, _KEYED.replace("WITH f AS", "WITH f1 AS").replace("FROM f GROUP BY x, y)", "FROM f1 GROUP BY x, y)") + f', {_REQ}, f AS (SELECT pl.z::INT AS z, pl.tx, pl.ty, "real", k1, k2, f1.flag, f1.status, f1.quarter, f1.qty, f1.w FROM pl JOIN req USING (z, tx, ty) JOIN f1 USING (x, y)), ' + _fold_sql(["total", "share_r", "low_flag"], _CTX, _MK))
    q["q03_mki"] = (lambda s, d: pyramid.numbered(pyramid.aggregate(mark_table(s, d), ROOT, ["total"], ["zone"])).select("z", "tx", "ty", "real", "k1", "k2", "mki"), _KEYED + f' SELECT z::INT AS z, tx, ty, "real", k1, k2, (row_number() OVER (PARTITION BY z, tx, ty ORDER BY "real", k1, k2) - 1)::INT AS mki FROM (SELECT DISTINCT {_MK} FROM pl)')
    q["q08_route"] = (lambda s, d: (lambda c: planner.tile_costs(c, SUPPLY).orderBy(F.desc("bytes"), "z", "tx", "ty").limit(12))(pyramid.cube(facts(s, d), ROOT, GRAIN, marks.cube_partials(SUPPLY))), _KEYED + ", r AS (SELECT DISTINCT pl.z, pl.tx, pl.ty, \"real\", k1, k2, f.flag, f.status, f.quarter FROM pl JOIN f USING (x, y)) SELECT z::INT AS z, tx, ty, count(*) * 12 AS bytes FROM r GROUP BY z, tx, ty ORDER BY bytes DESC, z, tx, ty LIMIT 12")
    q["v01_select_tiles"] = (lambda s, d: viewport.select_tiles(pyramid.quadtree_tiles(pyramid.indexed(points(s, d), ROOT), 6, 500), ROOT, Bbox(0, 0, 262144, 65536), 1600), _PTS + f", t AS (SELECT *, {SIDE} / 262144.0 * 1600 / (1 << z) AS px FROM tiles) SELECT z::INT AS z, tx, ty, is_leaf FROM t WHERE tx::DOUBLE * {SIDE} / (1 << z) < 262144 AND (tx + 1)::DOUBLE * {SIDE} / (1 << z) > 0 AND ty::DOUBLE * {SIDE} / (1 << z) < 65536 AND (is_leaf OR px <= 512) AND (z = 0 OR 2 * px > 512)")
    q["e02_normalize"] = (lambda s, d: points(s, d).select("id", *[F.round(scales.normalized(F.col("x"), 1000.0, 500000.0, k), 6).alias(k) for k in ("linear", "sqrt", "log")]), f"WITH p AS ({POINTS}) SELECT id, round(greatest(0, least(1, (x::DOUBLE - 1000) / 499000)), 6) AS linear, round(greatest(0, least(1, (sqrt(x::DOUBLE) - sqrt(1000::DOUBLE)) / (sqrt(500000::DOUBLE) - sqrt(1000::DOUBLE)))), 6) AS sqrt, round(greatest(0, least(1, (ln(x::DOUBLE) - ln(1000::DOUBLE)) / (ln(500000::DOUBLE) - ln(1000::DOUBLE)))), 6) AS log FROM p")
    q["e03_diverging"] = (lambda s, d: points(s, d).select("id", F.round(scales.diverging(F.col("x"), 0.0, 131072.0, 524288.0), 12).alias("t")), f"WITH p AS ({POINTS}) SELECT id, round(greatest(0, least(1, CASE WHEN x < 131072 THEN 0.5::DOUBLE * x::DOUBLE / 131072 ELSE 0.5::DOUBLE + 0.5::DOUBLE * (x::DOUBLE - 131072) / 393216 END)), 12) AS t FROM p")
    q["e04_robust"] = (lambda s, d: scales.robust_bounds(points(s, d), "x").select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi")), f"WITH p AS ({POINTS}) SELECT round(quantile_cont(x::DOUBLE, 0.02), 4) AS lo, round(quantile_cont(x::DOUBLE, 0.98), 4) AS hi FROM p")
    q["e05_quantize"] = (lambda s, d: points(s, d).select("id", scales.quantized(F.col("x"), 1000.0, 400000.0, 7).alias("bin")), f"WITH p AS ({POINTS}) SELECT id, greatest(0, least(6, floor((x::DOUBLE - 1000) / 399000 * 7)))::INT AS bin FROM p")
    q["e06_quantile"] = (lambda s, d: scales.quantile_bin(points(s, d), "x", 5).select("id", "bin"), f"WITH p AS ({POINTS}), b AS (SELECT quantile_cont(x::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS q FROM p) SELECT id, len(list_filter(q, lambda v: v <= x::DOUBLE))::INT AS bin FROM p, b")
    q["e07_threshold"] = (lambda s, d: points(s, d).select("id", scales.thresholded(F.col("x"), [50000.0, 10000.0, 200000.0]).alias("bin")), f"WITH p AS ({POINTS}) SELECT id, ((x >= 10000)::INT + (x >= 50000)::INT + (x >= 200000)::INT)::INT AS bin FROM p")
    q["e08_categorical"] = (lambda s, d: points(s, d).withColumn("code", scales.category_code(F.col("priority"), ["1-URGENT", "2-HIGH", "5-LOW"])).select("id", "code", scales.palette_color(F.col("code"), scales.CATEGORICAL["okabeIto"]).alias("color")), f"WITH p AS ({POINTS}), c AS (SELECT id, CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END AS code FROM p) SELECT id, code, (['#E69F00', '#56B4E9', '#009E73', '#F0E442'])[code + 1] AS color FROM c")
    ramp = scales.stops("blueRed", "diverging")

    def colors(s, d):
        t = points(s, d).select("id", scales.interpolated(scales.normalized(F.col("x"), 0.0, 524288.0), ramp).alias("c"))
        return t.select("id", "c.r", "c.g", "c.b")

    mix = lambda k: f"floor(CASE WHEN t < 1 THEN {ramp[0][k]} * (1 - t) + {ramp[1][k]} * t ELSE {ramp[1][k]} * (2 - t) + {ramp[2][k]} * (t - 1) END + 0.5)::INT"
    q["e09_rgb"] = (colors, f"WITH p AS ({POINTS}), n AS (SELECT id, x::DOUBLE / 524288 * 2 AS t FROM p) SELECT id, {mix(0)} AS r, {mix(1)} AS g, {mix(2)} AS b FROM n")
    q["w01_merged_count"] = (lambda s, d: pyramid.quadtree(points(s, d), ROOT, 6, 500, ["id"]).where(~F.col("is_leaf")).groupBy("z").agg(F.sum("merged_count").alias("rows"), F.max("merged_count").alias("largest")), _PTS + ", g AS (SELECT z, tx, ty, gx, gy, count(*) AS n FROM lvl JOIN tiles USING (z, tx, ty) WHERE NOT is_leaf GROUP BY ALL) SELECT z::INT AS z, sum(n)::BIGINT AS rows, max(n)::INT AS largest FROM g GROUP BY z")
    q["t01_stage_stats"] = (lambda s, d: telemetry.stage_stats(load(s, d, "SELECT event_type, value, event_id FROM events"), "event_type", "value", "event_id").select("event_type", "n", "last", "max", F.round("total", 4).alias("total"), "p50", "p95"), "WITH e AS (SELECT event_type, list(value ORDER BY value) FILTER (WHERE value IS NOT NULL) AS v, count(value) AS n, arg_max(value, event_id) AS last, max(value) AS max, round(sum(value), 4) AS total FROM events GROUP BY event_type) SELECT event_type, n, last, max, total, v[least(n - 1, floor(n * 0.5))::BIGINT + 1] AS p50, v[least(n - 1, floor(n * 0.95::DOUBLE))::BIGINT + 1] AS p95 FROM e")
    q["t02_totals"] = (lambda s, d: telemetry.network_totals(load(s, d, "SELECT CAST(user_id AS BIGINT) AS b, CAST(event_id % 100 AS BIGINT) AS ms, event_type FROM events"), "b", "ms", F.col("event_type") == "view").select("cold", "warm", "cold_bytes", "cold_ms", F.round("goodput", 4).alias("goodput")), "SELECT count(*) FILTER (WHERE event_type <> 'view') AS cold, count(*) FILTER (WHERE event_type = 'view') AS warm, sum(user_id) FILTER (WHERE event_type <> 'view')::BIGINT AS cold_bytes, sum(event_id % 100) FILTER (WHERE event_type <> 'view')::BIGINT AS cold_ms, round(1000 * sum(user_id) FILTER (WHERE event_type <> 'view') / sum(event_id % 100) FILTER (WHERE event_type <> 'view'), 4) AS goodput FROM events")
    q["src_joins"] = _same("SELECT n_name, count(*) AS n, count(DISTINCT s_suppkey) AS suppliers FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') GROUP BY n_name")
    q["src_range_join"] = _same("SELECT a.s_suppkey AS a, count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal BETWEEN a.s_acctbal - 500 AND a.s_acctbal + 500 GROUP BY a.s_suppkey")
    q["src_set_ops"] = _same("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
    q["src_rollup"] = _same("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
    q["src_windows"] = _same("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders")
    from . import edges

    return q | edges.catalogue()


def queries():
    return {k: v[0] for k, v in catalogue().items()}


def oracle_sql():
    return {k: v[1] for k, v in catalogue().items() if v[1] is not None}
